import random
import re
from collections import defaultdict

from pyspark.sql import Row

from turnweave.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def run(spark, rows, **options):
    docs = spark.createDataFrame([Row(doc_id=d, text=t, source=s, size="x", place="y", row=3) for d, t, s in rows], "doc_id long, text string, source string, size string, place string, row int")
    return mixing.mix(docs, **options).collect()


def table(n=300):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 120), "src%d" % (0 if i % 3 == 0 else rng.randrange(7))) for i in range(n)]
    return rows + [(900, None, "src1"), (901, "", "ünused"), (902, "a b\x0bc d", None), (903, "x " * 40, None), (904, "w " * 5000, "src2"), (904, "w " * 70, "src2"), (None, "one two", "src3"), (905, "n", "B"), (906, "n", "a")]


def test_targets_sizes_and_taken(spark):
    rows = table()
    got = run(spark, rows, block_words=16, bucket_rows=40)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += count(t)
    want = brute_targets(dict(sizes))
    source = {(d, count(t)): s for d, t, s in rows}
    taken = defaultdict(int)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), count(t)) for d, t, _ in rows)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, run(spark, rows, block_words=16, bucket_rows=40)))


def test_slots_are_spread_evenly(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    _, pieces = mixing.schedule(docs, weights=(1, 3), block_words=10)
    owner = dict(pieces.select("slot", "place").distinct().collect())
    for i in range(0, 1000, 100):
        share = sum(owner.get(k) == 2 for k in range(i, i + 100))
        assert 72 <= share <= 78


def test_empty_and_wordless(spark):
    assert run(spark, []) == []
    assert [(r.size, r.target, r.taken) for r in run(spark, [(1, None, "a"), (2, " ", None)])] == [(0, 0.0, 0)] * 2


def test_many_small_sources(spark):
    rows = [(i, "w " * (1 + i % 9), "s%03d" % (i % 600)) for i in range(1200)] + [(5000 + i, "w " * 300, "hot") for i in range(20)]
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += t.count("w")
    want, source = brute_targets(dict(sizes)), {d: s for d, _, s in rows}
    for r in run(spark, rows, block_words=8):
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
