import inspect
import math
import random
import re

import pytest
from pyspark.sql import Row

from turnweave.llm import minhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width=4):
    """doc_id -> (n_shingles, component_id, kept) by comparing all pairs."""
    sets = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.append(s)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((str(d), len(sets[i]), least.get(find(i)), least.get(find(i)) == d) for i, (d, _) in enumerate(rows)), key=str)


def answer(spark, rows, **options):
    docs = spark.createDataFrame([Row(doc_id=d, text=t, node="x", bands=1) for d, t in rows], "doc_id long, text string, node string, bands int")
    got = minhash.near_duplicates(docs, **options).collect()
    return sorted(((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got), key=str)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(n):
        if i % 3 and rows:
            words = (rows[rng.randrange(len(rows))][1] or "a b c").split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words).upper() if rng.random() < 0.3 else "\n".join(words)))
        else:
            rows.append((i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 90)))))
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = corpus() + [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "One  TWO"), (105, "one two three"), (106, "ÉTÉ été été été été"), (107, "été été été été été")]
    rows += [(108, " ".join(["again"] * 3000)), (109, " ".join(["again"] * 3001))]
    assert answer(spark, rows) == brute(rows)


def test_blocks_of_one(spark):
    rows = corpus(2, 40)
    assert answer(spark, rows, block_shingles=60) == brute(rows)


def test_null_and_repeated_ids(spark):
    text = " ".join("w%d" % i for i in range(50))
    near = text.replace("w49", "x")
    rows = [(None, text), (None, near), (7, near), (7, near), (3, "a b c d e"), (3, "f g h i j"), (None, "alone words of a null id")]
    got = answer(spark, rows)
    assert got == sorted([("None", 47, 7, False), ("None", 47, 7, False), ("7", 47, 7, True), ("7", 47, 7, True), ("3", 2, 3, True), ("3", 2, 3, True), ("None", 3, None, True)], key=str)


def test_empty_table(spark):
    assert answer(spark, []) == []
    assert answer(spark, [(1, "lone text here now")]) == [("1", 1, 1, True)]


def test_circulant_estimate():
    import numpy as np

    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    values = np.concatenate([np.sort(a), np.sort(b)])
    sig = minhash.signatures(values, np.array([0, 1000, 2000]), 512)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.08
    for i, part in enumerate((a, b)):
        alone = minhash.signatures(part, np.array([0, len(part)]), 512)
        assert (alone[0] == sig[i]).all()


def test_sketch_floor_loses_no_links():
    """The chance that a link of exactly 0.8 stays under the floor is far below that of the bands."""
    option = {k: p.default for k, p in inspect.signature(minhash.near_duplicates).parameters.items()}
    n = option["bands"] * option["rows"]
    low = math.ceil(n * option["sketch_floor"])
    tail = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(low))
    assert tail < 0.01 * (1 - 0.8 ** option["rows"]) ** option["bands"]
