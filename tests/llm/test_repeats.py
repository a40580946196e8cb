import hashlib
import random
from collections import Counter

from pyspark.sql import Row

from turnweave.llm import repeats


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(b for b, g in zip(t, gone) if not g)
        out.append((str(d), len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def answer(spark, rows, length, q, passage=None):
    docs = spark.createDataFrame([Row(doc_id=d, text=t, open="x", k1=1, name="n") for d, t in rows], "doc_id long, text string, open string, k1 int, name string")
    got = repeats.remove_repeats(docs, length, q, passage).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def corpus(seed, n=50, size=400, alphabet="abcdé "):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        t = "".join(rng.choices(alphabet, k=rng.randrange(size)))
        for _ in range(rng.randrange(3)):
            if texts:
                other = rng.choice(texts)
                a = rng.randrange(len(other) + 1)
                piece = other[a : a + rng.randrange(120)]
                at = rng.randrange(len(t) + 1)
                t = t[:at] + piece + t[at:]
        if rng.random() < 0.2 and texts:
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(alphabet)
            t = "".join(t)
        texts.append(t)
    return list(enumerate(texts))


def test_against_counting_all_windows(spark):
    rows = corpus(1) + [(100, None), (101, ""), (None, "short"), (102, "x" * 39), (103, "x" * 40), (104, "ab" * 300), (105, "abc" * 100 + "ab" * 50)]
    rows += [rows[3], rows[4], (900, rows[5][1]), (None, rows[6][1])]
    assert answer(spark, rows, 40, 14) == brute(rows, 40)


def test_larger_windows_than_blocks(spark):
    rows = corpus(2, 40, 900)
    assert answer(spark, rows, 100, 20) == brute(rows, 100)


def test_empty(spark):
    assert answer(spark, [], 40, 14) == []
    assert answer(spark, [(1, "a" * 41)], 40, 14) == brute([(1, "a" * 41)], 40)


def covered(rows, length):
    return {d: n for d, _, n, _, _ in brute(rows, length)}


def test_shorter_passages_beside(spark):
    rows = corpus(3, 60, 700) + [(200, "ab" * 200), (201, "ab" * 60 + "c" + "ab" * 70), (202, None)]
    assert answer(spark, rows, 70, 14, 40) == brute(rows, 70)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {str(r.doc_id): r.n_passage_bytes for r in repeats.remove_repeats(docs, 70, 14, 40).collect()}
    assert got == covered(rows, 40)


def test_a_text_over_one_chunk(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefgh ijk", k=1_300_000))
    piece = "".join(rng.choices("xyz", k=500))
    rows = [(1, long[:600_000] + piece + long[600_000:]), (2, "head " + piece + " tail"), (3, long[1_000_000:1_000_600]), (4, "x" * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: (1100, 2), 2: (500, 1), 3: (600, 1), 4: (0, 0)}
