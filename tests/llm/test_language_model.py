import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from turnweave.llm import language_model as lm

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), None]


def quantised(count):
    """The middle of the range of a scale that grows by a fifth, by one at least."""
    low = 1
    while (high := max(low + 1, round(low * 1.2))) <= count:
        low = high
    return (low + high - 1) / 2 if count else 0.0


def conditional(both, context, word, n, v, prior):
    alone = (quantised(word) + 1) / (n + v + 1)
    return (min(quantised(both), quantised(context)) + prior * alone) / (quantised(context) + prior)


def brute(rows, prior):
    train = [tokens(t) for _, t, learn in rows if learn]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip([None, *t], t))
    n, v = sum(one.values()), len(one)
    out = []
    for doc_id, text, learn in rows:
        t = tokens(text)
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for a, b in zip([None, *t], t):
            score += math.log10(conditional(two[a, b], one[a], one[b], n, v, prior))
        out.append((str(doc_id), not learn, len(t), sum(one[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
    return sorted(out)


def answer(spark, rows, prior=60.0, **options):
    docs = spark.createDataFrame([Row(doc_id=d, text=t, learn=x, k1="clash", word=1) for d, t, x in rows], "doc_id long, text string, learn boolean, k1 string, word int")
    got = lm.score_texts(docs, F.col("learn"), prior=prior, bits_per_entry=512, **options).collect()
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)


ROWS = [(i, " ".join(f"w{(i * j * j) % (7 + i)}" for j in range(30)), i % 3 != 0) for i in range(25)]
ROWS += [(50, None, True), (51, "", False), (52, "W1 w1\tUNSEEN Ünseen", False), (None, "w1 w2", True), (53, "w1 w2", True), (53, "w1 w2", True), (53, "w1", True)]


def test_against_counting(spark):
    assert answer(spark, ROWS) == brute(ROWS, 60.0)


def test_many_segments(spark):
    assert answer(spark, ROWS, segment_tokens=40) == brute(ROWS, 60.0)


def test_filter_bound_drops_nothing(spark):
    assert answer(spark, ROWS, max_filter_bytes=16 << 10) == brute(ROWS, 60.0)


def test_many_groups(spark):
    assert answer(spark, ROWS, max_filter_bytes=32 << 10, group_bytes=150) == brute(ROWS, 60.0)


def test_nothing_to_learn_from(spark):
    rows = [(1, "a b", False), (2, None, False)]
    assert [r[:6] for r in answer(spark, rows)] == [("1", True, 3, 0, 0, 0.0), ("2", True, 1, 0, 0, 0.0)]
    assert answer(spark, []) == []


def markov(n, seed):
    rng = np.random.default_rng(seed)
    follow = rng.integers(0, 300, (300, 4))
    out = []
    for i in range(n):
        w, words = int(rng.integers(300)), []
        for _ in range(40):
            w = int(follow[w, rng.integers(4)]) if rng.random() < 0.8 else int(rng.integers(300))
            words.append(f"w{w}")
        out.append((i, " ".join(words), i % 5 != 0))
    return out


def test_a_context_sums_to_one():
    train = [tokens(t) for _, t, learn in markov(200, 3) if learn]
    one, two = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([None, *t], t))
    n, v = sum(one.values()), len(one)
    for a in list(one)[:40]:
        for prior in (1.0, 64.0, 4096.0):
            total = sum(conditional(two[a, w], one[a], one[w], n, v, prior) for w in one) + prior / (n + v + 1) / (quantised(one[a]) + prior)
            exact = all(quantised(c) == c for c in [*one.values(), *(two[a, w] for w in one)])
            assert abs(total - 1) < (1e-9 if exact else 0.2)  # the scale rounds a count by a tenth at most


def test_the_scale_is_exact_for_low_counts():
    assert [quantised(c) for c in range(8)] == list(range(8))
    assert all(abs(quantised(c) - c) <= 0.1 * c for c in range(1, 5000))


def test_held_out_gain_at_two_sizes_with_the_prior_of_the_training_rows(spark):
    for n in (100, 1000):
        docs = spark.createDataFrame(markov(n, 5), "doc_id long, text string, learn boolean")
        got = lm.score_texts(docs, F.col("learn")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        assert got[0] - got[1] > 0.05 * got[2]


def test_a_text_over_one_chunk(spark):
    rng = np.random.default_rng(2)
    rows = [(1, " ".join(f"word{k}" for k in rng.zipf(1.3, 170_000) % 50_000), True), (2, "word1 word2 word1", False)]
    assert len(rows[0][1]) > 1 << 20
    assert answer(spark, rows) == brute(rows, 60.0)


def test_filter_returns_levels():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    level = rng.integers(1, 30, 5000)
    words = np.zeros(int(level.sum()) * 16 // 64 + 1, np.uint64)
    for q in range(1, 30):
        place, mask = lm.Filter.place(hashes[level >= q], q, np.uint64(len(words)))
        np.bitwise_or.at(words, place.astype(np.int64), mask)
    got = lm.Filter(words, np.array([0, len(words)])).levels(hashes)
    assert (got >= level).all() and (got == level).mean() > 0.98
    assert (lm.Filter(words, np.array([0, len(words)])).levels(hashes + np.uint64(1)) > 0).mean() < 0.02
