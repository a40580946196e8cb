import itertools

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from turnweave.llm import toxicity


def test_forward_backward_against_all_taggings():
    rng = np.random.default_rng(3)
    emission, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    first = np.array([0, 4, 4, 9])
    got, pair = toxicity.marginals(emission, first, trans)
    want, want_pair = np.zeros(9), np.zeros((2, 2))
    for a, b in ((0, 4), (4, 9)):
        weights = {}
        for tags in itertools.product((0, 1), repeat=b - a):
            score = sum(emission[a + i] * t for i, t in enumerate(tags)) + sum(trans[x, y] for x, y in zip(tags, tags[1:]))
            weights[tags] = np.exp(score)
        total = sum(weights.values())
        for tags, w in weights.items():
            want[a:b] += np.array(tags) * w / total
            for x, y in zip(tags, tags[1:]):
                want_pair[x, y] += w / total
    assert np.allclose(got, want) and np.allclose(pair, want_pair)


def test_long_chains_are_whole(monkeypatch):
    rng = np.random.default_rng(5)
    first = np.array([0, 200, 200, 263, 264, 464, 528, 1000])
    emission, trans = rng.normal(size=1000) * 2, np.array([[2.0, -2.0], [-1.0, 1.5]])
    want, want_pair = np.zeros(1000), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        score = np.zeros((b - a, 2))
        score[:, 1] = emission[a:b]
        f, g = [score[0]], [np.zeros(2)]
        for i in range(1, b - a):
            f.append(np.logaddexp.reduce(f[-1][:, None] + trans, axis=0) + score[i])
        for i in range(b - a - 1, 0, -1):
            g.insert(0, np.logaddexp.reduce(trans + (score[i] + g[0])[None], axis=1))
        f, g = np.array(f), np.array(g)
        total = np.logaddexp.reduce(f[-1])
        want[a:b] = np.exp(f[:, 1] + g[:, 1] - total)
        for i in range(b - a - 1):
            want_pair += np.exp(f[i][:, None] + trans + (score[i + 1] + g[i + 1])[None] - total)
    for run in (1 << 17, 300):
        monkeypatch.setattr(toxicity, "RUN", run)
        got, pair = toxicity.marginals(emission, first, trans)
        assert np.allclose(got, want) and np.allclose(pair, want_pair)


def tables(spark):
    rng = np.random.default_rng(1)
    words = ["%s%s" % (a, b) for a in ("re", "to", "an", "ish") for b in ("la", "mi", "no", "ke", "ba")]
    docs, labels = [], []
    for i in range(300):
        w = list(rng.choice(words, rng.integers(5, 200)))
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            w.insert(int(rng.integers(len(w))), str(rng.choice(["grobble", "snarkle", "Snarkle,"])))
        docs.append((i, " ".join(w)))
        if i % 10 < 8:
            labels.append((i, int(toxic)))
    docs += [(400, None), (401, ""), (402, "all snarkle now"), (402, "all snarkle now"), (None, "grobble here"), (403, "calm " * 5000), (404, "calm " * 300_000 + "snarkle " + "toan " * 9)]
    d = spark.createDataFrame([Row(doc_id=i, text=t, score="x", spans="y", toxic=9) for i, t in docs], "doc_id long, text string, score string, spans string, toxic int")
    return d, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents(spark):
    docs, labels = tables(spark)
    got = toxicity.score_documents(docs, labels, F.col("doc_id") % 3 == 1).collect()
    assert len(got) == 307 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[402].predicted == 1 and [(s.begin, s.end) for s in by[402].spans] == [(4, 11)]
    assert by[404].spans and by[404].spans[0].begin == 1_500_000
    assert by[None].predicted == 1 and by[400].predicted == by[401].predicted == by[403].predicted == 0


def test_no_labels_and_empty(spark):
    docs, labels = tables(spark)
    assert {r.score for r in toxicity.score_documents(docs, labels.where("toxic = 0"), F.lit(False)).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), labels, F.lit(False)).collect() == []
