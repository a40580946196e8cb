"""Toxic spans by a linear-chain conditional random field.

Method. Documents carry labels, tokens do not; token labels are induced from a
bounded sample: a token of a toxic document is toxic if its word, or its first
four or five bytes, occur in at least ``min_toxic`` toxic and (nearly) no clean
documents of the sample. A two-state chain (clean, toxic) with features word,
prefixes and bias is fitted to them by gradient ascent on its log-likelihood,
whose expected counts come from forward-backward. To score a text,
forward-backward gives each token's marginal; their maximum, sum and density go
through a logistic layer fitted on the same sample. Runs of tokens of marginal
0.5 or more are the offending spans.

A text is one chain. It is worked on in segments of ``SEGMENT`` tokens side by
side, whose transfer matrices carry the messages on, so that a very long text
costs no more per token than a short one.

At scale. The fit reads at most ``sample`` documents of each class, the first
by a hash of their id, of texts of at most ``sample_bytes`` each, one for an id
(the documented bound of what comes to the driver); scoring is one pass without a
shuffle over all documents, with a few hundred kB of weights broadcast.

Edge cases. A null text is scored as an empty one, which gets the score of no
evidence. Null ids are in the training part if labelled at all, which a null
id cannot be. Without a label of both classes every score is 0. Repeated rows
are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm import bytetext as bt

#: Tokens of a segment, and about how many are worked on at once: both leave results as they are.
SEGMENT, RUN = 64, 1 << 17
#: Marginals below this are background, and weights below WEAK are not kept: both
#: hold the score of a long clean text, and the size of the broadcast, down.
BACKGROUND, WEAK = 0.25, 0.05
_PREFIXES = (4, 5)


def features(padded: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(feature hashes by kind, first token of each row, token starts, ends)."""
    s, e, first = bt.words(padded, starts)
    prefix = bt.prefix_hash(padded, bt.LOWER_CODES)
    kinds = [bt.mix(bt.span_hash(prefix, s, e), 21)]
    for n in _PREFIXES:
        kinds.append(bt.mix(bt.span_hash(prefix, s, np.minimum(e, s + n)) ^ (e - s < n), 21 + n))
    return kinds, first, s, e


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of each token, and the expected transitions (2 x 2); each row
    is one chain. Rows go in runs of about RUN tokens.

    emission: score of state 1 over state 0; trans: 2 x 2 transition scores.
    """
    out, pair, row = np.zeros(first[-1]), np.zeros((2, 2)), 0
    while row < len(first) - 1:
        end = max(row + 1, int(np.searchsorted(first, first[row] + RUN, "right")) - 1)
        if first[end] > first[row]:
            p, more = _chains(emission[first[row] : first[end]], first[row : end + 1] - first[row], trans)
            out[first[row] : first[end]] = p
            pair += more
        row = end
    return out, pair


def _chains(emission: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """marginals() of one run. Segments of SEGMENT tokens are columns of one
    matrix: their transfer matrices (2 x 2) are multiplied up side by side, and
    messages are then carried from segment to segment along each row."""
    n = np.diff(first)
    inside = np.arange(first[-1]) - np.repeat(first[:-1], n)
    per = -(-n // SEGMENT)
    base = np.append(0, np.cumsum(per))
    seg, place, count = np.repeat(base[:-1], n) + inside // SEGMENT, inside % SEGMENT, int(base[-1])
    opens = np.zeros(count, bool)
    opens[base[:-1][n > 0]] = True
    e = np.ones((SEGMENT, count))
    live = np.zeros((SEGMENT, count), bool)
    e[place, seg] = np.exp(np.clip(emission, -30, 30))
    live[place, seg] = True
    w, unit = np.exp(trans), np.eye(2)[:, :, None]
    # ahead[t]: from the message before the segment to the one at place t
    ahead = np.empty((SEGMENT, 2, 2, count))
    now = np.where(opens, unit, w[:, :, None])
    for t in range(SEGMENT):
        step = now if not t else np.stack([now[:, 0] * w[0, j] + now[:, 1] * w[1, j] for j in (0, 1)], 1)
        step = np.stack([step[:, 0], step[:, 1] * e[t]], 1)
        now = np.where(live[t], step / step.sum((0, 1)), now if t else unit)
        ahead[t] = now
    # behind[t]: from the message after the segment to the one at place t
    behind = np.empty((SEGMENT, 2, 2, count))
    back = np.broadcast_to(unit, (2, 2, count))
    behind[SEGMENT - 1] = back
    for t in range(SEGMENT - 2, -1, -1):
        step = np.stack([w[i, 0] * back[0] + w[i, 1] * e[t + 1] * back[1] for i in (0, 1)])
        back = np.where(live[t + 1], step / step.sum((0, 1)), unit)
        behind[t] = back
    before, after = np.ones((2, count)), np.ones((2, count))
    for k in range(1, int(per.max())):
        at = base[:-1][per > k] + k
        message = np.einsum("ic,ijc->jc", before[:, at - 1], ahead[SEGMENT - 1][:, :, at - 1])
        before[:, at] = message / message.sum(0)
    for k in range(int(per.max()) - 2, -1, -1):
        at = base[:-1][per > k + 1] + k
        message = np.einsum("ijc,jc->ic", behind[0][:, :, at + 1], after[:, at + 1])
        message = np.stack([w[i, 0] * message[0] + w[i, 1] * e[0, at + 1] * message[1] for i in (0, 1)])
        after[:, at] = message / message.sum(0)
    forward = np.einsum("in,nij->nj", before[:, seg], ahead[place, :, :, seg])
    backward = np.einsum("nij,jn->ni", behind[place, :, :, seg], after[:, seg])
    p = forward * backward
    follows = np.flatnonzero(inside[1:] > 0)
    later = backward[follows + 1] * np.stack([np.ones(len(follows)), e[place[follows + 1], seg[follows + 1]]], 1)
    joint = forward[follows][:, :, None] * w[None] * later[:, None, :]
    pair = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return p[:, 1] / p.sum(1), pair


@dataclass
class Tagger:
    """Weights of the fitted chain and of the logistic layer over it."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    layer: np.ndarray | None = None

    def emission(self, kinds: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(kinds[0]), self.bias)
        if len(self.keys):
            for h in kinds:
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                out += np.where(self.keys[at] == h, self.weights[at], 0.0)
        return out

    def tag(self, padded: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        kinds, first, s, e = features(padded, starts)
        emission = self.emission(kinds)
        return marginals(emission, first, self.trans)[0] if len(emission) else emission, first, s, e

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.layer is None:
            return np.zeros(len(first) - 1)
        z = evidence(p, first) @ self.layer[1:] + self.layer[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row: largest marginal, log of 1 + their sum, and ten times their
    density. Background does not add up, however long the text."""
    p = np.where(p >= BACKGROUND, p, 0.0)
    n = np.diff(first)
    total, most = np.zeros(len(n)), np.zeros(len(n))
    some = np.flatnonzero(n)
    if len(some):
        total[some] = np.add.reduceat(p, first[some])
        most[some] = np.maximum.reduceat(p, first[some])
    return np.stack([most, np.log1p(total), 10 * total / (n + 20.0)], 1)


def fit(texts: pa.Array, toxic: np.ndarray, min_toxic: int = 3, steps: int = 30, min_odds: float = 3.9) -> Tagger:
    """A tagger from whole texts and their labels.

    min_toxic: toxic documents (or a hundredth of them) that a feature needs.
    min_odds: log of how much likelier it is in toxic ones: 3.9 is 50 times,
    more than words that are merely commoner there reach.
    """
    tagger = Tagger()
    if not len(toxic) or toxic.all() or not toxic.any():
        return tagger
    parts = []
    for lo, hi, padded, starts in bt.chunks(texts):
        kinds, first, _, _ = features(padded, starts)
        parts.append((kinds, np.diff(first)))
    length = np.concatenate([n for _, n in parts])
    first = np.append(0, np.cumsum(length))
    row = bt.rows_of(first)
    kinds = [np.concatenate([k[i] for k, _ in parts]) for i in range(1 + len(_PREFIXES))]
    label = np.zeros(len(row), bool)
    found = []
    word = np.append(np.append(np.uint64(0), kinds[0]), np.uint64(0))
    around = bt.mix(bt.mix(word[:-2], 2) + word[2:], 3)
    for h in kinds:
        value, at = np.unique(h, return_inverse=True)
        # Copies of a passage must not make its words look frequent: a feature counts once between the same two words.
        _, once = np.unique(bt.mix(h, 1) ^ around, return_index=True)
        bad = np.bincount(at[once][toxic[row[once]]], minlength=len(value))
        good = np.bincount(at[once][~toxic[row[once]]], minlength=len(value))
        odds = np.log((bad + 0.5) / (bad.sum() + 1.0)) - np.log((good + 0.5) / (good.sum() + 1.0))
        sure = (bad >= max(min_toxic, 0.01 * toxic.sum())) & (odds >= min_odds)
        label |= sure[at] & toxic[row]
        found.append((value, at, bad + good >= min_toxic))
    n, offset = 0, []
    for value, _, keep in found:
        offset.append(n + np.cumsum(keep) - 1)
        n += int(keep.sum())
    index = [np.where(keep[at], o[at], n) for (_, at, keep), o in zip(found, offset)]
    weights, bias, trans = np.zeros(n + 1), -4.0, np.zeros((2, 2))
    y = label.astype(float)
    follows = row[1:] == row[:-1]
    observed = np.zeros((2, 2))
    np.add.at(observed, (label[:-1][follows].astype(int), label[1:][follows].astype(int)), 1)
    memory = [np.full(n + 1, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    for _ in range(steps):
        score = bias + sum(weights[i] for i in index)
        p, pair = marginals(score, first, trans)
        gap = y - p
        grads = [sum(np.bincount(i, gap, minlength=n + 1) for i in index) - 0.05 * weights, gap.sum(), observed - pair]
        grads[0][n] = 0
        memory = [m + g * g for m, g in zip(memory, grads)]
        weights = weights + 0.6 * grads[0] / np.sqrt(memory[0])
        bias = bias + 0.6 * grads[1] / np.sqrt(memory[1])
        trans = trans + 0.3 * grads[2] / np.sqrt(memory[2])
    keys = np.concatenate([v[keep] for v, _, keep in found])
    useful = np.abs(weights[:n]) > WEAK
    order = np.argsort(keys[useful])
    tagger.keys, tagger.weights, tagger.bias, tagger.trans = keys[useful][order], weights[:n][useful][order], float(bias), trans
    p, _ = marginals(tagger.emission(kinds), first, trans)
    x = np.column_stack([np.ones(len(toxic)), evidence(p, first)])
    z = toxic.astype(float)
    balance = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (~toxic).mean())
    layer = np.zeros(x.shape[1])
    for _ in range(200):  # Newton steps of a ridge-penalised logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ layer, -30, 30)))
        grad = x.T @ (balance * (z - q)) - 0.01 * layer
        curve = (x * (balance * q * (1 - q))[:, None]).T @ x + 0.01 * np.eye(len(layer))
        step = np.linalg.solve(curve, grad)
        layer = layer + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    tagger.layer = layer
    return tagger


def _score_batches(shared, text: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            for lo, hi, padded, starts in bt.chunks(batch.column(batch.schema.get_field_index(text))):
                p, first, s, e = tagger.tag(padded, starts)
                row = bt.rows_of(first)
                bad = np.flatnonzero(p >= 0.5)
                # neighbouring bad tokens of a row are one span, in byte offsets of the text
                new = np.append(True, (np.diff(bad) > 1) | (np.diff(row[bad]) > 0))[: len(bad)]
                at = np.flatnonzero(new)
                last = bad[np.append(at[1:] - 1, len(bad) - 1)[: len(at)].astype(np.int64)] if len(bad) else bad
                r = row[bad[at]]
                spans = pa.StructArray.from_arrays([pa.array(s[bad[at]] - starts[r]), pa.array(e[last] - starts[r])], names=["begin", "end"])
                cuts = pa.array(np.searchsorted(r, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in kept] + [pa.array(tagger.score(p, first)), pa.ListArray.from_arrays(cuts, spans)],
                    names=[*kept, "score", "spans"],
                )

    return run


def score_documents(
    docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = 800, threshold: float = 0.7, sample_bytes: int = 1 << 18, text: str = "text", ident: str = "doc_id", keep: list[str] | None = None
) -> DataFrame:
    """doc_id, held_out, the columns in ``keep``, score, predicted, spans (byte
    offsets) of every row.

    labels: (doc_id, toxic); rows of docs where ``held_out`` holds are not
    learnt from. sample bounds the training documents of each class and
    sample_bytes each one's text: longer ones are scored, but not learnt from.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").dropDuplicates(["label_id"])
    known = docs.where(~F.coalesce(held_out, F.lit(False))).select(F.col(ident).alias("id"), F.coalesce(text, F.lit("")).alias("text")).where(F.octet_length("text") <= sample_bytes)
    ids = known.select("id").join(marked, F.col("id") == F.col("label_id"))
    chosen = [ids.where(F.col("toxic") == c).select("id", "toxic").distinct().orderBy(F.xxhash64("id"), "id").limit(sample) for c in (0, 1)]
    few = known.join(F.broadcast(chosen[0].union(chosen[1])), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("id", "text", "toxic").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    tagger = fit(few.column("text").combine_chunks(), few.column("toxic").to_numpy().astype(bool))
    shared = spark.sparkContext.broadcast(tagger)
    extra = [c for c in keep or [] if c not in (ident, "held_out", "score", "spans", "predicted")]
    rows = docs.select(F.col(ident), F.coalesce(held_out, F.lit(False)).alias("held_out"), *[F.col(c) for c in extra], *[F.col(c) for c in [text] if c not in extra])
    kept = [ident, "held_out", *extra]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    out = rows.mapInArrow(_score_batches(shared, text, kept), f"{fields}, score double, spans array<struct<begin:long,end:long>>")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
