"""Bigram language model in a log-frequency Bloom filter.

Method. Unigram and bigram counts are quantised on a roughly geometric scale
and level q is stored by inserting the n-gram with each of 1..q into a Bloom
filter. A count is recovered by probing 1, 2, ... until the first miss; the
probabilities are smoothed from those counts: the bigram estimate is drawn
towards the add-one unigram estimate with ``prior`` pseudo-counts. Every pair is
in the filter, those seen once too, so the counts of a context's pairs add up to
its own and its probabilities to 1, up to the scale's rounding. The prior is
the one of PRIORS under which the training tokens are likeliest when each is
left out of its own counts; held-out texts have no part in it.

At scale. The filter grows with the corpus and nobody holds it whole: it is cut
into segments by hash, each of about ``segment_tokens`` tokens, and every n-gram
is in it at every size. Texts are dealt to groups of about ``group_bytes``. A
group sends the distinct n-grams of its texts, with their training counts, to
their segments; a segment's task adds them up, builds its filter and answers
each group with the levels, in the order asked, and the exact unigram counts of
the base score. The answers meet the group's texts by the number of the group.
Every segment answers every group, so its sums of N and V arrive there too. The
scores under each prior are written to a table, from which the one is read. The
driver gets the size of the texts and a likelihood for each prior; nothing is
broadcast.

Edge cases. A null text is empty and scores its end token alone; a null id is
in the training part; rows with equal ids or equal texts count one by one; an
empty training part gives c = N = V = 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm import bytetext as bt
from turnweave.llm.minhash import binary
from turnweave.llm.runtime import cut, grouped

#: Pseudo-counts that are tried.
PRIORS = tuple(4.0**k for k in range(9))
#: The hash of the end token, which also stands before the first word.
END = np.uint64(0xE7D3C0FFEE15A11D)


def thresholds(ratio: float = 1.2, most: int = 1 << 50) -> np.ndarray:
    """thresholds()[q - 1] is the least count of level q."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, round(out[-1] * ratio)))
    return np.array(out)


LEVELS = thresholds()
#: The count that level q stands for (0 for level 0): the middle of its range.
ESTIMATE = np.append(0.0, np.append((LEVELS[:-1] + LEVELS[1:] - 1) / 2, LEVELS[-1]))


def sequences(padded: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with each row's end token, previous tokens, first)."""
    s, e, first = bt.words(padded, starts)
    words = bt.word_hashes(padded, s, e)
    n = len(first) - 1
    first = first + np.arange(n + 1)
    tokens = np.full(first[-1], END)
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    tokens[inner] = words
    before = np.append(END, tokens[:-1])
    return tokens, before, first


def pair_hash(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return bt.mix(bt.mix(before, 5) ^ tokens, 6)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _whole(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, first, sorted unigram hashes, bigram hashes, sorted bigram hashes) of a
    group's texts; the order of the sorted ones is all that requests and answers share."""
    _, _, padded, starts = next(bt.chunks(table.column("text"), 1 << 62))
    tokens, before, first = sequences(padded, starts)
    pairs = pair_hash(before, tokens)
    return tokens, first, np.unique(bt.mix(tokens, 4)), pairs, np.unique(pairs)


def _size_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, padded, starts in bt.chunks(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array([len(padded)]), pa.array([len(bt.words(padded, starts)[0]) + hi - lo])], names=["bytes", "tokens"])


def _edges(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Where each segment begins in sorted hashes, and their number."""
    segment = ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    return np.searchsorted(segment, np.arange(segments + 1, dtype=np.uint64))


def _request_batches(segments: int):
    """Rows sorted by group to (group, segment, hashes and training counts of the
    group's words and pairs there). Every group has a row for every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["group"]):
            tokens, first, word, pairs, pair = _whole(table)
            learned = table.column("in_training").to_numpy().astype(bool)[bt.rows_of(first)]
            columns = []
            for known, each in ((word, bt.mix(tokens, 4)), (pair, pairs)):
                count = np.bincount(np.searchsorted(known, each[learned]), minlength=len(known)).astype(np.int32)
                cuts = _edges(known, segments)
                n = np.diff(cuts)
                columns += [binary(_planes(_steps(known, cuts), cuts), n * 8), binary(_planes(count, cuts), n * 4)]
            group = pa.array(np.full(segments, table.column("group")[0].as_py()))
            yield pa.RecordBatch.from_arrays([group, pa.array(np.arange(segments, dtype=np.int32)), *columns], names=["group", "segment", "words", "word_counts", "pairs", "pair_counts"])

    return run


def _planes(values: np.ndarray, cuts: np.ndarray) -> bytes:
    """values[cuts[i]:cuts[i + 1]] of each i byte plane by byte plane, which the
    shuffle's compression makes little of where high bytes are 0."""
    return b"".join(values[a:b].view(np.uint8).reshape(b - a, values.itemsize).T.tobytes() for a, b in zip(cuts[:-1], cuts[1:]))


def _from_planes(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(how many values each row has, the values of all rows)."""
    offsets, data = bt.string_parts(column)
    size = np.dtype(kind).itemsize
    parts = [data[a:b].reshape(size, -1).T.tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    return np.diff(offsets) // size, np.frombuffer(b"".join(parts), kind)


def _steps(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sorted hashes as the steps between them, from 0 on in each segment: small numbers."""
    out = np.diff(hashes, prepend=np.uint64(0))
    out[cuts[:-1][np.diff(cuts) > 0]] = hashes[cuts[:-1][np.diff(cuts) > 0]]
    return out


def _from_steps(sizes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    out = np.cumsum(steps, dtype=np.uint64)
    begin = np.cumsum(sizes) - sizes
    before = np.where(begin > 0, out[begin - 1] if len(out) else 0, 0).astype(np.uint64)
    return out - np.repeat(before, sizes)


def _answer_batches(bits: int):
    """Requests sorted by segment to (group, segment, exact word counts, levels that
    the segment's filter tells of the words and pairs, the segment's N and V)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["segment"]):
            asked = []
            for name in ("word", "pair"):
                sizes, steps = _from_planes(table.column(f"{name}s"), np.uint64)
                hashes = _from_steps(sizes, steps)
                known, at = np.unique(hashes, return_inverse=True)
                total = np.bincount(at, _from_planes(table.column(f"{name}_counts"), np.int32)[1], len(known)).astype(np.int64)
                asked.append((sizes, known, at, total, np.searchsorted(LEVELS, total, "right")))
            model = Filter.build(np.concatenate([x[1] for x in asked]), np.concatenate([x[4] for x in asked]), bits)
            (n_words, word, at, total, _), (n_pairs, pair, pair_at, _, _) = asked
            told = [binary(_planes(total[at], np.append(0, np.cumsum(n_words))), n_words * 8)]
            told += [binary(model.levels(x).astype(np.uint8)[i].tobytes(), n) for x, i, n in ((word, at, n_words), (pair, pair_at, n_pairs))]
            told += [pa.array(np.full(table.num_rows, x, np.int64)) for x in (total.sum(), (total > 0).sum())]
            yield pa.RecordBatch.from_arrays(
                [table.column("group").combine_chunks(), table.column("segment").combine_chunks(), *told], names=["group", "segment", "counts", "levels", "pair_levels", "tokens", "distinct"]
            )

    return run


class Filter:
    """A Bloom filter of (n-gram, level) with all bits of an entry in one word.

    Segment s of the hash range owns words[offsets[s]:offsets[s + 1]].
    """

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        self.words, self.offsets = words, offsets

    @classmethod
    def build(cls, hashes: np.ndarray, level: np.ndarray, bits: int) -> Filter:
        """One segment's filter. Unigrams and bigrams share its words; their
        hashes are seeded apart."""
        words = np.zeros(-(-int(level.sum()) * bits // 64), np.uint64)
        for q in range(1, int(level.max(initial=0)) + 1):
            place, mask = cls.place(hashes[level >= q], q, np.uint64(len(words)))
            np.bitwise_or.at(words, place.astype(np.int64), mask)
        return cls(words, np.array([0, len(words)]))

    @staticmethod
    def place(hashes: np.ndarray, level: int | np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word within the segment, bit mask) of the entries."""
        h = bt.mix(hashes ^ (np.asarray(level).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), 8)
        mask = np.zeros(len(h), np.uint64)
        for j in range(5):
            mask |= np.uint64(1) << ((h >> np.uint64(6 * j)) & np.uint64(63))
        return ((h >> np.uint64(32)) * sizes) >> np.uint64(32), mask

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram: repeated probes until the first miss."""
        segment = (((hashes >> np.uint64(32)) * np.uint64(len(self.offsets) - 1)) >> np.uint64(32)).astype(np.int64)
        start, size = self.offsets[segment], np.diff(self.offsets)[segment].astype(np.uint64)
        out = np.zeros(len(hashes), np.int64)
        live = np.flatnonzero(size > 0)
        for level in range(1, len(LEVELS) + 1):
            if not len(live):
                break
            word, mask = self.place(hashes[live], level, size[live])
            live = live[(self.words[start[live] + word.astype(np.int64)] & mask) == mask]
            out[live] = level
        return out


def _likelihood(joint: np.ndarray, context: np.ndarray, alone: np.ndarray, prior: float) -> np.ndarray:
    """log10 of a token's probability from the counts of its pair and of its
    context and the unigram estimate."""
    return np.log10((np.minimum(joint, context) + prior * alone) / (context + prior))


def _scores(priors: tuple[float, ...]):
    """A group's rows and the answers to it to the rows of score_texts, with a
    score and a left-out likelihood for each prior."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("segment")
        tokens, first, word, pairs, pair = _whole(rows)
        counts, own, both = (_from_planes(answers.column(c), kind)[1] for c, kind in (("counts", np.int64), ("levels", np.uint8), ("pair_levels", np.uint8)))
        if len(counts) != len(word) or len(both) != len(pair):
            raise RuntimeError("the rows of a group changed between its requests and the answers: docs is not repeatable")
        total, distinct = (int(np.sum(answers.column(c).to_numpy())) for c in ("tokens", "distinct"))
        own, both = ESTIMATE[own], ESTIMATE[both]
        at = np.searchsorted(word, bt.mix(tokens, 4))
        end = own[at[-1]]  # the last token of a text is END
        own, both = own[at], both[np.searchsorted(pair, pairs)]
        context = np.append(end, own[:-1])
        context[first[:-1]] = end
        base = np.log10(counts + 1.0) - math.log10(total + distinct + 1)
        cuts, n = first[:-1], len(first) - 1
        learned = rows.column("in_training").to_numpy().astype(bool)
        seen = learned[bt.rows_of(first)]
        less = [np.maximum(x[seen] - 1.0, 0.0) for x in (both, context, own)]
        scores = np.stack([np.add.reduceat(_likelihood(both, context, (own + 1.0) / (total + distinct + 1.0), prior), cuts) for prior in priors], 1)
        left_out = [_likelihood(less[0], less[1], (less[2] + 1.0) / (total + distinct + 1.0), prior).sum() for prior in priors] if len(priors) > 1 else [0.0]
        shares = np.zeros((n, len(priors)))
        shares[0] = left_out  # the group's sum stands in its first row
        several = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(priors)).cast(pa.list_(pa.float64()))
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "held_out": pa.array(~learned),
                "n_tokens": pa.array(np.diff(first)),
                "n_known": pa.array(np.add.reduceat((counts > 0)[at].astype(np.int64), cuts)),
                "train_tokens": pa.array(np.full(n, total)),
                "base_score": pa.array(np.add.reduceat(base[at], cuts)),
                "scores": several(scores),
                "left_out": several(shares),
            }
        )

    return run


def score_texts(
    docs: DataFrame,
    training: Column,
    prior: float | None = None,
    max_filter_bytes: int = 32 << 20,
    segment_tokens: int = 2_000_000,
    bits_per_entry: int = 16,
    text: str = "text",
    ident: str = "doc_id",
    group_bytes: int = 8 << 20,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every row; the model learns from the rows where ``training`` holds.

    prior: pseudo-counts of the unigram estimate in each context; by default
    fitted to the training rows.
    max_filter_bytes: of one segment's filter; more n-grams make more segments.
    """
    rows = docs.select(F.col(ident).alias("doc_id"), F.coalesce(training, F.lit(True)).alias("in_training"), F.coalesce(text, F.lit("")).alias("text"))
    sizes = rows.select("text").mapInArrow(_size_batches, "bytes long, tokens long")
    size, tokens = sizes.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "tokens"))).first()
    # an n-gram's level is at most its count, so a token makes two entries at most
    segments = 1 + max(tokens // segment_tokens, 2 * tokens * bits_per_entry // (8 * max_filter_bytes))
    groups = 1 + size // group_bytes
    # the partition's number parts rows of equal id and text, and does not depend on the order of rows
    group = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(groups))
    dealt = rows.withColumn("group", group).repartition(1 + groups // 2, "group")
    requests = dealt.sortWithinPartitions("group").mapInArrow(_request_batches(segments), "group long, segment int, words binary, word_counts binary, pairs binary, pair_counts binary")
    answers = (
        requests.repartitionById(segments, "segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_answer_batches(bits_per_entry), "group long, segment int, counts binary, levels binary, pair_levels binary, tokens long, distinct long")
    )
    kind = docs.schema[ident].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, scores array<double>, left_out array<double>"
    priors = PRIORS if prior is None else (prior,)
    out = cut(dealt.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(_scores(priors), schema))
    sums = out.agg(*(F.coalesce(F.sum(F.get("left_out", F.lit(k))), F.lit(0.0)) for k in range(len(priors)))).first()
    return out.withColumn("score", F.get("scores", F.lit(max(range(len(priors)), key=lambda k: sums[k])))).drop("scores", "left_out")
