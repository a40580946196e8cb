"""Repeated passages: q-gram buckets refined by the buckets of later offsets.

Removes each byte covered by a string of ``length`` bytes (400) that starts at
two or more places of the corpus.

Method. Bucket-pointer refinement on sampled suffixes. Of each ``w`` consecutive
q-grams of a text the one of least hash is an anchor; anchors with equal q-grams
are the initial buckets, and buckets of one member are closed at once. The
others are refined by doubling: the bucket of an anchor at level k + 1 is its
bucket at level k, the distance to the anchor 2**k further on, and that anchor's
bucket at level k; each level reuses the last one's. Two overlapping buckets of
a level name any run of anchors. A window belongs to its first anchor. Its core
is the run of anchors that every such window holds, its cover the run that
reaches around all of them: windows whose cover has a second member are settled
(they repeat), those whose core has none are closed. What stays open lies at the
edges of repeats, where no cover reaches. It is refined to blocks of up to 16
windows and then to single windows, by the bytes they span, next to one member
of each settled bucket that shares an open core.

At scale. Each round counts buckets by aggregates with map-side partials and
keeps only what is still open, so a passage that every document has is no hot
key and no bucket is ever gathered in a task. Only the anchors of one text meet
in a task. Texts are bucketed by their keys once, so that the
later rounds, which read them again, move only the lists of what is open;
tables that are done with are deleted. Memory
is bounded by a chunk of texts (one text, if it is longer). Names are 64-bit
hashes: of n of them, n * n / 2**65 pairs are expected to collide.

Edge cases. A null text is empty. Texts shorter than ``length`` lose nothing.
Rows with equal ids, equal texts or null ids count one by one: two equal rows
repeat each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm import bytetext as bt
from turnweave.llm.runtime import bucketed, cut, discard

_BLOCK = 16
#: Bits of a place in a text, in the packed values of which an anchor is the least.
_PLACE = np.uint64(31)
_MASK = np.uint64((1 << 31) - 1)


def spacing(length: int, q: int) -> int:
    """w: no more than q, so that the q-grams of neighbouring anchors meet, and
    so few that each window holds all the runs that its first anchor can need."""
    return min(q, (length - q + 2) // 2)


def anchors(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """(span, at, lo, hi, top, name) of the anchors of the spans data[begin:end].

    lo..hi are the starts of the runs of w q-grams of which the one at ``at`` is
    the least (the leftmost of equal ones); runs of neighbours are neighbours.
    top is the last window of ``length`` bytes among them, lo - 1 if there is none.
    """
    w = spacing(length, q)
    n = max(0, len(prefix) - q)
    low = ((bt.span_hash(prefix, np.arange(n), np.arange(q, n + q)) >> _PLACE) << _PLACE) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < w and len(low) > 1:
        step = min(width, w - width)
        low = np.minimum(low[: max(0, len(low) - step)], low[step:])
        width += step
    span = np.flatnonzero(end - begin >= length)
    size = end[span] - begin[span] - q - w + 2
    owner = np.repeat(span, size)
    start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[owner]
    at = (low[start] & _MASK).astype(np.int64)
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))[: len(at)])
    last = np.append(first[1:], len(at))[: len(first)] - 1
    owner, at, lo, hi = owner[first], at[first], start[first], start[last]
    top = np.maximum(np.minimum(hi, end[owner] - length), lo - 1)
    return owner, at, lo, hi, top, bt.span_hash(prefix, at, at + q)


def _rows(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi, padded, starts in bt.chunks(batch.column(text)):
        yield lo, hi, padded, starts, bt.prefix_hash(padded)


def _hull(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Names of the bytes that the windows lo..hi span, told apart by their distances from at."""
    return bt.mix(bt.span_hash(prefix, lo, hi + length) ^ ((at - lo) * 4096 + (at - hi)).astype(np.uint64), 32)


_WIDTH = 10


def _packed(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: np.ndarray) -> np.ndarray:
    return (at << 3 * _WIDTH) | ((at - lo) << 2 * _WIDTH) | ((at - hi) << _WIDTH) | (hi - top)


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, ...]:
    part = lambda k: (place >> (k * _WIDTH)) & ((1 << _WIDTH) - 1)
    at = place >> 3 * _WIDTH
    return at, at - part(2), at - part(1), at - part(1) - part(0)


def _anchor_batches(length: int, q: int, within: int | None):
    """(k1, k2, text[, open]) to anchors (name, k1, k2, part, place). With
    ``within`` only inside the spans of windows of that length in ``open``, each
    a part that begins at ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for first, last, _, starts, prefix in _rows(batch, 2):
                row, begin, end = np.arange(last - first), starts[:-1], starts[1:] - 1
                if within:
                    row, (lo, hi) = _lists(batch.column(3).slice(first, last - first), ["lo", "hi"])
                    row, lo, hi = _merged(row, lo, hi)
                    begin, end = starts[row] + lo, starts[row] + hi + within
                span, at, lo, hi, top, name = anchors(prefix, begin, end, length, q)
                row = row[span]
                own = starts[row]
                place = _packed(at - own, lo - own, hi - own, top - own)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(keys[0][first + row]), pa.array(keys[1][first + row]), pa.array((begin[span] - own).astype(np.int32)), pa.array(place)], names=["name", "k1", "k2", "part", "place"])

    return run


def _merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges lo..hi of each row, where neighbours and overlaps are one range."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order].astype(np.int64), lo[order].astype(np.int64), hi[order].astype(np.int64)
    base = row << 32  # keeps the running maximum inside a row
    reach = np.maximum.accumulate(base + hi)
    first = np.flatnonzero(np.append(True, (base + lo)[1:] > reach[:-1] + 1))
    last = np.append(first[1:], len(row)) - 1
    return row[first], lo[first], reach[last] - base[last]


def _refined(text: np.ndarray, place: np.ndarray, name: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """(anchor, at, lo, top, core, cover) of the anchors that windows belong to,
    from anchors in order of text and place. Anchors whose core is closed are
    left out; a cover that is closed or missing is 0."""
    at, lo, hi, top = _unpacked(place)
    n = len(at)
    w = spacing(length, q)
    linked = np.append((text[1:] == text[:-1]) & (lo[1:] == hi[:-1] + 1), False)
    chain = np.cumsum(np.append(0, ~linked[:-1]))
    end = np.append(np.flatnonzero(~linked), n)[chain]  # the last anchor of each one's chain
    first = np.append(0, np.flatnonzero(~linked)[:-1] + 1)[chain] if n else end
    wide = (chain.astype(np.int64) << 33) + (1 << 32)
    own = np.flatnonzero(top >= lo)
    # the run whose start is where the last window that the anchor owns begins to need one
    target = at[own] + (length - q - w + 1) - (w - 1)
    last = np.searchsorted(wide + hi, wide[own] + target)
    own, last = own[last <= end[own]], last[last <= end[own]]
    before = np.searchsorted(wide + at, wide[own] + lo[own], "right") - 1
    after = np.searchsorted(wide + at + q, wide[own] + top[own] + length)
    good = (before >= first[own]) & (after <= end[own])
    # levels of the refinement: level k names the runs of 2**k anchors
    longest = int(max((last - own).max(initial=0), (after - before)[good].max(initial=0))) + 1
    levels = [name]
    while 1 << len(levels) <= longest:
        step, was = 1 << (len(levels) - 1), levels[-1]
        later = np.minimum(np.arange(n) + step, n - 1)
        levels.append(bt.mix(bt.mix(was, 41) + bt.mix(was[later], 42) + (at[later] - at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 43))
    table = np.stack(levels)

    def runs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.frexp((j - i + 1).astype(float))[1] - 1
        return bt.mix(bt.mix(table[level, i], 44) + bt.mix(table[level, j - (1 << level) + 1], 45) + (at[j] - at[i]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 46)

    core = runs(own, last)
    cover = np.zeros(len(own), np.uint64)
    i = own[good]
    shape = ((at[i] - lo[i]) * 4096 + (at[i] - top[i])).astype(np.uint64)
    cover[good] = bt.mix(runs(before[good], after[good]) ^ (at[i] - at[before[good]]).astype(np.uint64) ^ (shape << np.uint64(20)), 47) | np.uint64(1)
    return own, at[own], lo[own], top[own], core, cover


def _refine_batches(length: int, q: int):
    """Anchors (k1, k2, part, place, name, weight) that come in order, whole texts
    together, to the units (name, hull, k1, k2, at, lo, hi, weight) of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def units(k1, k2, part, place, name, weight):
            text = np.cumsum(np.append(0, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (part[1:] != part[:-1])))[: len(k1)]
            i, at, lo, hi, core, cover = _refined(text, place, name.view(np.uint64), length, q)
            alone = bt.mix(bt.mix(k1[i].view(np.uint64), 51) ^ k2[i].astype(np.uint64) ^ (lo.astype(np.uint64) << np.uint64(32)), 52) & ~np.uint64(1)
            hull = np.where(cover > 0, cover, alone)
            return pa.RecordBatch.from_arrays(
                [pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)), pa.array(k1[i]), pa.array(k2[i])] + [pa.array(x.astype(np.int32)) for x in (at, lo, hi, weight[i])],
                names=["name", "hull", "k1", "k2", "at", "lo", "hi", "weight"],
            )

        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(6)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            k1, k2 = held[0], held[1]
            # all but the last text are complete
            done = len(k1) and int(np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))[-1])
            if done:
                yield units(*(x[:done] for x in held))
                held = [x[done:] for x in held]
        if held is not None and len(held[0]):
            yield units(*held)

    return run


def _lists(column: pa.Array, fields: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))), [flat.field(f).to_numpy() for f in fields]


def _block_batches(length: int):
    """(k1, k2, text, open) to the blocks (name, hull, k1, k2, at, lo, hi, weight) of the open positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for first, last, _, starts, prefix in _rows(batch, 2):
                row, (at, lo, hi, weight) = _lists(batch.column(3).slice(first, last - first), ["at", "lo", "hi", "weight"])
                # distances at - window, in blocks of _BLOCK
                low, high = (at - hi) // _BLOCK, (at - lo) // _BLOCK
                per = high - low + 1
                i = np.repeat(np.arange(len(row)), per)
                k = np.arange(len(i)) - np.repeat(np.append(0, np.cumsum(per)[:-1]), per)[: len(i)] + low[i]
                base = starts[row[i]] + at[i] - k * _BLOCK
                # all windows of the block have base ... base - _BLOCK + length in common
                core = bt.mix(bt.span_hash(prefix, base, base - _BLOCK + 1 + length) + k.astype(np.uint64), 31)
                begin = np.maximum(starts[row[i]] + lo[i], base - _BLOCK + 1)
                end = np.minimum(starts[row[i]] + hi[i], base)
                hull = _hull(prefix, begin, end, starts[row[i]] + at[i], length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)), pa.array(keys[0][first + row[i]]), pa.array(keys[1][first + row[i]])]
                    + [pa.array(x.astype(np.int32)) for x in (at[i], begin - starts[row[i]], end - starts[row[i]], weight[i])],
                    names=["name", "hull", "k1", "k2", "at", "lo", "hi", "weight"],
                )

    return run


def _window_batches(length: int):
    """(k1, k2, text, open) to single windows (name, k1, k2, lo, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for first, last, _, starts, prefix in _rows(batch, 2):
                row, (lo, hi, weight) = _lists(batch.column(3).slice(first, last - first), ["lo", "hi", "weight"])
                per = hi - lo + 1
                i = np.repeat(np.arange(len(row)), per)
                at = np.arange(len(i)) - np.repeat(np.append(0, np.cumsum(per)[:-1]), per)[: len(i)] + lo[i]
                begin = starts[row[i]] + at
                name = bt.span_hash(prefix, begin, begin + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(keys[0][first + row[i]]), pa.array(keys[1][first + row[i]]), pa.array(at.astype(np.int32)), pa.array(weight[i].astype(np.int32))],
                    names=["name", "k1", "k2", "lo", "weight"],
                )

    return run


def _removal_batches(length: int, passage: int, kept: list[str]):
    """Batches with text, open (windows of length) and passages (windows of
    passage) to the columns kept, the report, and what is left of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            offsets, data = bt.string_parts(column("text"))
            gone = {}
            for name, size in (("open", length), ("passages", passage)):
                row, (lo, hi) = _lists(column(name), ["lo", "hi"])
                row, lo, hi = _merged(row, lo, hi)
                gone[name] = _merged(row, lo, hi + size - 1)
            row, begin, end = gone["open"]
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            long = np.bincount(gone["passages"][0], gone["passages"][2] - gone["passages"][1] + 1, batch.num_rows)
            out = [[], [], [], [], []]
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]].tobytes()
                edges = [0]
                for k in range(cuts[i], cuts[i + 1]):
                    edges += [int(begin[k]), int(end[k]) + 1]
                edges.append(len(own))
                left = b"".join(own[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                for values, value in zip(out, (len(own), len(own) - len(left), int(cuts[i + 1] - cuts[i]), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"))):
                    values.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [column(c) for c in kept] + [pa.array(x, kind) for x, kind in zip(out, kinds)] + [pa.array(long.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_passage_bytes"])

    return run


def _by_text(df: DataFrame, *fields: str) -> DataFrame:
    """One row per text: the list of its open positions."""
    return cut(df.groupBy("k1", "k2").agg(F.collect_set(F.struct(*fields)).alias("open")))


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(settled ranges, open members with weights) of the buckets ``name``, and the tables behind them."""
    alike = cut(rows.groupBy("name", "hull").agg(F.sum("weight").alias("n"), F.min(F.struct("k1", "k2", "at", "lo", "hi")).alias("one")))
    mixed = cut(alike.groupBy("name").agg(F.sum("n").alias("members"), F.min("n").alias("least")).where("members > 1 and least = 1").select("name"))
    settled = rows.join(alike.where("n > 1").select("name", "hull"), ["name", "hull"], "left_semi").select("k1", "k2", "lo", "hi")
    return settled, alike.join(mixed, "name", "left_semi").select("one.*", F.least("n", F.lit(2)).cast("int").alias("weight")), [alike, mixed]


def repeated_windows(rows: DataFrame, length: int, q: int, within: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(k1, k2, open) of rows(k1, k2, text): for each text the ranges lo..hi of
    the starts of its repeated windows. within: the answer for a lesser length,
    and that length; only what repeats there is looked at."""
    if not 0 < q <= length or spacing(length, q) >= 1 << _WIDTH:
        raise ValueError(f"q must be positive, at most length, and at most {1 << _WIDTH} or near length")
    rows = rows.select("k1", "k2", "text")
    names = "name long, hull long, k1 long, k2 long, at int, lo int, hi int, weight int"
    with_open = lambda open_: rows.join(open_.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "open")
    source = rows if within is None else with_open(within[0])
    found = cut(source.mapInArrow(_anchor_batches(length, q, within and within[1]), "name long, k1 long, k2 long, part int, place long"))
    many = cut(found.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"))
    key = ["k1", "k2", "part", "place"]
    left = found.join(many, "name", "left_semi").groupBy(*key).agg(F.min("name").alias("name"), F.least(F.count("*"), F.lit(2)).cast("int").alias("weight"))
    units = cut(left.repartition("k1", "k2").sortWithinPartitions(*key).mapInArrow(_refine_batches(length, q), names))
    discard(found, many)
    first, edges, used = _settle(units)
    open_ = _by_text(edges, "at", "lo", "hi", "weight")
    blocks = cut(with_open(open_).mapInArrow(_block_batches(length), names))
    second, edges, used_again = _settle(blocks)
    edges = _by_text(edges, "lo", "hi", "weight")
    windows = cut(with_open(edges).mapInArrow(_window_batches(length), "name long, k1 long, k2 long, lo int, weight int"))
    again = windows.groupBy("name").agg(F.sum("weight").alias("n")).where("n > 1").select("name")
    third = windows.where("weight = 1").join(again, "name", "left_semi").select("k1", "k2", "lo", F.col("lo").alias("hi"))
    out = _by_text(first.unionByName(second).unionByName(third), "lo", "hi")
    discard(units, open_, *used, blocks, edges, *used_again, windows)
    return out


def remove_repeats(
    docs: DataFrame, length: int = 400, q: int | None = None, passage: int | None = None, text: str = "text", ident: str = "doc_id", keep: list[str | Column] | None = None
) -> DataFrame:
    """doc_id, the columns in ``keep`` (of other names), n_bytes, n_removed,
    n_spans, kept_sha256 (of the bytes left), kept (the bytes left as text,
    without characters that a cut broke) and n_passage_bytes of every row.

    passage: a length of at most ``length``; n_passage_bytes counts the bytes
    that repeated strings of that many bytes cover (not removed if shorter than
    ``length``). q is by default a third of the length.
    """
    passage = length if passage is None else passage
    if passage > length:
        raise ValueError("passage must not be longer than length")
    extra = list(keep or [])
    keys = [F.xxhash64(F.col(ident), F.coalesce(text, F.lit(""))).alias("k1"), F.hash(F.coalesce(text, F.lit(""))).cast("long").alias("k2")]
    rows = bucketed(docs.select(F.col(ident).alias("doc_id"), *extra, *keys, F.coalesce(text, F.lit("")).alias("text")), "k1", "k2")
    found = repeated_windows(rows, passage, q if q and passage == length else -(-(passage + 2) // 3))
    if passage == length:
        found = found.withColumn("passages", F.col("open"))
    else:
        longer = repeated_windows(rows, length, q or -(-(length + 2) // 3), (found, passage))
        found = found.withColumnRenamed("open", "passages").join(longer, ["k1", "k2"], "left")
    kept = ["doc_id", *rows.columns[1 : 1 + len(extra)]]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    schema += ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, n_passage_bytes long"
    return rows.join(found.hint("shuffle_hash"), ["k1", "k2"], "left").select(*kept, "text", "open", "passages").mapInArrow(_removal_batches(length, passage, kept), schema)
