"""Circulant MinHash: near-duplicate groups with exact Jaccard verification.

Method. Shingles (runs of ``width`` words, A-Z folded) are hashed to 64 bits.
Two bijections on 64-bit integers play the two permutations of circulant
MinHash: the first scatters the shingles, the second is applied after a
circular shift by k, and coordinate k of the signature is the least value of
shift k. ``bands`` bands of ``rows`` coordinates are the LSH keys; whatever
pairs they propose is confirmed on the full shingle sets.

At scale. Texts with equal word sequences are one node from the start, so
copies cost nothing later. A bucket never emits its pairs: round 1 compares
each member with the bucket's most connected member only (a star). Round 2 takes the members that their hub did not confirm and
compares them with all members of that hub's group, in blocks of bounded size
spread over tasks, so every pair of a bucket is confirmed, refuted, or joined
through the hub. No round emits a pair that is not a link. Full sets travel for
the members of such groups only.

A link of Jaccard j is missed when no band agrees, (1 - j**rows)**bands: 5e-8
at 0.8 with the defaults, or when its sketch is under ``sketch_floor``: the
binomial tail of 128 coordinates, under 1e-13 at 0.8 (1.4e-6 with a floor of 0.62).

Edge cases. Null or empty texts and texts without a word have an empty set:
they link with nothing and are kept. Fewer than ``width`` words make one
shingle of the whole sequence. Rows with equal ids count one by one. A null id
takes part by its text but never names a component; a group of null ids only
has a null component and is kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm import bytetext as bt
from turnweave.llm.graph import components
from turnweave.llm.runtime import cut, discard, grouped, small

_SHIFT = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xD6E8FEB86659FD93)
_M64 = (1 << 64) - 1
_BLOCK = 4096


def shingles(padded: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, first word of each row, words."""
    s, e, first = bt.words(padded, starts)
    tokens = bt.word_hashes(padded, s, e)
    row = bt.rows_of(first)
    grams = bt.gram_hashes(tokens, width)
    whole = np.flatnonzero(row[: len(grams)] == row[width - 1 :]) if len(grams) else np.zeros(0, np.int64)
    at, value = [row[whole]], [grams[whole]]
    count = np.diff(first)
    for n in range(1, width):
        few = np.flatnonzero(count == n)
        if len(few):
            at.append(few)
            value.append(bt.gram_hashes(tokens, n)[first[few]])
    row_of, hashed, _ = bt.distinct_per_row(np.concatenate(at), np.concatenate(value))
    return row_of, hashed, first, tokens


def signatures(hashed: np.ndarray, cuts: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant signatures, one row per run hashed[cuts[i]:cuts[i+1]] (none empty)."""
    out = np.full((len(cuts) - 1, coordinates), _M64, np.uint64)
    if not len(out):
        return out
    base = bt.mix(hashed, 11)
    base *= _ODD  # the second permutation starts with a product, which turns the shift into another addition
    for at in range(0, len(base), _BLOCK):
        x = base[at : at + _BLOCK]
        lo = int(np.searchsorted(cuts, at, "right")) - 1
        hi = int(np.searchsorted(cuts, at + len(x), "left"))
        local = np.maximum(cuts[lo:hi] - at, 0)
        y, t = np.empty_like(x), np.empty_like(x)
        for k in range(coordinates):
            np.add(x, np.uint64((k * _SHIFT * int(_ODD)) & _M64), out=y)
            np.right_shift(y, np.uint64(32), out=t)
            np.bitwise_xor(y, t, out=y)
            np.multiply(y, _ODD, out=y)
            np.minimum(out[lo:hi, k], np.minimum.reduceat(y, local), out=out[lo:hi, k])
    return out


def _sequence_keys(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of each row's word sequence."""
    n = np.diff(first)
    out = np.zeros((len(n), 2), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        place = np.arange(len(tokens)) - np.repeat(first[:-1], n)
        weight = bt.mix(place.astype(np.uint64), 3)
        for j in range(2):
            out[some, j] = bt.mix(np.add.reduceat(bt.mix(tokens ^ weight, 17 + j), first[some]))
    return out


def _sketch_batches(width: int, bands: int, rows: int, text: str, ident: str, passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ident))
            for lo, hi, padded, starts in bt.chunks(batch.column(batch.schema.get_field_index(text))):
                row, hashed, first, tokens = shingles(padded, starts, width)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                size = np.diff(cuts)
                some = np.flatnonzero(size)
                sig = signatures(hashed, np.append(cuts[some], len(hashed)), bands * rows)
                keys = np.ascontiguousarray(_sequence_keys(tokens, first))
                sketch = np.ascontiguousarray((sig >> np.uint64(56)).astype(np.uint8))
                band = np.zeros((len(some), bands), np.uint64)
                for j in range(rows):
                    band = bt.mix(band ^ sig[:, j::rows], j)
                band ^= np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(_SHIFT)
                where = np.full(hi - lo, -1)
                where[some] = np.arange(len(some))
                n_band = np.where(where >= 0, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(size.astype(np.int64)),
                        binary(keys.tobytes(), np.full(hi - lo, 16)),
                        binary(sketch.tobytes(), np.where(where >= 0, bands * rows, 0)),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_band)).astype(np.int32)), pa.array(band.view(np.int64).ravel())),
                        *(c.slice(lo, hi - lo) for c in batch.columns[2:]),
                    ],
                    names=["doc_id", "n_shingles", "node", "sketch", "bands", *passed],
                )

    return run


def binary(data: bytes, lengths: np.ndarray) -> pa.Array:
    """A binary column over the concatenated values."""
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def sketches(docs: DataFrame, width: int = 4, bands: int = 32, rows: int = 4, text: str = "text", ident: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_shingles, node (key of the word sequence), sketch (a byte per
    coordinate), bands (LSH keys) of every document, and keep's columns."""
    kind = docs.schema[ident].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, node binary, sketch binary, bands array<long>"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep or [])
    return docs.select(F.col(ident), F.col(text), *(keep or [])).mapInArrow(_sketch_batches(width, bands, rows, text, ident, keep or []), schema)


def _set_batches(width: int):
    """Batches of (text) to (node, members: the sorted shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, padded, starts in bt.chunks(batch.column(0)):
                row, hashed, first, tokens = shingles(padded, starts, width)
                size = np.bincount(row, minlength=hi - lo) if len(row) else np.zeros(hi - lo, np.int64)
                keys = np.ascontiguousarray(_sequence_keys(tokens, first))
                yield pa.RecordBatch.from_arrays([binary(keys.tobytes(), np.full(hi - lo, 16)), binary(hashed.tobytes(), size * 8)], names=["node", "members"])

    return run


def _compare(rows: DataFrame, sets: DataFrame, percent: int, floor: float) -> DataFrame:
    """Confirmed links (hub, a, b) between side 0 and side 1 of each (hub, i, j)."""
    dealt = rows.join(sets, "node").select("hub", "i", "j", "side", "node", "sketch", "members")
    dealt = dealt.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "side")
    return dealt.mapInArrow(_compare_batches(percent, floor), "hub binary, a binary, b binary")


def _links(left: pa.Table, right: pa.Table, percent: int, floor: float) -> tuple[list[int], list[int]]:
    """Index pairs of the confirmed links between two blocks of members."""
    lo, ld = bt.string_parts(left.column("members"))
    ro, rd = bt.string_parts(right.column("members"))
    ln, rn = np.diff(lo) // 8, np.diff(ro) // 8
    ls = bt.string_parts(left.column("sketch"))[1].reshape(left.num_rows, -1)
    rs = bt.string_parts(right.column("sketch"))[1].reshape(right.num_rows, -1)
    lv, rv = np.frombuffer(ld.tobytes(), np.uint64), np.frombuffer(rd.tobytes(), np.uint64)
    lo, ro = lo // 8, ro // 8
    out: tuple[list[int], list[int]] = ([], [])
    for i in range(len(ln)):
        near = np.flatnonzero((100 * np.minimum(rn, ln[i]) >= percent * np.maximum(rn, ln[i])) & ((rs == ls[i]).mean(1) >= floor))
        own = lv[lo[i] : lo[i + 1]]
        for at in range(0, len(near), 256):
            some = near[at : at + 256]
            values = np.concatenate([rv[ro[j] : ro[j + 1]] for j in some])
            found = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
            both = np.add.reduceat(found.astype(np.int64), np.append(0, np.cumsum(rn[some])[:-1]))
            for j in some[100 * both >= percent * (ln[i] + rn[some] - both)]:
                out[0].append(i)
                out[1].append(int(j))
    return out


def _compare_batches(percent: int, floor: float):
    """Sorted rows (hub, i, j, side, node, sketch, members) to links (hub, a, b): side 0 against side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["hub", "i", "j"]):
            side = table.column("side").to_numpy()
            cut_at = int(np.searchsorted(side, 1))
            left, right = table.slice(0, cut_at).combine_chunks(), table.slice(cut_at).combine_chunks()
            if not left.num_rows or not right.num_rows:
                continue
            a, b = _links(left, right, percent, floor)
            hub = table.column("hub")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([hub] * len(a), pa.binary()), left.column("node").combine_chunks().take(pa.array(a, pa.int64())), right.column("node").combine_chunks().take(pa.array(b, pa.int64()))],
                names=["hub", "a", "b"],
            )

    return run


def near_duplicates(
    docs: DataFrame,
    width: int = 4,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
    sketch_floor: float = 0.5,
    block_shingles: int = 1 << 19,
    text: str = "text",
    ident: str = "doc_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links (a lower bound: the
    links of the row's distinct text that the rounds compared; members that both
    link to their hub are not compared) for each row of docs; with keep also its columns and
    near_group, which rows of one component share whatever their ids (null for
    rows without a word).

    component_id is the least id reachable over links of 100 * |A and B| >=
    percent * |A or B|; kept marks the row that names its component.
    block_shingles bounds the sets that one task of round 2 holds.
    """
    sketch = cut(sketches(docs, width, bands, rows, text, ident, keep))
    nodes = cut(
        sketch.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")).where("n > 0")
    )
    keyed = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(shared)
    member = cut(keyed.join(small(shared, 24), "band"))
    degree = member.groupBy("node").agg(F.sum(F.col("size") - 1).alias("degree"))
    ranked = member.join(degree, "node")
    hub = ranked.groupBy("band").agg(F.max(F.struct("degree", "node", "n")).alias("top")).select("band", F.col("top.node").alias("hub"), F.col("top.n").alias("hub_n"))
    #: Every member once per hub; those too unlike the hub in size stay, for round 2.
    group = cut(member.join(hub, "band").where("node <> hub").select("hub", "node", "n").distinct())
    needed = cut(group.select("node").union(group.select(F.col("hub").alias("node"))).distinct())
    source = docs.select(F.col(ident).alias("low"), F.col(text).alias("text"))
    chosen = cut(nodes.join(small(needed, 40), "node").select("node", "low", "n", "sketch"))
    texts = source.join(small(chosen.select("low").distinct(), 24), "low", "left_semi").select("text")
    if not chosen.where("low is null").isEmpty():
        texts = texts.union(source.where("low is null").select("text"))
    sets = texts.mapInArrow(_set_batches(width), "node binary, members binary").dropDuplicates(["node"])
    sets = cut(sets.join(chosen.select("node", "sketch"), "node"))
    size = cut(group.groupBy("hub").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("nj")))
    star = group.join(size, "hub").select("hub", F.lit(0).alias("i"), F.pmod(F.xxhash64("node"), F.col("nj")).cast("int").alias("j"), F.lit(1).alias("side"), "node")
    centre = size.select("hub", F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(0).alias("side"), F.col("hub").alias("node"))
    first = cut(_compare(star.unionByName(centre), sets, percent, sketch_floor))
    linked = first.select("hub", F.col("b").alias("node"), F.lit(True).alias("linked"))
    apart = cut(group.join(linked, ["hub", "node"], "left").select("hub", "node", "n", F.col("linked").isNull().alias("rest")))
    total = cut(apart.groupBy("hub").agg(
        F.ceil(F.sum("n") / block_shingles).alias("nj"), F.ceil(F.sum(F.when(F.col("rest"), F.col("n"))) / block_shingles).alias("ni"), F.count_if("rest").alias("n_rest"), F.count("*").alias("n_all")
    ))
    open_ = apart.join(total.where("n_rest > 0 and n_all > 1").select("hub", "ni", "nj"), "hub")
    i, j = F.pmod(F.xxhash64("node"), F.col("ni")).cast("int"), F.pmod(F.xxhash64("node"), F.col("nj")).cast("int")
    left = open_.where("rest").select("hub", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj").cast("int") - 1)).alias("j"), F.lit(0).alias("side"), "node")
    right = open_.select("hub", F.explode(F.sequence(F.lit(0), F.col("ni").cast("int") - 1)).alias("i"), j.alias("j"), F.lit(1).alias("side"), "node")
    second = _compare(left.unionByName(right), sets, percent, sketch_floor).where("a <> b")
    links = cut(first.unionByName(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    root = components(links)
    named = root.join(nodes.select("node", "low"), "node")
    least = named.groupBy("root").agg(F.min("low").alias("component"))
    count = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    joined = cut(named.join(least, "root").join(count, "node").select("node", "root", "component", "n_links"))
    discard(shared, member, group, needed, chosen, sets, size, first, apart, total, links, root)
    out = sketch.select("doc_id", "n_shingles", "node", *(keep or [])).join(nodes.select("node", "low"), "node", "left").join(small(joined, 64), "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "low"))
    passed = [F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).alias("near_group"), *keep] if keep else []
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *passed)
