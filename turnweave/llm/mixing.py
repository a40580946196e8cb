"""Mixing sources to target weights by a low-discrepancy schedule.

Method. Slot i of the schedule is the golden-ratio point of i; the source whose
interval of the cumulative targets holds the point owns the slot. Each source's
texts, in hashed order, form one stream of words cut into blocks of
``block_words``; the r-th slot of a source takes block r of its stream, and
begins the stream anew when it is used up, at most ``max_repeats`` times. The
last slot of a source is cut so that it takes exactly its rounded target; slots
past that are idle, and what a finite schedule leaves short is appended.

At scale. No step gathers a source in one task: slots are ranked in runs of
65,536 consecutive slots and texts are placed in hashed buckets of about
``bucket_rows`` rows; only the sums of runs and buckets are accumulated per
source. Slots meet blocks by an equi-join on (source, block), keys of at most
``max_repeats`` slots each. A slot finds its owner by an equi-join on cells of
the unit interval, four or more for each source. The targets themselves are
running sums over the sources: one row a source, in one task. Text is read once,
to count its words.

Edge cases. A null text has size 0 and takes nothing; a null source comes last.
An empty table gives an empty mix; sources of size 0 have target 0. Rows with
equal or null ids are mixed one by one (equal ids in an arbitrary but repeatable
order). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm.runtime import cut, small

#: The golden ratio's step on a grid of 2**31 points (odd, so its period is the whole grid).
_STEP, _GRID = 1327217885, 1 << 31
_RUN, _LEAST_CELLS = 65536, 1024


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, source_size, place, target) of sources(source, source_size).

    Weights repeat over the sources in code-point order, null last. A target
    stops at max_repeats times its source's size; the excess goes to the others
    by weight: sources sorted by size per weight fill up one after another.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("place", F.row_number().over(order))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("place") - 1) % len(weights))).withColumn("most", F.col("source_size") * float(max_repeats))
    by = Window.orderBy(F.col("most") / F.col("weight"), "place")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / weight_left)
    free = F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct((F.col("most") / F.col("weight")).alias("r"), "place", "level"))
    level = level.withColumn("water", F.coalesce(F.min(free).over(every)["level"], F.lit(0.0)))
    return level.select("source", "source_size", "place", F.least("most", F.col("water") * F.col("weight")).alias("target"))


def schedule(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    block_words: int = 256,
    bucket_rows: int = 20_000,
    seed: int = 17,
    text: str = "text",
    ident: str = "doc_id",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): rows has row, doc_id, size, source_size, target; pieces
    has slot, row, source place, epoch, block, begin (word of the text), words."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = cut(docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), size.alias("size")).withColumn("row", F.monotonically_increasing_id()))
    target = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats))
    n_rows, total, n_sources = sized.count(), target.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], target.count()
    rows = sized.alias("d").join(small(target, 64).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("row", "doc_id", "size", "place", "source_size", "target")

    # Where each text stands in its source's stream.
    buckets = 1 + n_rows // bucket_rows
    mixed = F.xxhash64("doc_id", F.lit(seed))
    placed = rows.where("size > 0").select("row", "doc_id", "size", "place", "source_size", mixed.alias("h"), F.pmod(F.xxhash64(mixed), F.lit(buckets)).alias("bucket"))
    held = placed.groupBy("place", "bucket").agg(F.sum("size").alias("n"))
    past = F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("place", "bucket", past.alias("past"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("place", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("inside", inside).join(held, ["place", "bucket"]).withColumn("at", F.col("inside") + F.col("past"))
    block = F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}")))
    parts = placed.select("row", "place", "at", "size", block.alias("block"))
    start = F.greatest(F.col("at"), F.col("block") * block_words)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    parts = parts.select("row", "place", "block", (start - F.col("at")).alias("begin"), (start - F.col("block") * block_words).alias("first"), (end - F.col("block") * block_words).alias("last"))

    # Slots to sources, and their ranks within each.
    quota = target.where("source_size > 0").withColumn("quota", F.round("target").cast("long"))
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    rest = F.col("quota") % F.col("source_size")
    quota = quota.withColumns({"blocks": blocks, "needed": F.expr("quota div source_size") * blocks + F.ceil(rest / block_words)})
    order = Window.orderBy("place")
    sure = F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = quota.withColumn("hi", F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, 0)) / sure).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    share = cut(share.select("place", "source_size", "quota", "blocks", "needed", "lo", "hi"))
    n_cells = max(_LEAST_CELLS, 1 << (4 * n_sources).bit_length())  # a power of two, so that products with it are exact
    cells = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * n_cells), F.least(F.floor(F.col("hi") * n_cells), F.lit(n_cells - 1)))))
    slots = 2 * n_sources + 2 + (total * 102) // (100 * block_words)
    points = ((F.col("id") % _GRID) * _STEP % _GRID) / float(_GRID)
    slot = docs.sparkSession.range(slots).select(F.col("id").alias("slot"), points.alias("u")).withColumn("cell", F.floor(F.col("u") * n_cells))
    owned = slot.join(small(cut(cells.select("place", "lo", "hi", "cell")), 48), "cell").where("u >= lo and u < hi").select("slot", "place", F.expr(f"slot div {_RUN}").alias("run"))
    owned = cut(owned)
    runs = owned.groupBy("place", "run").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("place", "run", ahead.alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("place", "run").orderBy("slot")) - 1
    ranked = owned.withColumn("rank", rank).join(runs, ["place", "run"]).select("slot", "place", (F.col("rank") + F.col("ahead")).alias("rank"))
    given = owned.groupBy("place").agg(F.count("*").alias("given"))
    short = share.join(given, "place", "left").select("place", F.coalesce("given", F.lit(0)).alias("given"), "needed").where("given < needed")
    short = short.select(F.lit(slots).cast("long").alias("slot"), "place", F.explode(F.sequence("given", F.col("needed") - 1)).alias("rank"))
    taken = ranked.unionByName(short).join(small(share, 64), "place").where("rank < needed")
    epoch, number = F.expr("rank div blocks"), F.expr("rank % blocks")
    past = epoch * F.col("source_size") + number * block_words
    taken = taken.select("slot", "place", epoch.alias("epoch"), number.alias("block"), F.least(F.lit(block_words), F.col("quota") - past).alias("take"))
    pieces = taken.join(parts, ["place", "block"]).withColumn("words", F.least("last", "take") - F.col("first")).where("words > 0")
    return rows, pieces.select("slot", "row", "place", "epoch", "block", "begin", "words")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target (the source's), taken of every row."""
    rows, pieces = schedule(docs, **options)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
