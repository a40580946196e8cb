"""Tiers under a token budget: recent turns first, then by relevance.

The last ``recency_floor`` turns are kept, newest first, while they fit in
``max_recency_fraction`` of the budget (a running sum: it only grows, so a stop
at the first miss is a filter). The others compete by score for what is left:
in full if they fit, else at ``compression_ratio`` of their size, else dropped;
a miss does not end the competition, so this is a fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.operators.dedup import check_fraction


def recent_turns(turns: DataFrame, recency_floor: int = 3, max_recency_fraction: float = 0.5, budget: str = "budget") -> DataFrame:
    """turns with is_recent."""
    if recency_floor < 0:
        raise ValueError(f"recency_floor must be >= 0, got {recency_floor}")
    check_fraction("max_recency_fraction", max_recency_fraction)
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn_id").desc())
    spent = F.sum("token_count").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("is_recent", (F.row_number().over(newest) <= recency_floor) & (spent <= F.col(budget) * F.lit(max_recency_fraction)))


def allocate_tiers(
    turns: DataFrame, recency_floor: int = 3, compression_ratio: float = 0.3, max_recency_fraction: float = 0.5, budget: str = "budget", score: str = "score"
) -> DataFrame:
    """turns(conv_id, turn_id, token_count, score, budget, ...) with ``tier``.
    A missing score counts as 0; ties go to the lower turn."""
    check_fraction("compression_ratio", compression_ratio)
    marked = recent_turns(turns, recency_floor, max_recency_fraction, budget)
    columns = turns.columns
    order = F.struct(
        F.when(F.col("is_recent"), 0).otherwise(1).alias("late"), (-F.round(F.coalesce(score, F.lit(0.0)), 6)).alias("rank"), F.col("turn_id").alias("id"), F.col("token_count").cast("long").alias("n")
    )
    packed = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("q"), F.first(budget).cast("long").alias("b"), F.collect_list(F.struct(*columns)).alias("rows"))
    start = F.struct(F.col("b").alias("left"), F.array().cast("array<struct<id:int,tier:string>>").alias("out"))

    def step(state, t):
        short = F.ceil(t["n"] * F.lit(float(compression_ratio))).cast("long")
        tier = F.when(t["late"] == 0, "KEEP_RECENT").when(state["left"] >= t["n"], "KEEP_FULL").when(state["left"] >= short, "COMPRESS").otherwise("DROP")
        cost = F.when((t["late"] == 0) | (state["left"] >= t["n"]), t["n"]).when(state["left"] >= short, short).otherwise(F.lit(0).cast("long"))
        return F.struct((state["left"] - cost).alias("left"), F.concat(state["out"], F.array(F.named_struct(F.lit("id"), t["id"].cast("int"), F.lit("tier"), tier))).alias("out"))

    tiers = F.map_from_entries(F.aggregate("q", start, step, lambda s: s["out"]))
    rows = packed.select(tiers.alias("tiers"), F.explode("rows").alias("r"))
    return rows.select("r.*", F.element_at("tiers", F.col("r.turn_id").cast("int")).alias("tier"))
