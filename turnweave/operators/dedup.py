"""Near-duplicate turns within a conversation, in turn order.

A turn is absorbed by the earliest survivor of cosine >= threshold, not by an
absorbed turn (merging is not transitive). The order matters, so it is a fold
over the conversation's turns: one aggregate, no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.functions.vectors import dot, hashed_embeddings, unit


def check_fraction(name: str, value: float) -> None:
    if not 0 < value <= 1:
        raise ValueError(f"{name} must be in (0, 1], got {value}")


def assign_survivors(df: DataFrame, keys: list[str], ident: str, text: str | None = "content", threshold: float = 0.92, embedder=hashed_embeddings) -> DataFrame:
    """keys, ident, survivor of each row. Without ``text``, df has ``embedding``."""
    check_fraction("similarity_threshold", threshold)
    vectors = df.select(*keys, ident, "embedding") if text is None else embedder(df, [*keys, ident], text)
    vectors = vectors.select(*keys, F.struct(F.col(ident).cast("long").alias("id"), unit(F.col("embedding")).alias("v")).alias("x"))
    rows = vectors.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    # the state holds places in xs, not vectors: it is copied in each step
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.array().cast("array<bigint>").alias("out"))

    def step(state, x):
        first = F.get(F.filter(state["kept"], lambda k: F.round(dot(F.get("xs", k)["v"], x["v"]), 6) >= threshold), F.lit(0))
        grown = lambda k: F.struct(
            F.when(k.isNotNull(), state["kept"]).otherwise(F.concat(state["kept"], F.array(F.size(state["out"])))).alias("kept"),
            F.concat(state["out"], F.array(F.coalesce(F.get("xs", k)["id"], x["id"]))).alias("out"),
        )
        # bound by a lambda, so that the survivors are searched once
        return F.get(F.transform(F.array(first), grown), F.lit(0))

    survivors = F.aggregate("xs", start, step, lambda s: s["out"])
    out = rows.select(*keys, F.inline(F.arrays_zip(F.transform("xs", lambda x: x["id"]).alias("id"), survivors.alias("survivor"))))
    return out.withColumnRenamed("id", ident)


def merged_groups(assigned: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """keys, survivor, members (survivor first) of the groups of two or more."""
    groups = assigned.groupBy(*keys, "survivor").agg(F.array_sort(F.collect_list(ident)).alias("members"))
    return groups.where(F.size("members") > 1)
