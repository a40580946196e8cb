"""From tiers to messages and a report per conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.functions.text import word_count
from turnweave.operators.condense import compress_texts
from turnweave.operators.dedup import check_fraction
from turnweave.schema import TIERS


def assemble(turns: DataFrame, compression_ratio: float = 0.3, counter=word_count, groups: DataFrame | None = None, corpus: DataFrame | None = None, compressor=compress_texts, **options) -> DataFrame:
    """One row per conversation of turns(conv_id, turn_id, role, content,
    token_count, query, tier): messages in turn order, original_tokens,
    compressed_tokens, compression_ratio (compressed over original; 0 for
    none), tier_assignment, dropped_turn_ids, merged_groups.

    COMPRESS turns are shortened to ceil(token_count * compression_ratio); one
    that comes out empty is dropped but keeps its tier. A missing or unknown
    tier raises. groups: (conv_id, survivor, members) to report.
    """
    check_fraction("compression_ratio", compression_ratio)
    bad = F.raise_error(F.concat(F.lit("no valid tier for turn "), F.col("turn_id").cast("string")))
    checked = turns.withColumn("tier", F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise(bad))
    keys = ["conv_id", "turn_id"]
    target = F.greatest(F.lit(1), F.ceil(F.col("token_count") * F.lit(float(compression_ratio))).cast("int"))
    short = checked.where("tier = 'COMPRESS'").select(*keys, "content", "query", target.alias("target"))
    short = compressor(short, keys, corpus=corpus if corpus is not None else turns, counter=counter, **options)
    # the turns that stay as they are need not meet the shortened ones
    whole = checked.where("tier <> 'COMPRESS'").withColumn("compressed", F.lit(None).cast("string"))
    rows = whole.unionByName(checked.where("tier = 'COMPRESS'").join(short, keys, "left"))
    text = F.when(F.col("tier") == "COMPRESS", F.col("compressed")).when(F.col("tier") != "DROP", F.col("content"))
    rows = rows.withColumn("out", F.when((F.col("tier") != "COMPRESS") | (F.length(text) > 0), text))
    item = F.struct("turn_id", F.struct("role", F.col("out").alias("content")).alias("m"))
    kept = F.array_sort(F.collect_list(F.when(F.col("out").isNotNull(), item)))
    result = rows.groupBy("conv_id").agg(
        F.transform(kept, lambda x: x["m"]).alias("messages"),
        F.sum("token_count").cast("long").alias("original_tokens"),
        F.coalesce(F.sum(counter(F.col("out"))), F.lit(0)).cast("long").alias("compressed_tokens"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("turn_id", "tier")))).alias("tier_assignment"),
        F.array_sort(F.collect_list(F.when(F.col("out").isNull(), F.col("turn_id")))).alias("dropped_turn_ids"),
    )
    ratio = F.when(F.col("original_tokens") > 0, F.col("compressed_tokens") / F.col("original_tokens")).otherwise(0.0)
    result = result.withColumn("compression_ratio", ratio)
    if groups is None:
        return result.withColumn("merged_groups", F.array().cast("array<array<bigint>>"))
    merged = groups.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.transform("members", lambda m: m.cast("bigint")))).alias("merged_groups"))
    return result.join(merged, "conv_id", "left").withColumn("merged_groups", F.coalesce("merged_groups", F.array().cast("array<array<bigint>>")))
