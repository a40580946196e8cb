"""Compression kept up to date as turns arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnweave.functions.text import word_count
from turnweave.plans.compress import Config, compress, split_latest


def compress_stream(arrivals: DataFrame, history_path: str, output_path: str, checkpoint: str, config: Config = Config(), parts: int = 256) -> StreamingQuery:
    """Starts a query over streamed turns(conv_id, turn_id, role, content).

    Each micro-batch is added to the history table, which is partitioned by
    batch and by a hash of the conversation (``parts`` of them). Only the parts
    that the batch touches are read, and only its conversations compressed
    again, each turn in its latest version; they are written as one partition
    per batch. A batch that is run again overwrites what its first run wrote.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark, own = batch.sparkSession, f"{history_path}/batch={batch_id}"
        part = F.pmod(F.xxhash64("conv_id"), F.lit(parts))
        batch.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(own)
        fresh = spark.read.parquet(own)
        touched = [r.part for r in fresh.select("part").distinct().collect()]  # at most ``parts``
        history = spark.read.parquet(history_path).where((F.col("batch") <= batch_id) & F.col("part").isin(touched))
        history = history.join(fresh.select("conv_id").distinct(), "conv_id", "left_semi")
        turns = history.groupBy("conv_id", "turn_id").agg(F.max_by(F.struct("role", "content"), "batch").alias("m")).select("conv_id", "turn_id", "m.*")
        ready = split_latest(turns.withColumn("token_count", word_count("content")))
        compress(ready, config).write.mode("overwrite").parquet(f"{output_path}/batch={batch_id}")

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
