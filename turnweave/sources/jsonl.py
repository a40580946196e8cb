"""Evaluation cases as JSON lines, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.functions.text import strip
from turnweave.schema import CASE


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file, from 1. Lines are numbered within their
    splits, and splits by the counts before them, so the file is read in parallel."""
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    lines = lines.select(F.col("value").alias("line"), F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("at"))
    counts = lines.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(counts.select("part", before.alias("before")), "part").select((F.col("before") + F.col("at") + 1).alias("line_no"), "line")


def read_cases(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """line_no and the fields of a case, of the first ``limit`` non-blank lines
    (0: all). A line that is no such case fails the read, by its path and number."""
    lines = numbered_lines(spark, path).withColumn("line", strip(F.col("line"))).where("line <> ''")
    if limit:
        lines = lines.orderBy("line_no").limit(limit)
    parsed = lines.withColumn("case", F.from_json("line", f"{CASE}, bad string", {"columnNameOfCorruptRecord": "bad"}))
    wrong = F.raise_error(F.concat(F.lit(f"{path}:"), F.col("line_no").cast("string"), F.lit(": invalid JSON")))
    return parsed.where(F.when(F.col("case.bad").isNull(), True).otherwise(wrong.cast("boolean"))).select("line_no", "case.*").drop("bad")


def tolerant_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line, is_fence) of non-blank lines; a Markdown fence is no case."""
    lines = numbered_lines(spark, path).withColumn("line", strip(F.col("line"))).where("line <> ''")
    return lines.withColumn("is_fence", F.startswith("line", F.lit("```")))


def write_csv(df: DataFrame, path: str) -> None:
    """One header per file, UTF-8."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
