"""Documents to a training mix in five stages, each one of the operators.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and
returns a DataFrame; run() writes it to the shared folder and reads it again as
the next stage's docs. All stages but the last return the columns of documents.

Edge cases. Rows with a null text pass every filter (they hold nothing to
reject). Near-duplicate removal judges rows by id and text: one row of a group
stays, also where ids repeat or are null. Rows without a word are in no group.
Empty tables pass through; further columns of documents are dropped at the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm import decontaminate, minhash, mixing, repeats, toxicity
from turnweave.llm.runtime import cut, shared_folder, small

#: Repeated passages of some 50 words go: nearly all runs of 51 words have more bytes.
PASSAGE_BYTES = 240
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger does not reject. It learns from two thirds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    scored = toxicity.score_documents(docs, labels, held_out, keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least id; null ids last."""
    keyed = docs.select("*", *decontaminate.row_keys(F.col("doc_id"), F.col("text")))
    judged = minhash.near_duplicates(keyed, keep=["k1", "k2"]).where("near_group is not null")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    rows = cut(judged.groupBy("near_group", "k1", "k2").agg(F.min(order).alias("row"), F.count("*").alias("n")))
    best = rows.groupBy("near_group").agg(F.min("row").alias("best"))
    judged = rows.join(best, "near_group").select("k1", "k2", (F.col("row") == F.col("best")).alias("first"), "n")
    dropped = cut(judged.where("not first").select("k1", "k2").distinct())
    again = cut(judged.where("first and n > 1").select("k1", "k2").distinct())
    left = keyed.join(small(dropped, 32), ["k1", "k2"], "left_anti")
    once = left.join(small(again, 32), ["k1", "k2"], "left_anti").select(*COLUMNS)
    return once.unionByName(left.join(small(again, 32), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(*COLUMNS))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of PASSAGE_BYTES that stand in them twice or elsewhere."""
    left = repeats.remove_repeats(docs, PASSAGE_BYTES, keep=["lang", "source", "n_chars", F.col("text").isNull().alias("no_text")])
    text = F.when(~F.col("no_text"), F.col("kept"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item: 13 words in a row, or a shorter item whole."""
    judged = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dropped = cut(judged.where("n_hit > 0").select("k1", "k2").distinct())
    keyed = docs.select("*", *decontaminate.row_keys(F.col("doc_id"), F.col("text")))
    return keyed.join(small(dropped, 32), ["k1", "k2"], "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffix_array", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: No SQL tells what a fitted tagger rejects; tests/llm/test_pipeline.py plants cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
