"""Relevance of rows to their batch's query: BM25, cosine, and their blend.

A batch is the rows with equal ``keys`` (a conversation's turns, or a turn's
sentences). Every step is a window or an aggregate that is keyed by the batch,
so one shuffle on the batch serves them all. Rows of single terms carry numbers
only, no query: what is sorted stays a small multiple of the text. Scores are rounded to 6 decimals
before they are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.text import lexical_tokens
from turnweave.functions.vectors import cosine, hashed_embeddings

K1, B, EPSILON = 1.5, 0.75, 0.25


def min_max(x: Column, keys: list[str]) -> Column:
    """x scaled to [0, 1] within the batch; 0.5 where the batch is constant."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi - lo < 1e-12, F.lit(0.5)).otherwise((x - lo) / (hi - lo))


def bm25(df: DataFrame, keys: list[str], ident: str, text: str, query: str) -> DataFrame:
    """keys, ident, bm25 of each row of df against df's query column.

    A term that most rows have would weigh negative; it weighs EPSILON times
    the batch's mean weight instead. Rows without a matching term score 0; so
    does a batch without any token.
    """
    batch = Window.partitionBy(*keys)
    doc = df.select(*keys, ident, F.col(text).alias("text"), F.col(query).alias("query"), F.regexp_count(F.lower(text), F.lit("[a-z0-9]+")).alias("dl"))
    doc = doc.withColumns({"n": F.count("*").over(batch), "avgdl": F.avg("dl").over(batch)})
    doc = doc.select(*keys, ident, "n", "dl", "avgdl", lexical_tokens(F.col("text")).alias("terms"), F.coalesce(lexical_tokens(F.col("query")), F.array().cast("array<string>")).alias("asked"))
    #: Terms that are asked for come with their counts; of the others only the rows are counted, so a term's row holds no text but its own.
    within = lambda a, t: F.size(a) - F.size(F.array_remove(a, t))
    entry = lambda t, tf, times: F.struct(t.alias("term"), tf.cast("int").alias("tf"), times.cast("int").alias("times"))
    hits = F.transform(F.array_intersect("terms", "asked"), lambda t: entry(t, within(F.col("terms"), t), within(F.col("asked"), t)))
    others = F.transform(F.array_except("terms", "asked"), lambda t: entry(t, F.lit(0), F.lit(0)))
    term = doc.select(*keys, ident, "n", "dl", "avgdl", F.explode_outer(F.concat(hits, others)).alias("t")).select(*keys, ident, "n", "dl", "avgdl", "t.*")
    part = F.col("times") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    term = term.select(*keys, ident, "n", "term", F.when(F.col("times") > 0, part).otherwise(0.0).alias("part"))
    term = term.withColumn("df", F.when(F.col("term").isNotNull(), F.count("term").over(Window.partitionBy(*keys, "term"))))
    term = term.withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    #: The mean over distinct terms: each of a term's df rows carries 1/df of it.
    row = term.groupBy(*keys, ident).agg(
        F.sum(F.when(F.col("raw") >= 0, F.col("raw") * F.col("part"))).alias("rare"),
        F.sum(F.when(F.col("raw") < 0, F.col("part"))).alias("frequent"),
        F.sum(F.col("raw") / F.col("df")).alias("raw"),
        F.sum(1.0 / F.col("df")).alias("terms"),
    )
    mean = F.sum("raw").over(batch) / F.sum("terms").over(batch)
    gain = F.coalesce("rare", F.lit(0.0)) + F.coalesce(EPSILON * mean * F.col("frequent"), F.lit(0.0))
    return row.select(*keys, ident, F.round(gain, 6).alias("bm25"))


def similarity(df: DataFrame, keys: list[str], ident: str, text: str, query: str, embedder=hashed_embeddings) -> DataFrame:
    """keys, ident, cosine of each row's text and its batch's query. A column
    ``embedding`` of df is used where it is not null."""
    own = embedder(df, [*keys, ident], text)
    asked = embedder(df.select(*keys, query).dropDuplicates(keys), keys, query).withColumnRenamed("embedding", "asked")
    if "embedding" in df.columns:
        own = own.withColumnRenamed("embedding", "made").join(df.select(*keys, ident, "embedding"), [*keys, ident])
        own = own.select(*keys, ident, F.coalesce("embedding", "made").alias("embedding"))
    return own.join(asked, keys).select(*keys, ident, cosine(F.col("embedding"), F.col("asked")).alias("cosine"))


def hybrid_score(
    df: DataFrame, keys: list[str], ident: str, text: str, query: str, semantic_weight: float = 0.6, lexical_weight: float = 0.4, embedder=hashed_embeddings
) -> DataFrame:
    """keys, ident, bm25, cosine, score: both signals scaled in their batch, then blended."""
    both = bm25(df, keys, ident, text, query).join(similarity(df, keys, ident, text, query, embedder), [*keys, ident])
    blend = semantic_weight * min_max(F.col("cosine"), keys) + lexical_weight * min_max(F.col("bm25"), keys)
    return both.withColumn("score", F.round(blend, 6))
