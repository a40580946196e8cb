"""Shortening a text: whole sentences first, then its least informative words.

Everything works on all texts at once; a text is a row with ``keys``.
Word information is a bigram surprisal over the corpus that is given, with
add-alpha smoothing; a text's first word has the median of the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.text import sentences, word_count, words
from turnweave.functions.vectors import hashed_embeddings
from turnweave.lineage import bucketed, cut
from turnweave.operators.dedup import check_fraction
from turnweave.operators.relevance import hybrid_score


def keep_count(n: Column, fraction: Column) -> Column:
    """Words kept of n: half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(n * fraction).cast("int"))


def prune_by_information(words_: DataFrame, keys: list[str], fraction: Column | float = 0.5) -> DataFrame:
    """keys, text: of words_(keys, pos, word, info) the most informative
    fraction, in their order; ties go to the earlier word."""
    if not isinstance(fraction, Column):
        check_fraction("keep_fraction", fraction)
        fraction = F.lit(float(fraction))
    by = Window.partitionBy(*keys).orderBy(F.col("info").desc(), F.col("pos"))
    ranked = words_.withColumns({"rank": F.row_number().over(by), "n": F.count("*").over(Window.partitionBy(*keys)), "f": fraction})
    kept = ranked.where(F.col("rank") <= keep_count(F.col("n"), F.col("f")))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ").alias("text"))


@dataclass(frozen=True)
class Bigrams:
    """A corpus's bigram counts: pair(v, w, vw), and how many words come second."""

    pair: DataFrame
    size: int


def count_bigrams(corpus: DataFrame, text: str) -> Bigrams:
    def bigrams(w: Column) -> Column:
        last = F.size(w) - 1
        return F.arrays_zip(F.slice(w, 1, last).alias("v"), F.slice(w, 2, last).alias("w"))

    source = corpus.select(F.col(text).alias("t")).where(word_count(F.col("t")) > 1)
    pair = source.select(words(F.lower("t")).alias("w")).select(F.explode(bigrams(F.col("w"))).alias("b")).select("b.v", "b.w").groupBy("v", "w").agg(F.count("*").alias("vw"))
    pair = bucketed(pair, "v", "w")
    return Bigrams(pair, pair.select("w").distinct().count())


def word_information(
    texts: DataFrame, keys: list[str], text: str, corpus: DataFrame | None = None, corpus_text: str | None = None, alpha: float = 0.1, counts: Bigrams | None = None
) -> DataFrame:
    """keys, pos, word, info of the words of texts; the bigram counts are given
    or come from corpus (texts themselves by default)."""
    counts = counts or count_bigrams(corpus if corpus is not None else texts, corpus_text or text)
    low = texts.select(*keys, words(F.col(text)).alias("words")).withColumn("low", F.transform("words", F.lower))
    #: ``cased`` only where it differs: less to shuffle.
    item = lambda w, i: F.struct(F.when(i > 0, F.get("low", i - 1)).alias("v"), w.alias("w"), F.nullif(F.get("words", i), w).alias("cased"))
    split = low.select(*keys, F.posexplode(F.transform("low", item)).alias("pos", "b")).select(*keys, "pos", "b.*")
    #: Counts are looked up once for each different pair, so no frequent word gathers its occurrences.
    head = counts.pair.groupBy("v").agg(F.sum("vw").alias("vn"))
    known = split.where("v IS NOT NULL").select("v", "w").distinct().join(counts.pair, ["v", "w"], "left").join(head, "v", "left")
    p = (F.coalesce("vw", F.lit(0)) + alpha) / (F.coalesce("vn", F.lit(0)) + alpha * max(counts.size, 1))
    info = split.join(known.select("v", "w", F.round(-F.ln(p), 6).alias("own")), ["v", "w"], "left").select(*keys, "pos", F.coalesce("cased", "w").alias("word"), "own")
    middle = F.coalesce(F.expr("percentile(own, 0.5)").over(Window.partitionBy(*keys)), F.lit(0.0))
    return info.select(*keys, "pos", "word", F.coalesce("own", middle).alias("info"))


def select_sentences(texts: DataFrame, keys: list[str], text: str, query: str, target: str, counter=word_count, embedder=hashed_embeddings, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """keys, selected: the most relevant sentences while their running size stays
    within target (stops at the first that does not fit), in text order. Texts
    of which nothing fits do not appear."""
    split = bucketed(texts.select(*keys, query, target, F.posexplode(sentences(F.col(text))).alias("sent_id", "sentence")), *keys)
    scored = hybrid_score(split, keys, "sent_id", "sentence", query, *weights, embedder).select(*keys, "sent_id", "score")
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("sent_id")).rowsBetween(Window.unboundedPreceding, 0)
    sizes = split.select(*keys, "sent_id", target, counter(F.col("sentence")).alias("size"))
    fits = sizes.join(scored, [*keys, "sent_id"]).withColumn("spent", F.sum("size").over(order)).where(F.col("spent") <= F.col(target))
    #: Sentences are met by their numbers: those of a text lie together in split.
    kept = fits.groupBy(*keys).agg(F.collect_set("sent_id").alias("kept"))
    rows = split.join(kept, keys).where(F.array_contains("kept", F.col("sent_id")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "sentence"))), lambda s: s["sentence"]), " ").alias("selected"))


def compress_texts(
    texts: DataFrame,
    keys: list[str],
    text: str = "content",
    query: str = "query",
    target: str = "target",
    corpus: DataFrame | None = None,
    corpus_text: str | None = None,
    overshoot: float = 1.5,
    counter=word_count,
    embedder=hashed_embeddings,
    weights: tuple[float, float] = (0.6, 0.4),
    pruner=None,
    counts: Bigrams | None = None,
) -> DataFrame:
    """keys, compressed. Sentences are selected for overshoot * target; if the
    selection is still over target its words are pruned, and if nothing could
    be selected the words of the original are. Blank texts and targets of 0 or
    less give "". Only texts that need it reach the pruner, a function
    (texts(keys, text, fraction)) -> (keys, text)."""
    live = texts.where((F.col(target) > 0) & (F.regexp_count(F.col(text), F.lit(r"(?U)\S")) > 0))
    live = live.withColumn("mid", F.greatest(F.lit(1), (F.col(target) * F.lit(float(overshoot))).cast("int")))
    picked = select_sentences(live, keys, text, query, "mid", counter, embedder, weights)
    both = live.join(picked, keys, "left").select(*keys, target, F.coalesce("selected", text).alias("text"), F.col("selected").isNotNull().alias("found"))
    both = cut(both.withColumn("size", counter(F.col("text"))))
    done = both.where(F.col("found") & (F.col("size") <= F.col(target))).select(*keys, F.col("text").alias("compressed"))
    over = both.where(~(F.col("found") & (F.col("size") <= F.col(target))) & (F.col("size") > 0))
    over = over.select(*keys, "text", F.least(F.lit(1.0), F.greatest(F.lit(0.01), F.col(target) / F.col("size"))).alias("fraction"))
    if pruner is None:
        info = word_information(over, keys, "text", corpus if corpus is not None else texts, corpus_text or text, counts=counts)
        pruned = prune_by_information(info.join(over.select(*keys, "fraction"), keys), keys, F.col("fraction"))
    else:
        pruned = pruner(over)
    out = done.unionByName(pruned.select(*keys, F.col("text").alias("compressed")))
    return texts.select(*keys).join(out, keys, "left").select(*keys, F.coalesce("compressed", F.lit("")).alias("compressed"))
