"""Hooks for models: loaded once in each Python worker, run on Arrow batches.

``load`` is a function without arguments that returns the model; it must be
importable or picklable. Nothing is loaded on the driver, and a worker that is
reused for the next task keeps its model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from turnweave.functions.text import words
from turnweave.operators.condense import prune_by_information

_LOADED: dict[str, object] = {}


def loaded(name: str, load: Callable):
    """The worker's model of this name."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def embedder(name: str, load: Callable) -> Callable[[DataFrame, list[str], str], DataFrame]:
    """An ``embedder`` for Config: the model maps a list of texts to vectors."""

    @pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(name, load)
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model(texts.fillna("").tolist())], dtype=object)

    return lambda df, keys, text: df.select(*keys, vectors(F.col(text)).alias("embedding"))


def word_spans(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, word, begin, end (characters) of the words of each text."""
    gaps = F.split(F.col(text), r"(?U)\S+")
    each = texts.select(*keys, F.posexplode(F.arrays_zip(words(F.col(text)).alias("word"), gaps.alias("gap"))).alias("pos", "x"))
    each = each.where("x.word is not null").select(*keys, "pos", F.col("x.word").alias("word"), F.length("x.gap").alias("gap"))
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("word")).over(order)
    return each.select(*keys, "pos", "word", (end - F.length("word")).cast("int").alias("begin"), end.cast("int").alias("end"))


def token_scores(name: str, load: Callable) -> Callable[[Column], Column]:
    """The model's tokens of a text: it maps a text to (begin, end, information) each."""

    @pandas_udf("array<struct<begin:int,end:int,info:double>>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(name, load)
        for texts in batches:
            yield pd.Series([[{"begin": int(b), "end": int(e), "info": float(x)} for b, e, x in model(t)] for t in texts.fillna("")], dtype=object)

    return scores


def model_information(texts: DataFrame, keys: list[str], text: str, name: str, load: Callable) -> DataFrame:
    """keys, pos, word, info: the sum over the tokens that overlap a word; words
    that none overlaps have the median of the others, or 0."""
    tokens = texts.select(*keys, token_scores(name, load)(F.col(text)).alias("tokens"))
    both = word_spans(texts, keys, text).join(tokens, keys)
    met = F.filter("tokens", lambda t: (t["begin"] < F.col("end")) & (t["end"] > F.col("begin")))
    own = F.when(F.size(met) > 0, F.aggregate(met, F.lit(0.0), lambda total, t: total + t["info"]))
    both = both.withColumn("own", own)
    middle = F.coalesce(F.expr("percentile(own, 0.5)").over(Window.partitionBy(*keys)), F.lit(0.0))
    return both.select(*keys, "pos", "word", F.round(F.coalesce("own", middle), 6).alias("info"))


def pruner(name: str, load: Callable, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A ``pruner`` for Config over texts(keys, text, fraction)."""

    def prune(texts: DataFrame) -> DataFrame:
        info = model_information(texts, keys, "text", name, load)
        return prune_by_information(info.join(texts.select(*keys, "fraction"), keys), keys, F.col("fraction"))

    return prune
