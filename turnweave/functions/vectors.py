"""Vectors: hashed bag-of-words embeddings and cosines.

An embedder is any function (df, keys, text column) -> df with ``embedding``;
the default is deterministic and needs no model. Its vectors are counted from
one array of buckets a row, which an aggregate holds fast; rows of single words,
of which a sort or a hash table holds many times the text, are not made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions.text import lexical_tokens

DIM = 64


def bucket(word: Column, dim: int = DIM) -> Column:
    """md5 of the word modulo dim (a power of two up to 256)."""
    return (F.conv(F.substring(F.md5(word), 31, 2), 16, 10).cast("int") % dim).cast("int")


def hashed_embeddings(df: DataFrame, keys: list[str], text: str, dim: int = DIM) -> DataFrame:
    """keys and embedding (word counts by bucket) of each row, equal keys taken together; one shuffle on keys."""
    row = df.select(*keys, F.transform(lexical_tokens(F.col(text)), lambda w: bucket(w, dim)).alias("b"))
    packed = row.groupBy(*keys).agg(F.flatten(F.collect_list("b")).alias("b"))
    within = lambda i: F.size("b") - F.size(F.array_remove("b", i))
    return packed.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: within(i).cast("float")).alias("embedding"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its norm + 1e-12; the zero vector stays zero."""
    # The norm is bound by an outer lambda; inside the inner one it would be computed per element.
    return F.get(F.transform(F.array(norm(a) + 1e-12), lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Rounded to 6 decimals; 0 with a zero vector."""
    return F.round(dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12)), 6)
