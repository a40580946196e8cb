"""Text as column expressions: tokens, words, sentences, normal forms.

White space is Unicode white space throughout, as ``(?U)\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in the overlap rule.
STOPWORDS = (
    "about after again also because been before being could does from have into just like make more need only other over please really should some "
    "that their them then there these they this very want were what when where which while will with would your you the and for are"
).split()


def _filled(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def words(text: Column) -> Column:
    """Maximal runs of non-space characters."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    """The default token counter."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lexical_tokens(text: Column) -> Column:
    """Lower-case ASCII letters and digits; any other character separates."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? before white space; [] for a blank text."""
    return _filled(F.transform(F.split(strip(text), r"(?U)(?<=[.!?])\s+"), strip))


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def gold_parts(gold: Column) -> Column:
    """The answers joined by " | ", stripped, without empty ones."""
    return _filled(F.transform(F.split(gold, r" \| "), strip))


def content_words(text: Column) -> Column:
    """Distinct lexical tokens of four or more characters that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_except(F.array_distinct(F.filter(lexical_tokens(text), lambda w: F.length(w) >= 4)), stop)


def category_of_run(raw: Column) -> Column:
    """Runner's form: a second character ")" takes three characters with it."""
    t = F.lower(strip(raw))
    return F.when((F.substring(t, 2, 1) == ")") & (F.length(t) > 2), strip(F.substring(t, 4, 1 << 20))).otherwise(t)


def category_of_dataset(raw: Column) -> Column:
    """Validator's form: a label a) to g) and the space after it go."""
    return F.regexp_replace(F.lower(strip(raw)), r"(?U)^[a-g]\)\s*", "")


def normal_role(role: Column, kind: Column | None = None) -> Column:
    """user or assistant from role (or type); anything else raises."""
    given = F.coalesce(F.nullif(role, F.lit("")), F.nullif(kind, F.lit("")) if kind is not None else F.lit(None))
    low = F.lower(given)
    low = F.when(low == "human", "user").when(low == "ai", "assistant").otherwise(low)
    return F.when(low.isin("user", "assistant"), low).otherwise(F.raise_error(F.concat(F.lit("unsupported role: "), F.coalesce(low, F.lit("none")))))
