"""Benchmark decontamination by winnowing, in column functions only.

Method. Both sides are cut into words and hashed as k-grams; in each window of
w = guarantee - k + 1 consecutive k-grams the least hash is kept, and a run of
windows that keep the same hash is one fingerprint. A passage of ``guarantee``
words (13) that stands on both sides is a whole window on both sides, so it
keeps the same hash there: no shared passage is missed. Fingerprints are
joined; a hit is extended to the 13-word windows of its run, and these are
compared word by word with the benchmark's windows, so nothing is reported on
a hash alone. Items of fewer words are windows of their own length; each such
length that occurs is one more pass with that guarantee.

At scale. The corpus is scanned once per guarantee (once, as a rule). When the
benchmark's distinct fingerprints and windows are few enough to be broadcast
(their counts are checked), the corpus is not shuffled before the hits: the
words of a text are at hand where its fingerprints meet the benchmark. Beyond
that the fingerprints are shuffled to a semi-join (split where hot) and the
texts that hit come back by id. Only hit windows, not texts, are aggregated.

Edge cases. Null or wordless texts have no words, no hits and are clean; null
or wordless items match nothing. Rows with equal ids are judged one by one, as
are null ids; equal item ids count once. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.runtime import BROADCAST_BYTES, cut
from turnweave.llm.url_filter import LOWER, UPPER

#: A run of the characters that separate words, once A-Z is folded.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _GAP), lambda w: w != "")


def row_keys(ident: Column, text: Column) -> list[Column]:
    """Two hashes of a row's id and text, by which its verdict finds it again."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(ident, text).alias("k1"), F.hash(text).alias("k2")]


def _windows(docs: DataFrame, guarantee: int, k: int) -> DataFrame:
    """docs(words, ...) with least: the winnowed hash of each window, by place."""
    k = min(k, guarantee)
    w = guarantee - k + 1
    places = lambda array, n: F.sequence(F.lit(0), F.size(array) - n)
    # slice() copies the whole array each time in a lambda, get() does not
    run = lambda array, i, n: [F.get(array, i + j) for j in range(n)]
    # A CASE, not a filter: a filter would be pushed below the split and repeat it.
    grams = F.when(F.size("words") >= guarantee, F.transform(places("hashes", k), lambda i: F.xxhash64(*run("hashes", i, k))))
    least = F.when(F.col("grams").isNotNull(), F.transform(places("grams", w), lambda i: F.least(*run("grams", i, w)) if w > 1 else F.get("grams", i)))
    return docs.withColumn("hashes", F.transform("words", lambda word: F.xxhash64(word))).withColumn("grams", grams).withColumn("least", least).drop("grams", "hashes")


def _window(i: Column, length: int) -> Column:
    """The words from place i on as one string."""
    return F.concat_ws(" ", *[F.get("words", i + j) for j in range(length)])


def _prints(base: DataFrame) -> DataFrame:
    """base(least, ...) with prints: each run of windows first ... until - 1 that keep one hash."""
    least = F.col("least")
    starts = F.array_compact(F.transform(least, lambda h, i: F.when((i == 0) | (h != F.get(least, i - 1)), F.struct(h.alias("fingerprint"), i.alias("first")))))
    until = lambda j: F.coalesce(F.get(F.col("starts"), j + 1)["first"], F.size("least")).alias("until")
    return base.withColumn("starts", starts).withColumn("prints", F.transform("starts", lambda s, j: F.struct(s["fingerprint"].alias("fingerprint"), s["first"].alias("first"), until(j)))).drop("starts")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = 13,
    k: int = 5,
    numerator: int = 20,
    max_broadcast: int = BROADCAST_BYTES,
    text: str = "text",
    ident: str = "doc_id",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as strings),
    items_sha256, contaminated, k1 and k2 (hashes of id and text, see row_keys)
    of every row of docs."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).where("size(words) > 0")
    items = cut(items.withColumn("length", F.least(F.size("words"), F.lit(span))))
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    rows = docs.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = ["k1", "k2", "doc_id"]
    rows = rows.select(*row_keys(F.col("doc_id"), F.col("text")), "doc_id", words_of(F.col("text")).alias("words"))
    marks = rows.select(*key, F.size("words").cast("long").alias("n_words"), F.lit(None).cast("struct<at:int,length:int>").alias("span"), F.lit(None).cast("array<string>").alias("items"))
    parts = [marks]
    for length in lengths:
        own = _windows(items.where(F.col("length") == length), length, k)
        window = own.select("item", F.explode_outer(F.transform("least", lambda h, i: F.struct(h.alias("fingerprint"), _window(i, length).alias("window")))).alias("w"))  # noqa: B023
        window = cut(window.groupBy("w.fingerprint", "w.window").agg(F.collect_set("item").alias("items")))
        size = window.agg(F.coalesce(F.sum(F.length("window") + 24 * F.size("items") + 64), F.lit(0))).first()[0]
        prints, base = window.select("fingerprint").distinct(), _windows(rows, length, k)
        own = _prints(base).drop("least")
        if size <= max_broadcast:
            prints, window = F.broadcast(prints.withColumn("met", F.lit(True))), F.broadcast(window.select("window", "items"))
            met = own.select(*key, "words", F.explode_outer("prints").alias("p")).join(prints, F.col("p.fingerprint") == F.col("fingerprint"))
        else:
            which = own.select(*key, F.explode_outer(F.array_distinct(F.transform("prints", lambda x: x["fingerprint"]))).alias("fingerprint")).join(prints, "fingerprint", "left_semi")
            which = which.groupBy("k1", "k2").agg(F.collect_set("fingerprint").alias("met"))
            met = own.join(which, ["k1", "k2"]).select(*key, "words", "met", F.explode_outer("prints").alias("p")).where("array_contains(met, p.fingerprint)")
        # a hit is extended to the windows of its run, each compared word by word
        extended = F.transform(F.sequence(F.col("p.first"), F.col("p.until") - 1), lambda i: F.struct(i.alias("at"), _window(i, length).alias("window")))  # noqa: B023
        found = met.select(*key, F.explode_outer(extended).alias("w")).select(*key, "w.at", "w.window").join(window.select("window", "items"), "window")
        parts.append(found.select(*key, F.lit(None).cast("long").alias("n_words"), F.struct("at", F.lit(length).alias("length")).alias("span"), "items"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    out = every.groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    start = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("int").alias("hit"))

    def widen(state: Column, s: Column) -> Column:
        end = s["at"] + s["length"]
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["hit"] + F.greatest(F.lit(0), end - F.greatest(state["end"], s["at"]))).alias("hit"))

    out = out.withColumn("n_hit", F.aggregate("spans", start, widen)["hit"].cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * numerator >= F.col("n_words"))).alias("contaminated"),
        "k1",
        "k2",
    )
