"""URL filter: a blocked Bloom filter in front of an exact hash join.

Method. Listed canonical URLs (host, then path prefix) are hashed into a
blocked Bloom filter: one 256-bit block per entry, one bit in each of its four
64-bit lanes. A page's candidates are its host and parent domains joined with
those prefixes of its path that have a listed length; only candidates that pass
the filter meet the list, in an exact join that removes false positives. All of
it is built-in column functions.

At scale. The filter is a table of blocks that meets the candidates by block
number, broadcast once its rows are counted: at most ``max_words`` 64-bit words.
For a longer list the candidates go to the exact join directly, which Spark
shuffles (and splits where a key is hot); the result is the same. Every page has
a row of its own beside its candidates, under a key of its own, so pages without
a listed candidate are no hot key there. Pages are scanned once, for their id
and URL; what is left is combined by page before it is shuffled.

Edge cases. A null URL, or one without ``://``, has an empty host and path. A
key listed twice blocks if either entry blocks. Entries with a rule name win
over those without; then the longest wins, then the greater string. Repeated
and null page ids are judged row by row. An empty list allows everything; extra
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.runtime import cut, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LANES = 4


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, lane: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("lanes")), 6 * lane).bitwiseAND(F.lit(63)).cast("int")


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0, ..., w3): the filter's blocks that have a bit set."""
    mask = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("key"), i))
    return listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*[F.bit_or(mask(i)).alias(f"w{i}") for i in range(_LANES)])


def _may_be_listed(key: Column) -> Column:
    """Not true if the key is surely not in the filter whose block stands beside it."""
    bits = [F.call_function("shiftrightunsigned", F.col(f"w{i}"), _bit(key, i)).bitwiseAND(F.lit(1)) for i in range(_LANES)]
    return reduce(Column.bitwiseAND, bits) == 1


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow", bits_per_key: int = 16, max_words: int = 1 << 21, url: str = "url", ident: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, listed_key of every page.

    listed: (key, verdict, rule): key is a host followed by a path prefix, rule
    a name to report or null.
    """
    listed = listed.groupBy("key").agg(F.max("verdict").alias("listed_verdict"), F.max("rule").alias("rule"))
    listed = cut(listed.withColumn("path_length", F.length("key") - F.length(F.substring_index("key", "/", 1))))
    n, labels = listed.agg(F.count("*"), F.coalesce(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))), F.lit(1))).first()
    lengths = sorted(r[0] for r in listed.select("path_length").distinct().collect())
    rows = pages.select(F.col(ident).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.greatest(F.size(parts) - (labels - 1), F.lit(1)), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.lit(1 << 20)), "."))
    prefix = [F.when(F.length("path") >= k, F.substring("path", 1, k) if k else F.lit("")) for k in lengths]
    heads = F.array_compact(F.array(*prefix)) if prefix else F.array().cast("array<string>")
    keys = F.flatten(F.transform(parents, lambda host: F.transform(heads, lambda head: F.concat(host, head))))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    own = F.struct(F.concat(F.lit("\0"), F.col("row").cast("string")).alias("key"), F.lit(True).alias("own"))
    asked = F.array_append(F.transform(keys, lambda key: F.struct(key.alias("key"), F.lit(False).alias("own"))), own)
    rows = rows.select("row", "page_id", "host", "path", F.inline(asked))
    blocks = max(1, -(-n * bits_per_key // (64 * _LANES)))
    if blocks * _LANES <= max_words:
        bloom = small(cut(bloom_blocks(listed, blocks)), 64)
        rows = rows.withColumn("block", _block(F.col("key"), blocks)).join(bloom, "block", "left").where(F.col("own") | _may_be_listed(F.col("key")))
    found = rows.select("row", "page_id", "host", "path", "key", "own").join(small(listed.drop("path_length"), 256), "key", "left")
    best = F.max(F.when(~F.col("own") & F.col("listed_verdict").isNotNull(), F.struct(F.col("rule").isNotNull().alias("named"), F.length("key").alias("length"), "key", "rule", "listed_verdict"))).alias("best")
    found = found.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best)
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.listed_verdict", F.lit(default)).alias("verdict"), F.col("best.key").alias("listed_key"))
