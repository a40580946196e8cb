"""Quality rules: per-text counts and lines that recur across a host's documents.

Method. Each line that has a word is normalised (A-Z folded, runs of white
space alike) and hashed; a line is boilerplate of its host when it stands in
more documents of it than both ``min_documents`` and ``max_share`` of them. It
is removed wherever it stands: ``removed`` has the byte spans, ``without`` cuts
them out of a text. A document that loses more than ``max_loss`` of its words
with them is depleted and rejected.

At scale. Texts are read once; what is shuffled is one hash per distinct line
and document, combined on the map side, so a line that every document has is
no hot key. The frequent lines meet the documents' hashes by broadcast only if
their number allows it, else in a shuffled join. The text itself is carried along
only for a caller that asks for it by ``keep``, as cleaned() does.

Edge cases. A null text has no words and fails the base rules; a null host is a
host of its own. Rows with equal or null ids are judged one by one. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm import bytetext as bt
from turnweave.llm.runtime import cut, small

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_row(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the padded bytes of each row are marked."""
    total = np.append(0, np.cumsum(mask))
    return np.diff(total[starts])


def _facts(padded: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(starts) - 1
    s, e, first = bt.words(padded, starts)
    raw = bt.prefix_hash(padded)
    word_chars = _per_row(~bt.IS_SPACE[padded] & ((padded & 0xC0) != 0x80), starts)
    symbols = _per_row(_SYMBOL[padded], starts)
    # 3-word windows that occur twice or more in their row
    row = bt.rows_of(first)
    exact = bt.span_hash(raw, s, e)
    gram = bt.gram_hashes(exact, 3)
    whole = np.flatnonzero(row[: len(gram)] == row[2:]) if len(gram) else np.zeros(0, np.int64)
    key = bt.mix(gram[whole] ^ (row[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 1)
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    again = whole[count[at] > 1]
    covered = np.zeros(len(row) + 3, bool)
    for j in range(3):
        covered[again + j] = True
    repeat = np.bincount(row[covered[: len(row)]], minlength=n)
    # lines: they end at a newline or where their row does
    ends = np.sort(np.concatenate([np.flatnonzero(padded == 10), starts[1:] - 1]))
    begins = np.append(starts[0], ends[:-1] + 1)
    a, b = np.searchsorted(s, begins), np.searchsorted(s, ends)
    some = b > a
    begins, ends, a, b = begins[some], ends[some], a[some], b[some]
    line_row = np.searchsorted(starts, begins, "right") - 1
    lines = bt.mix(bt.span_hash(raw, begins, ends) ^ (ends - begins).astype(np.uint64), 2)
    distinct, _, _ = bt.distinct_per_row(line_row, lines)
    duplicates = np.bincount(line_row, minlength=n) - np.bincount(distinct, minlength=n)
    folded = bt.word_hashes(padded, s, e)
    weight, inverse = bt.powers(len(folded) + 1)
    sums = np.append(np.uint64(0), np.cumsum(folded * weight[: len(folded)]))
    normal = bt.mix((sums[b] - sums[a]) * inverse[a], 9)
    hash_row, hashes, _ = bt.distinct_per_row(line_row, normal)
    # a line's own newline goes with it; the space that ends a row is not of it
    spans = begins - starts[line_row], np.minimum(ends + 1, starts[line_row + 1] - 1) - starts[line_row], b - a
    return np.diff(first), word_chars, symbols, duplicates, repeat, hash_row, hashes, line_row, normal, *spans


def _fact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, padded, starts in bt.chunks(batch.column(2)):
            facts = _facts(padded, starts)
            cuts, each = (pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)) for row in (facts[5], facts[7]))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(facts[6].view(np.int64)))]
            lists += [pa.ListArray.from_arrays(each, pa.array(x.astype(np.int64))) for x in (facts[8].view(np.int64), *facts[9:])]
            yield pa.RecordBatch.from_arrays(
                [c.slice(lo, hi - lo) for c in batch.columns[:2]] + [pa.array(c.astype(np.int64)) for c in facts[:5]] + lists + [c.slice(lo, hi - lo) for c in batch.columns[3:]],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line", "begin", "end", "line_words", *batch.schema.names[3:]],
            )


def without(text: Column, removed: Column) -> Column:
    """text without the byte spans of ``removed``, which are in order and apart."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    nothing = F.struct(F.array().cast("array<binary>").alias("parts"), F.lit(0).cast("long").alias("at"))
    substring = lambda begin, end: F.substring(data, (begin + 1).cast("int"), (end - begin).cast("int"))
    kept = F.aggregate(removed, nothing, lambda x, s: F.struct(F.array_append(x["parts"], substring(x["at"], s["begin"])).alias("parts"), s["end"].alias("at")))
    whole = F.concat(F.aggregate(kept["parts"], F.lit(b""), lambda x, p: F.concat(x, p)), substring(kept["at"], F.octet_length(data)))
    return F.when(F.size(removed) == 0, text).otherwise(whole.cast("string"))


def cleaned(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of quality() with ``text``, the text without its boilerplate lines."""
    out = quality(docs, text=text, keep=[F.col(text).alias("whole_text")], **options)
    return out.withColumn("text", without(F.col("whole_text"), F.col("removed"))).drop("whole_text")


def quality(
    docs: DataFrame,
    min_words: int = 50,
    repeat_percent: int = 50,
    min_documents: int = 20,
    max_share: float = 0.01,
    max_loss: float = 0.5,
    text: str = "text",
    ident: str = "doc_id",
    host: str = "source",
    keep: list[str | Column] | None = None,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_boilerplate_words, kept of every row, removed (the begin, end
    in bytes and words of its boilerplate lines, in order), and keep's columns."""
    kind, place = docs.schema[ident].dataType.simpleString(), docs.schema[host].dataType.simpleString()
    schema = f"doc_id {kind}, host {place}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line array<long>, begin array<long>, end array<long>, line_words array<long>"
    given = docs.select(F.col(ident).alias("doc_id"), F.col(host).alias("host"), F.coalesce(text, F.lit("")).alias("text"), *(keep or []))
    passed = given.columns[3:]
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[3:])
    facts = cut(given.mapInArrow(_fact_batches, schema).withColumn("row", F.monotonically_increasing_id()))
    limit = facts.groupBy("host").agg(F.greatest(F.lit(min_documents), F.count("*") * F.lit(max_share)).alias("most"))
    counted = facts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_documents)
    same = F.col("f.host").eqNullSafe(F.col("l.host"))
    frequent = cut(counted.alias("f").join(limit.alias("l"), same).where("f.n > l.most").select("f.host", "f.line"))
    each = facts.select("row", "host", F.explode("lines").alias("line"))
    hit = each.alias("f").join(small(frequent, 64).alias("l"), (F.col("f.line") == F.col("l.line")) & same).groupBy("row").agg(F.collect_set("f.line").alias("hit"))
    spans = F.filter(F.arrays_zip("line", "begin", "end", "line_words"), lambda x: F.array_contains("hit", x["line"]))
    removed = F.transform(spans, lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), x["line_words"].alias("words")))
    nothing = F.array().cast("array<struct<begin:bigint,end:bigint,words:bigint>>")
    out = facts.join(hit, "row", "left").withColumn("removed", F.when(F.col("hit").isNull(), nothing).otherwise(removed))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda x, s: x + s["words"])
    out = out.withColumn("n_boilerplate_words", gone)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    fits = F.col("n_boilerplate_words") <= max_loss * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_boilerplate_words", (~failed & fits).alias("kept"), "removed", *passed)
