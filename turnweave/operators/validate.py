"""Rules for evaluation cases: each finding has a rule's code, V1 to V33, and a message.

A line is parsed to a VARIANT, so that types are checked as they stand in the
JSON; rules are one array of conditions per stage, and a stage with findings
that make later rules meaningless ends the case, as documented per stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.text import category_of_dataset, content_words, strip, word_count

REQUIRED = ["case_id", "category", "history", "query", "gold_answer", "evidence_turn_ids"]
# Least and most turns of each category.
LENGTHS = {"lexical": (20, 40), "semantic": (20, 40), "buried": (80, 150), "duplicates": (30, 60), "long_evidence": (15, 30), "multi_evidence": (30, 60), "recency": (20, 40)}


def _none() -> Column:
    return F.array().cast("array<struct<code:string,message:string>>")


def _finding(code: str, *message) -> Column:
    text = F.concat_ws(" ", *[m if isinstance(m, Column) else F.lit(m) for m in message])
    return F.struct(F.lit(code).alias("code"), text.alias("message"))


def _one(code: str, cond: Column, *message) -> Column:
    """An array with the finding if cond holds, else empty."""
    return F.when(cond, F.array(_finding(code, *message))).otherwise(_none())


def _each(code: str, items: Column | str, cond, message) -> Column:
    """A finding for each item i that cond(item, i) holds for."""
    found = F.transform(items, lambda x, i: F.when(cond(x, i), _finding(code, *message(x, i))))
    return F.coalesce(F.filter(found, lambda f: f.isNotNull()), _none())


def _is(kind: str, value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def _get(name: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", "variant")


def _text(value: Column) -> Column:
    return F.when(_is("STRING", value), F.try_variant_get(value, "$", "string"))


def _blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def validate_lines(lines: DataFrame) -> DataFrame:
    """line_no, case_id, category, n_turns, errors, warnings (codes, one for
    each turn, part or id at fault), error_messages, warning_messages of
    tolerant lines (line_no, line, is_fence); a fence has only the warning V32.

    Stages: V33 (JSON), V1, V2; V3-V7; V8-V11; V12-V14; V15-V16; V17-V30. A
    stage with an error ends the case, but for V15 and V17-V23, which do not.
    V31 marks lines whose case_id an earlier line had.
    """
    rows = lines.withColumn("v", F.when(~F.col("is_fence"), F.try_parse_json("line")))
    present = F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>"))
    is_object = _is("OBJECT", F.col("v"))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), present)
    first = F.concat(
        _one("V33", F.col("v").isNull(), "invalid JSON"),
        _one("V1", F.col("v").isNotNull() & ~is_object, "no JSON object"),
        _one("V2", is_object & (F.size(missing) > 0), "missing", F.array_join(F.array_sort(missing), ", ")),
    )
    rows = rows.withColumns({"e1": F.when(F.col("is_fence"), _none()).otherwise(first)})
    rows = rows.withColumns(
        {
            "case_id": _text(_get("case_id")),
            "category": category_of_dataset(F.coalesce(_text(_get("category")), F.lit("?"))),
            "query": _text(_get("query")),
            "gold": _text(_get("gold_answer")),
            "items": F.when(_is("ARRAY", _get("history")), F.try_variant_get("v", "$.history", "array<variant>")),
            "raw_ids": F.when(_is("ARRAY", _get("evidence_turn_ids")), F.try_variant_get("v", "$.evidence_turn_ids", "array<variant>")),
        }
    )
    turn = lambda x: F.struct(_is("OBJECT", x).alias("ok"), _text(F.try_variant_get(x, "$.role", "variant")).alias("role"), _text(F.try_variant_get(x, "$.content", "variant")).alias("content"))
    rows = rows.withColumns({"turns": F.transform("items", turn), "all_int": F.coalesce(F.forall("raw_ids", lambda x: _is("BIGINT", x)), F.lit(False))})
    rows = rows.withColumn("ids", F.when(F.col("all_int"), F.transform("raw_ids", lambda x: F.try_variant_get(x, "$", "bigint"))))
    n = F.coalesce(F.size("turns"), F.lit(0))
    has_turns = F.coalesce(F.size("turns") > 0, F.lit(False))
    rows = rows.withColumn("n_turns", F.when(has_turns, n).otherwise(0))
    second = F.concat(
        _one("V3", _blank(F.col("case_id")), "case_id is no text or blank"),
        _one("V4", ~F.col("category").isin(*LENGTHS), "unknown category", F.col("category")),
        _one("V5", _blank(F.col("query")), "query is no text or blank"),
        _one("V6", _blank(F.col("gold")), "gold_answer is no text or blank"),
        _one("V7", ~has_turns, "history is no list or empty"),
    )
    speaks = lambda t: F.coalesce(t["role"].isin("user", "assistant"), F.lit(False))
    due = lambda i: F.when(i % 2 == 0, "user").otherwise("assistant")
    at = lambda t, i: ("turn", i.cast("string"))
    third = F.concat(
        _each("V8", "turns", lambda t, i: ~t["ok"], lambda t, i: (*at(t, i), "is no object")),
        _each("V9", "turns", lambda t, i: t["ok"] & ~speaks(t), lambda t, i: (*at(t, i), "has the role", F.coalesce(t["role"], F.lit("none")))),
        _each("V10", "turns", lambda t, i: t["ok"] & speaks(t) & (t["role"] != due(i)), lambda t, i: (*at(t, i), "should be of", due(i))),
        _each("V11", "turns", lambda t, i: t["ok"] & _blank(t["content"]), lambda t, i: (*at(t, i), "has no text")),
    )
    rows = rows.withColumn("e2", F.when((F.size("e1") == 0) & ~F.col("is_fence"), F.concat(second, third)).otherwise(_none()))
    live = (F.size("e1") == 0) & (F.size("e2") == 0) & ~F.col("is_fence")
    some_ids = F.coalesce(F.size("raw_ids") > 0, F.lit(False))
    outside = F.coalesce(F.filter("ids", lambda i: (i < 0) | (i >= n)), F.array().cast("array<bigint>"))
    joined = lambda ids: F.array_join(F.transform(ids, lambda i: i.cast("string")), ", ")
    fourth = (
        F.when(~some_ids, F.array(_finding("V12", "evidence_turn_ids is no list or empty")))
        .when(~F.col("all_int"), F.array(_finding("V13", "evidence_turn_ids has other things than integers")))
        .when(F.size(outside) > 0, F.array(_finding("V14", "no such turns:", joined(outside))))
        .otherwise(_none())
    )
    rows = rows.withColumn("e3", F.when(live, fourth).otherwise(_none()))
    live = live & (F.size("e3") == 0)
    rows = rows.withColumn("parts", F.transform(F.split("gold", r" \| "), strip))
    fifth = F.concat(
        _one("V15", F.size(F.array_distinct("ids")) != F.size("ids"), "evidence_turn_ids repeats a turn"),
        _one("V16", F.exists("parts", lambda p: p == ""), "gold_answer has an empty part"),
    )
    rows = rows.withColumn("e4", F.when(live, fifth).otherwise(_none()))
    live = live & ~F.exists("e4", lambda f: f["code"] == "V16")
    text_of = lambda i: F.get("turns", i.cast("int"))["content"]
    rows = rows.withColumns({"live": live, "evidence": F.when(live, F.transform("ids", text_of)), "n_parts": F.size("parts")})
    multi = F.col("category") == "multi_evidence"
    one = F.get("parts", F.lit(0))
    leaks = lambda t, i: F.when(
        ~F.array_contains(F.col("ids"), i.cast("bigint")),
        _each("V24", "parts", lambda p, _: F.contains(F.lower(t["content"]), F.lower(p)), lambda p, _: (*at(t, i), "gives away", p)),
    ).otherwise(_none())
    sixth = F.concat(
        _one("V17", multi & (F.col("n_parts") < 2), "multi_evidence needs two gold parts"),
        _one("V18", multi & (F.size("ids") < 2), "multi_evidence needs two evidence turns"),
        _each("V21", "ids", lambda i, _: (F.col("n_parts") == 1) & ~F.contains(text_of(i), one), lambda i, _: ("gold_answer does not stand in turn", i.cast("string"))),
        _each("V22", "parts", lambda p, _: (F.col("n_parts") > 1) & ~F.exists("evidence", lambda t: F.contains(t, p)), lambda p, _: ("no evidence turn has", p)),
        _each("V23", "ids", lambda i, _: (F.col("n_parts") > 1) & ~F.exists("parts", lambda p: F.contains(text_of(i), p)), lambda i, _: ("no gold part stands in turn", i.cast("string"))),
        F.flatten(F.transform("turns", leaks)),
    )
    bounds = F.create_map(*[F.lit(x) for k, v in LENGTHS.items() for x in (k, f"{v[0]} {v[1]}")])
    low, high = (F.split(F.try_element_at(bounds, F.col("category")), " ")[i].cast("int") for i in (0, 1))
    shared = F.array_intersect(content_words(F.col("query")), content_words(F.array_join("evidence", " ")))
    size, which = F.col("n_turns"), lambda i, _: ("turn", i.cast("string"))
    is_ = lambda name: F.col("category") == name
    warnings = F.concat(
        _one("V19", ~multi & (F.col("n_parts") > 1), "several gold parts, but not multi_evidence"),
        _each("V20", "parts", lambda p, _: word_count(p) > 6, lambda p, _: ("more than 6 words:", p)),
        _each("V25", "parts", lambda p, _: F.contains(F.lower("query"), F.lower(p)), lambda p, _: ("the query gives away", p)),
        _one("V26", (size < low) | (size > high), size.cast("string"), "turns, not", low.cast("string"), "to", high.cast("string")),
        _one("V27", is_("semantic") & (F.size(shared) > 0), "the query shares", F.array_join(F.array_sort(shared), ", ")),
        _each("V28", "ids", lambda i, _: is_("long_evidence") & ~word_count(text_of(i)).between(150, 300), lambda i, _: (*which(i, _), "has not 150 to 300 words")),
        _each("V29", "ids", lambda i, _: is_("buried") & ((i < size / 3) | (i > 2 * size / 3)), lambda i, _: (*which(i, _), "is not in the middle third")),
        _each("V30", "ids", lambda i, _: is_("recency") & (i < size - 2), lambda i, _: (*which(i, _), "is not one of the last two")),
    )
    before = F.min("line_no").over(Window.partitionBy("case_id"))
    repeated = _one("V31", ~_blank(F.col("case_id")) & (before < F.col("line_no")), "case_id stands on line", before.cast("string"), "too")
    rows = rows.withColumns(
        {
            "bad": F.concat("e1", "e2", "e3", "e4", F.when(F.col("live"), sixth).otherwise(_none()), repeated),
            "odd": F.when(F.col("is_fence"), F.array(_finding("V32", "a Markdown fence, passed over"))).when(F.col("live"), warnings).otherwise(_none()),
        }
    )
    part = lambda c, name: F.transform(c, lambda f: f[name])
    return rows.select(
        "line_no",
        "case_id",
        "category",
        "n_turns",
        part("bad", "code").alias("errors"),
        part("odd", "code").alias("warnings"),
        (~F.col("is_fence")).alias("is_case"),
        part("bad", "message").alias("error_messages"),
        part("odd", "message").alias("warning_messages"),
    )


def report_lines(found: DataFrame) -> DataFrame:
    """line_no, case_id, level, code, message: a row for each finding."""
    of = lambda level, codes, texts: F.transform(F.arrays_zip(codes, texts), lambda x: F.struct(F.lit(level).alias("level"), x[codes].alias("code"), x[texts].alias("message")))
    return found.select("line_no", "case_id", F.inline(F.concat(of("error", "errors", "error_messages"), of("warning", "warnings", "warning_messages"))))


def category_counts(found: DataFrame) -> DataFrame:
    """category, n_cases of the cases that have an id."""
    return found.where("is_case and case_id is not null").groupBy("category").agg(F.count("*").alias("n_cases"))


def summarize_validation(found: DataFrame, strict: bool = False) -> DataFrame:
    """One row: cases, usable cases, errors, warnings, lengths, PASS or FAIL (V34)."""
    n_err, n_warn = F.size("errors"), F.size("warnings")
    usable = F.col("is_case") & (n_err == 0) & ((n_warn == 0) | F.lit(not strict))
    out = found.agg(
        F.count_if("is_case").alias("n_cases"),
        F.count_if(usable).alias("n_usable"),
        F.coalesce(F.sum(n_err), F.lit(0)).alias("n_errors"),
        F.coalesce(F.sum(n_warn), F.lit(0)).alias("n_warnings"),
        F.min(F.when(F.col("n_turns") > 0, F.col("n_turns"))).alias("min_turns"),
        F.max("n_turns").alias("max_turns"),
        F.avg(F.when(F.col("n_turns") > 0, F.col("n_turns"))).alias("mean_turns"),
    )
    failed = (F.col("n_errors") > 0) | (F.lit(strict) & (F.col("n_warnings") > 0))
    return out.withColumn("status", F.when(failed, "FAIL").otherwise("PASS"))
