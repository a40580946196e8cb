"""Adapter, evaluation, validator, sources, streaming and the driver contract."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from turnweave.operators.validate import summarize_validation, validate_lines
from turnweave.plans.adapter import REMOVE_ALL, node
from turnweave.plans.compress import Config
from turnweave.plans.evaluate import category_pivot, grid, summarize, sweep, timed
from turnweave.sources.jsonl import numbered_lines, read_cases, tolerant_lines, write_csv
from turnweave.streaming.incremental import compress_stream


class HumanMessage:
    content = "old words"


def test_node(spark):
    run = node(spark, Config(), overwrite=False)
    out = run({"messages": [HumanMessage(), {"type": "ai", "content": "yes"}, {"role": "user", "content": "now"}]})
    assert out == {"messages": [{"role": "user", "content": "old words"}, {"role": "assistant", "content": "yes"}, {"role": "user", "content": "now"}]}
    assert node(spark)({"messages": [{"role": "user", "content": "x"}]})["messages"] == [REMOVE_ALL, {"role": "user", "content": "x"}]
    assert run({"messages": []}) == {"messages": []}
    for state, error in (({}, KeyError), ({"messages": "x"}, TypeError), ({"messages": [{"role": "user", "content": 3}]}, TypeError), ({"messages": [{"role": "system", "content": "x"}]}, ValueError), ({"messages": [{"role": "user", "content": " "}]}, ValueError)):
        with pytest.raises(error):
            run(state)


def case(**changes):
    history = [{"role": "user" if i % 2 == 0 else "assistant", "content": f"filler number {i}"} for i in range(20)]
    history[19]["content"] = "the code is 4471"
    return {"case_id": "a", "category": "recency", "history": history, "query": "which pin", "gold_answer": "4471", "evidence_turn_ids": [19]} | changes


def findings(spark, *values):
    lines = [v if isinstance(v, str) else json.dumps(v) for v in values]
    df = spark.createDataFrame([(i + 1, x, x.startswith("```")) for i, x in enumerate(lines)], "line_no long, line string, is_fence boolean")
    return [(r.errors, r.warnings) for r in validate_lines(df).orderBy("line_no").collect()]


def test_validator(spark):
    h = case()["history"]
    turn = lambda i, **c: [x | c if k == i else x for k, x in enumerate(h)]
    expected = [
        (case(), [], []),
        ("{bad", ["V33"], []),
        ("[1]", ["V1"], []),
        ({"case_id": "zz"}, ["V2"], []),
        (case(case_id=" "), ["V3"], []),
        (case(case_id="b", category="odd"), ["V4"], []),
        (case(case_id="c", query=""), ["V5"], []),
        (case(case_id="d", gold_answer=7), ["V6"], []),
        (case(case_id="e", history=[]), ["V7"], []),
        (case(case_id="f", history=[*h[:5], 3, *h[6:]]), ["V8"], []),
        (case(case_id="g", history=turn(2, role="system")), ["V9"], []),
        (case(case_id="h", history=turn(2, role="assistant")), ["V10"], []),
        (case(case_id="i", history=turn(2, content=" ")), ["V11"], []),
        (case(case_id="j", evidence_turn_ids=[]), ["V12"], []),
        (case(case_id="k", evidence_turn_ids=[True]), ["V13"], []),
        (case(case_id="l", evidence_turn_ids=[20]), ["V14"], []),
        (case(case_id="m", evidence_turn_ids=[19, 19]), ["V15"], []),
        (case(case_id="n", gold_answer="4471 | "), ["V16"], []),
        (case(case_id="o", category="multi_evidence"), ["V17", "V18"], ["V26"]),
        (case(case_id="p", gold_answer="4471 | code"), [], ["V19"]),
        (case(case_id="q", gold_answer="4472"), ["V21"], []),
        (case(case_id="r", gold_answer="4471 | nowhere"), ["V22"], ["V19"]),
        (case(case_id="s", history=turn(3, content="it is 4471 too")), ["V24"], []),
        (case(case_id="t", query="is it 4471"), [], ["V25"]),
        (case(case_id="u", history=turn(18, content="x"), category="lexical", evidence_turn_ids=[19]), [], []),
        (case(case_id="v", category="semantic", query="what code please"), [], ["V27"]),
        (case(case_id="w", category="long_evidence"), [], ["V28"]),
        (case(case_id="x", category="buried"), [], ["V26", "V29"]),
        (case(), ["V31"], []),
        ("```json", [], ["V32"]),
    ]
    got = findings(spark, *[e[0] for e in expected])
    for (_, errors, warnings), found in zip(expected, got):
        assert found == (errors, warnings)


def test_validation_summary(spark):
    df = spark.createDataFrame([(1, json.dumps(case()), False), (2, "{", False), (3, "```", True)], "line_no long, line string, is_fence boolean")
    r = summarize_validation(validate_lines(df)).first()
    assert (r.n_cases, r.n_usable, r.n_errors, r.n_warnings, r.status) == (2, 1, 1, 1, "FAIL")


def test_summary_rows(spark):
    rows = [("last_n", 0.1, "b", 10.0, 2.0, 1.0, 1.0, 1), ("last_n", 0.1, "a", 20.0, float("inf"), 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "method string, budget_frac double, category string, token_reduction_pct double, compression_ratio double, evidence_recall double, answer_present double, within_budget int")
    out = summarize(df)
    got = [(r.category, r.n_cases, r.mean_token_reduction_pct, r.mean_compression_ratio, r.within_budget_rate, r.n_errors) for r in out.collect()]
    assert got == [("ALL", 2, 15.0, 2.0, 1.0, 0), ("a", 1, 20.0, None, None, 0), ("b", 1, 10.0, 2.0, 1.0, 0)]
    assert category_pivot(out, ["a", "b"]).first().asDict() == {"budget_frac": 0.1, "method": "last_n", "a": 0.0, "b": 1.0}
    assert grid(["full_context", "last_n"], (0.2,)) == [("full_context", 1.0), ("last_n", 0.2)]
    with pytest.raises(ValueError):
        grid(["nothing"])
    assert timed(lambda: 1 / 0)[2].startswith("ZeroDivisionError")


def test_sweep_keeps_failures(spark):
    def broken(turns):
        raise RuntimeError("no scores")

    rows = [(c, i, "user", "w%d says yes" % i, 3, "yes") for c in (1, 2) for i in range(6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn_id int, role string, content string, token_count int, query string")
    cases = spark.createDataFrame([(1, "a", "recency", "w5 says"), (2, "b", "lexical", "w1 says")], "conv_id long, case_id string, category string, gold_answer string")
    out = sweep(turns, cases, methods=("last_n", "pipeline"), budgets=(0.3, 0.5), config=Config(scorer=broken))
    got = {(r.case_id, r.method, r.budget_frac): r for r in out.collect()}
    assert len(got) == 8 and all(r.latency_ms > 0 for r in got.values())
    assert {(r.error, r.compressed_tokens, r.evidence_recall, r.within_budget) for k, r in got.items() if k[1] == "pipeline"} == {("RuntimeError: no scores", 0, 0.0, None)}
    assert {(r.error, r.within_budget) for k, r in got.items() if k[1] == "last_n"} == {(None, 1)} and got["a", "last_n", 0.5].evidence_recall == 1.0
    total = {(r.method, r.budget_frac): (r.n_errors, r.mean_latency_ms > 0) for r in summarize(out).where("category = 'ALL'").collect()}
    assert total == {("last_n", 0.3): (0, True), ("last_n", 0.5): (0, True), ("pipeline", 0.3): (2, True), ("pipeline", 0.5): (2, True)}


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text(json.dumps(case()) + "\n\n```\n" + json.dumps(case(case_id="b")) + "\n")
    assert [(r.line_no, r.is_fence) for r in tolerant_lines(spark, str(path)).orderBy("line_no").collect()] == [(1, False), (3, True), (4, False)]
    assert numbered_lines(spark, str(path)).count() == 4
    clean = tmp_path / "clean.jsonl"
    clean.write_text(json.dumps(case()) + "\n")
    assert read_cases(spark, str(clean)).first().evidence_turn_ids == [19]
    write_csv(spark.createDataFrame([(1, "ä")], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().b == "ä"


def test_stream(spark, tmp_path):
    schema = "conv_id long, turn_id int, role string, content string"
    feed = str(tmp_path / "feed")
    spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "hi")], schema).write.parquet(feed)
    run = lambda: compress_stream(spark.readStream.schema(schema).parquet(feed), str(tmp_path / "h"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    run()
    spark.createDataFrame([(1, 2, "user", "and now")], schema).write.mode("append").parquet(feed)
    run()
    got = {r.batch: len(r.messages) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {0: 1, 1: 2}
    spark.createDataFrame([(1, 1, "assistant", "hi once more"), (2, 0, "user", "alone"), (2, 1, "user", "not any more")], schema).write.mode("append").parquet(feed)
    run()
    last = {r.conv_id: [m.content for m in r.messages] for r in spark.read.parquet(str(tmp_path / "o")).where("batch = 2").collect()}
    assert last == {1: ["hello there", "hi once more"], 2: ["alone"]}


def test_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "compress_pipeline" in queries
