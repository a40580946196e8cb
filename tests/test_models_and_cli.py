"""Model hooks with stand-in models, and the command line."""

import json
import sys

import pytest
from pyspark import cloudpickle

from turnweave import cli
from turnweave.functions import models
from turnweave.plans.compress import Config, compress, turns_of
from turnweave.sources.jsonl import read_cases


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


def lengths():
    return lambda texts: [[float(len(t) > 50), float(len(t) <= 50)] for t in texts]


def halves():
    """Tokens of up to three characters, each with its place as information."""

    def model(text):
        return [(i, min(i + 3, len(text)), float(i)) for i in range(0, len(text), 3) if text[i : i + 3].strip()]

    return model


def test_word_spans(spark):
    texts = spark.createDataFrame([(1, "  ab  cde f "), (2, "x"), (3, " ")], "k int, t string")
    got = [(r.k, r.pos, r.word, r.begin, r.end) for r in models.word_spans(texts, ["k"], "t").orderBy("k", "pos").collect()]
    assert got == [(1, 0, "ab", 2, 4), (1, 1, "cde", 6, 9), (1, 2, "f", 10, 11), (2, 0, "x", 0, 1)]
    assert all("  ab  cde f "[b:e] == w for k, _, w, b, e in got if k == 1)


def test_overlapping_tokens_are_summed(spark):
    texts = spark.createDataFrame([(1, "abcd ef ghijk")], "k int, t string")
    want, text = {}, "abcd ef ghijk"
    for b, e in ((0, 4), (5, 7), (8, 13)):
        want[text[b:e]] = sum(x for tb, te, x in halves()(text) if tb < e and te > b)
    got = {r.word: r.info for r in models.model_information(texts, ["k"], "t", "halves", halves).collect()}
    assert got == want


def test_hooks_in_a_run(spark):
    history = spark.createDataFrame([(7, "refund", [("user", " ".join("w%d" % i for i in range(60))), ("assistant", "ok then")])], "conv_id long, query string, history array<struct<role:string,content:string>>")
    config = Config(token_budget=40, preserve_recent_n=1, embedder=models.embedder("lengths", lengths), pruner=models.pruner("halves", halves, ["conv_id", "turn_id"]))
    got = compress(turns_of(history), config).first()
    assert got.tier_assignment == {0: "COMPRESS", 1: "KEEP_RECENT"}
    kept = got.messages[0].content.split()
    text, spans, at = " ".join("w%d" % i for i in range(60)), [], 0
    for word in text.split():
        spans.append((at, at + len(word)))
        at += len(word) + 1
    info = [sum(x for b, e, x in halves()(text) if b < end and e > begin) for begin, end in spans]
    best = sorted(sorted(range(60), key=lambda i: (-info[i], i))[:18])
    assert kept == ["w%d" % i for i in best]


@pytest.fixture
def path(tmp_path):
    def one(name, evidence):
        history = [{"role": "user" if i % 2 == 0 else "assistant", "content": f"filler number {i}"} for i in range(20)]
        history[evidence]["content"] = "the code is 4471"
        return {"case_id": name, "category": "recency", "history": history, "query": "which pin", "gold_answer": "4471", "evidence_turn_ids": [evidence]}

    file = tmp_path / "cases.jsonl"
    file.write_text("".join(json.dumps(one(name, at)) + "\n" for name, at in (("a", 19), ("b", 2), ("c", 18))))
    return file


def test_evaluate(spark, path, tmp_path, capsys):
    out = str(tmp_path / "report")
    assert cli.main(["evaluate", str(path), "--out-dir", out, "--methods", "full_context,last_n", "--budgets", "0.2", "--limit", "2", "--by-category", "--no-plot"]) == 0
    said = capsys.readouterr().out.splitlines()
    row = next(x.split() for x in said if x.startswith("last_n"))
    assert row[:3] == ["last_n", "0.2", "2"] and row[5] == "0.5"
    assert any("answer rate at budget 0.2" in x for x in said)
    results = spark.read.option("header", True).csv(f"{out}/results")
    assert results.count() == 4 and results.columns[-1] == "error"
    for bad in (["--budgets", "2"], ["--budgets", "x"], ["--methods", "magic"]):
        with pytest.raises(SystemExit):
            cli.main(["evaluate", str(path), *bad])


def test_validate(spark, path, capsys):
    assert cli.main(["validate", str(path)]) == 0 and cli.main(["validate", str(path), "--strict"]) == 1
    said = capsys.readouterr().out
    assert "line 2 [b] warning V30" in said and "recency: 3" in said
    with path.open("a") as f:
        f.write("{broken\n")
    assert cli.main(["validate", str(path)]) == 1 and "V33" in capsys.readouterr().out
    assert cli.main(["validate", str(path) + "x"]) == 1
    with pytest.raises(Exception, match="cases.jsonl:4: invalid JSON"):
        read_cases(spark, str(path)).collect()


def test_compress(spark, path, tmp_path):
    assert cli.main(["compress", str(path), str(tmp_path / "out"), "--budget", "30"]) == 0
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_each_fault_is_a_finding(spark):
    from turnweave.operators.validate import category_counts, report_lines, summarize_validation, validate_lines

    history = [{"role": "user" if i % 2 == 0 else "assistant", "content": "4471 here"} for i in range(20)]
    case = {"case_id": "a", "category": "recency", "history": history, "query": "which", "gold_answer": "4471", "evidence_turn_ids": [19]}
    worse = case | {"case_id": "b", "history": [3, {"role": "x", "content": ""}, *history[2:]]}
    df = spark.createDataFrame([(1, json.dumps(case), False), (2, json.dumps(worse), False)], "line_no long, line string, is_fence boolean")
    found = validate_lines(df)
    got = {r.line_no: r for r in found.collect()}
    assert got[1].errors == ["V24"] * 19 and got[2].errors == ["V8", "V9", "V11"]
    assert got[1].error_messages[0] == "turn 0 gives away 4471" and summarize_validation(found).first().n_errors == 22
    assert report_lines(found).count() == 22 and [tuple(r) for r in category_counts(found).collect()] == [("recency", 2)]
