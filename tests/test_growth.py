"""Plans and steps whose moved and held bytes must stay in step with the input."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnweave.functions.vectors import DIM, hashed_embeddings
from turnweave.operators import condense
from turnweave.operators.condense import prune_by_information, word_information
from turnweave.operators.relevance import bm25
from turnweave.plans import compress as plan
from turnweave.plans.evaluate import sweep
from turnweave.plans.queries import score_only


def above(plan, name):
    """The nodes of a chain over the first one called name."""
    while plan.nodeName() != name:
        yield plan
        plan = plan.children().head()


def kinds(node):
    output = node.output()
    return [output.apply(i).dataType().simpleString() for i in range(output.size())]


def test_term_rows_hold_no_query(spark):
    rows = [(c, i, f"w{i} the invoice number {i} and the refund", "the refund the invoice") for c in (1, 2) for i in range(3)]
    out = bm25(spark.createDataFrame(rows, "conv_id long, turn_id int, content string, query string"), ["conv_id"], "turn_id", "content", "query")
    nodes = list(above(out._jdf.queryExecution().optimizedPlan(), "Generate"))
    assert any(n.nodeName() == "Window" for n in nodes)
    assert not [k for n in nodes for k in kinds(n) if k.startswith("array")]


def test_bm25_of_missing_texts(spark):
    rows = [(1, 0, "pay the invoice", "the invoice"), (1, 1, None, "the invoice"), (1, 2, "...", "the invoice"), (1, 3, "the the hills", "the invoice"), (2, 0, "alone", None), (3, 0, None, None)]
    out = bm25(spark.createDataFrame(rows, "conv_id long, turn_id int, content string, query string"), ["conv_id"], "turn_id", "content", "query")
    got = {(r.conv_id, r.turn_id): r.bm25 for r in out.collect()}
    # "the" is in half of the rows, which weighs nothing
    assert len(got) == 6 and got.pop((1, 0)) > 0 and set(got.values()) == {0.0}


def test_embeddings_of_odd_texts(spark):
    rows = [(1, 0, "Pay the invoice, PAY the Invoice"), (1, 1, None), (1, 2, "... \u00e9"), (2, 0, "twice a key"), (2, 0, "a key twice"), (None, 3, "no key"), (3, 0, "word " * 5000)]
    out = hashed_embeddings(spark.createDataFrame(rows, "conv_id long, turn_id int, content string"), ["conv_id", "turn_id"], "content")
    made = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in made and made.count("Aggregate") == 1
    want = {(c, t): Counter() for c, t, _ in rows}
    for c, t, text in rows:
        want[c, t].update(int(hashlib.md5(w.encode()).hexdigest()[-2:], 16) % DIM for w in re.findall("[a-z0-9]+", (text or "").lower()))
    got = {(r.conv_id, r.turn_id): r.embedding for r in out.collect()}
    assert got == {k: [float(n[i]) for i in range(DIM)] for k, n in want.items()}


def test_scores_make_rows_of_single_words_once(spark):
    made = score_only(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    generate = re.findall(r"Generate .*", made.toString())
    assert len(generate) == 1 and "array_intersect" in generate[0]


@pytest.fixture
def turns(spark):
    rows = [(c, i, "user", f"The pay{i % 3} of c{c} is due. We pay {i} times! Ask w{i} again?") for c in range(1, 5) for i in range(8)]
    return spark.createDataFrame(rows, "conv_id long, turn_id int, role string, content string").withColumn("token_count", F.lit(13)).withColumn("query", F.lit("when is pay2 due"))


def test_a_sweep_ranks_once(spark, turns, monkeypatch):
    calls = []
    for module, name in ((plan, "assign_survivors"), (plan, "hybrid_score"), (plan, "count_bigrams"), (condense, "count_bigrams")):
        monkeypatch.setattr(module, name, (lambda f, n: lambda *a, **b: calls.append(n) or f(*a, **b))(getattr(module, name), name), raising=False)
    cases = spark.createDataFrame([(c, str(c), "lexical", "The pay1 of") for c in range(1, 5)], "conv_id long, case_id string, category string, gold_answer string")
    got = sweep(turns, cases, methods=("pipeline",), budgets=(0.2, 0.4, 0.8)).collect()
    assert sorted(calls) == ["assign_survivors", "count_bigrams", "hybrid_score"]
    assert all(r.error is None and r.latency_ms > 0 for r in got)
    for b in (0.2, 0.4, 0.8):
        alone = {str(r.conv_id): r.compressed_tokens for r in plan.compress(turns, plan.Config(budget_fraction=b)).collect()}
        assert {r.case_id: r.compressed_tokens for r in got if r.budget_frac == b} == alone


def test_allocation_holds_no_text(spark, turns, monkeypatch):
    seen = []
    monkeypatch.setattr(plan, "allocate_tiers", (lambda f: lambda rows, *a, **b: seen.append(set(rows.columns)) or f(rows, *a, **b))(plan.allocate_tiers))
    assert plan.compress(turns, plan.Config(budget_fraction=0.4)).count() == 4
    assert len(seen) == 1 and not seen[0] & {"content", "query", "role"}


def test_counts_are_looked_up_by_pair(spark):
    texts = spark.createDataFrame([(1, "The cat and THE dog"), (2, "the cat"), (3, "One"), (4, " "), (5, None)], "k int, text string")
    info = word_information(texts, ["k"], "text")
    plans = info._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plans and plans.count("Join LeftOuter") == 3
    got = {(r.k, r.pos): (r.word, r.info) for r in info.collect()}
    assert [got[1, i][0] for i in range(5)] == ["The", "cat", "and", "THE", "dog"] and got[3, 0] == ("One", 0.0) and len(got) == 8
    # two of the three words after "the", among four second words; the only one after "cat"
    assert got[1, 1] == got[2, 1] == ("cat", round(-math.log(2.1 / 3.4), 6)) and got[1, 2] == ("and", round(-math.log(1.1 / 1.4), 6))
    assert {r.k: r.text for r in prune_by_information(info, ["k"], 1.0).collect()} == {1: "The cat and THE dog", 2: "the cat", 3: "One"}
