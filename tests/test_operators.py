"""Hand-checked cases of the conversation operators."""

import pytest
from pyspark.sql import functions as F

from turnweave.functions import text as T
from turnweave.functions.vectors import bucket
from turnweave.operators.allocate import allocate_tiers
from turnweave.operators.assemble import assemble
from turnweave.operators.baselines import head_tail, last_n
from turnweave.operators.condense import compress_texts, prune_by_information, select_sentences
from turnweave.operators.dedup import assign_survivors, merged_groups
from turnweave.operators.metrics import answer_present, compression_factor, evidence_recall, messages_text, token_reduction_pct
from turnweave.operators.relevance import hybrid_score, min_max
from turnweave.plans.compress import Config, compress, turns_of

TURN = "conv_id long, turn_id int, role string, content string"


def frame(spark, contents, query="refund invoice", **columns):
    rows = [(1, i + 1, "user" if i % 2 == 0 else "assistant", c) for i, c in enumerate(contents)]
    df = spark.createDataFrame(rows, TURN).withColumn("token_count", T.word_count(F.col("content"))).withColumn("query", F.lit(query))
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    return df


def sized(spark, sizes, scores=None, budget=100):
    rows = [(1, i + 1, n, None if scores is None else scores[i], budget) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "conv_id long, turn_id int, token_count int, score double, budget int")


def tiers(spark, sizes, scores, budget, **options):
    return {r.turn_id: r.tier for r in allocate_tiers(sized(spark, sizes, scores, budget), **options).collect()}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = lambda s: F.lit(s).cast("string")
    assert one(spark, T.sentences(lit("First sentence. Second sentence! Third one?"))) == ["First sentence.", "Second sentence!", "Third one?"]
    assert one(spark, T.sentences(lit("no end"))) == ["no end"] and one(spark, T.sentences(lit(" \t "))) == []
    assert one(spark, T.lexical_tokens(lit("Café INV-9981"))) == ["caf", "inv", "9981"]
    assert one(spark, T.word_count(lit(" a b  c "))) == 3
    assert [one(spark, T.category_of_run(lit(x))) for x in ("C) Buried", "a)foo", "x) foo")] == ["buried", "oo", "foo"]
    assert [one(spark, T.category_of_dataset(lit(x))) for x in ("C) Buried", "a)foo", "x) foo")] == ["buried", "foo", "x) foo"]
    assert one(spark, bucket(lit("invoice"))) == int(__import__("hashlib").md5(b"invoice").hexdigest(), 16) % 64


def test_metrics(spark):
    hay = messages_text(F.array(F.lit("see you in  April"), F.lit("9 sharp")))
    assert one(spark, evidence_recall(hay, F.lit("April 9"))) == 1.0
    half = evidence_recall(messages_text(F.array(F.lit("ask Priya"))), F.lit("Priya | April 9"))
    assert one(spark, half) == 0.5 and one(spark, answer_present(half)) == 0.0
    pair = lambda f, a, b: one(spark, f(F.lit(a), F.lit(b)))
    assert pair(token_reduction_pct, 100, 25) == 75.0 and pair(token_reduction_pct, 0, 0) == 0.0
    assert pair(compression_factor, 100, 25) == 4.0 and pair(compression_factor, 100, 0) == float("inf") and pair(compression_factor, 0, 0) == 0.0


def test_baselines(spark):
    ids = lambda df: [r.turn_id for r in df.orderBy("turn_id").collect()]
    assert ids(last_n(sized(spark, [5, 9, 2], budget=8))) == [3]
    assert ids(head_tail(sized(spark, [3, 9, 4, 2], budget=10))) == [1, 3, 4]


def test_allocation(spark):
    assert tiers(spark, [50, 50, 10], [0.9, 0.8, 0.7], 60, recency_floor=0) == {1: "KEEP_FULL", 2: "DROP", 3: "KEEP_FULL"}
    assert tiers(spark, [0], [0.1], 0, recency_floor=0) == {1: "KEEP_FULL"}
    assert tiers(spark, [5, 9, 2], [0.1, 0.2, 0.3], 20, recency_floor=3) == {1: "KEEP_FULL", 2: "KEEP_FULL", 3: "KEEP_RECENT"}
    assert tiers(spark, [100], [None], 35, recency_floor=0) == {1: "COMPRESS"}
    assert tiers(spark, [10, 10], [0.5, 0.5], 10, recency_floor=0) == {1: "KEEP_FULL", 2: "DROP"}
    for bad in ({"recency_floor": -1}, {"compression_ratio": 0}, {"compression_ratio": 1.5}, {"max_recency_fraction": -0.1}):
        with pytest.raises(ValueError):
            tiers(spark, [1], [1.0], 1, **bad)


def test_merging(spark):
    rows = frame(spark, ["the invoice number is INV-9981", "the invoice number is INV-9981", "hiking in the hills"])
    got = assign_survivors(rows, ["conv_id"], "turn_id", threshold=0.99)
    assert {r.turn_id: r.survivor for r in got.collect()} == {1: 1, 2: 1, 3: 3}
    assert [r.members for r in merged_groups(got, ["conv_id"], "turn_id").collect()] == [[1, 2]]
    # 2 is absorbed by 1, so 3 meets 1 only: merging is not transitive
    import math

    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    chain = spark.createDataFrame([(1, 1, at(0)), (1, 2, at(18)), (1, 3, at(36))], "conv_id int, turn_id int, embedding array<double>")
    assert {r.turn_id: r.survivor for r in assign_survivors(chain, ["conv_id"], "turn_id", None, 0.92).collect()} == {1: 1, 2: 1, 3: 3}
    for bad in (0, -0.1, 1.5):
        with pytest.raises(ValueError):
            assign_survivors(rows, ["conv_id"], "turn_id", threshold=bad)


def test_scores(spark):
    rows = frame(spark, ["the invoice and the refund", "hiking", "lunch plans"])
    got = {r.turn_id: r.score for r in hybrid_score(rows, ["conv_id"], "turn_id", "content", "query").collect()}
    assert got[1] == max(got.values()) and all(0 <= s <= 1 for s in got.values())
    same = frame(spark, ["one and only", "one and only"])
    assert {r.score for r in hybrid_score(same, ["conv_id"], "turn_id", "content", "query").collect()} == {0.5}
    blank = frame(spark, ["...", "!!!"])
    assert {r.score for r in hybrid_score(blank, ["conv_id"], "turn_id", "content", "query").collect()} == {0.5}
    values = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 4.0)], "k int, x double")
    assert sorted(r.y for r in values.select(min_max(F.col("x"), ["k"]).alias("y")).collect()) == [0.0, 0.25, 1.0]


def test_pruning(spark):
    def prune(pairs, fraction):
        rows = spark.createDataFrame([(1, i, w, float(x)) for i, (w, x) in enumerate(pairs)], "k int, pos int, word string, info double")
        return [r.text for r in prune_by_information(rows, ["k"], fraction).collect()]

    assert prune([("the", 0.1), ("refund", 5), ("is", 0.2), ("approved", 4)], 0.5) == ["refund approved"]
    assert prune([("a", 1), ("b", 3), ("c", 2), ("d", 4)], 0.75) == ["b c d"]
    assert prune([("a", 1), ("b", 2)], 1.0) == ["a b"] and prune([("a", 1), ("b", 2), ("c", 0)], 0.01) == ["b"]
    with pytest.raises(ValueError):
        prune([("a", 1)], 0)


def test_condensing(spark):
    text = "The invoice and refund were approved. Hiking was fun last weekend. The refund arrives for the invoice soon."
    rows = frame(spark, [text], target=12)
    assert "Hiking" not in select_sentences(rows, ["turn_id"], "content", "query", "target").first().selected
    assert compress_texts(frame(spark, [text], target=100), ["turn_id"]).first().compressed == text
    run_on = " ".join("w%d" % i for i in range(63))
    assert len(compress_texts(frame(spark, [run_on], target=10), ["turn_id"]).first().compressed.split()) == 10
    assert compress_texts(frame(spark, ["  "], target=5), ["turn_id"]).first().compressed == ""
    assert compress_texts(frame(spark, ["a b"], target=0), ["turn_id"]).first().compressed == ""


def test_assembly(spark):
    rows = frame(spark, ["first", "second one", "third"]).withColumn("tier", F.element_at(F.array(F.lit("KEEP_FULL"), F.lit("DROP"), F.lit("KEEP_RECENT")), F.col("turn_id")))
    got = assemble(rows).first()
    assert [m.content for m in got.messages] == ["first", "third"] and got.dropped_turn_ids == [2]
    assert (got.original_tokens, got.compressed_tokens, got.compression_ratio) == (4, 2, 0.5) and got.merged_groups == []
    with pytest.raises(Exception, match="no valid tier"):
        assemble(rows.withColumn("tier", F.lit("NONE"))).collect()


def test_pipeline(spark):
    history = spark.createDataFrame([(7, "refund", [("user", "where is my refund for the lamp"), ("assistant", "the weather is nice today"), ("user", "where is my refund for the lamp"), ("assistant", "ok")])], "conv_id long, query string, history array<struct<role:string,content:string>>")
    got = compress(turns_of(history), Config(preserve_recent_n=1)).first()
    assert got.merged_groups == [[0, 2]] and got.tier_assignment == {0: "KEEP_FULL", 1: "KEEP_FULL", 3: "KEEP_RECENT"}
    strict = compress(turns_of(history), Config(token_budget=8, budget_safety_margin=0.3, preserve_recent_n=0)).first()
    assert strict.compressed_tokens <= got.compressed_tokens
    missing = spark.createDataFrame([(1, [(None, "x")])], "conv_id long, history array<struct<role:string,content:string>>")
    with pytest.raises(Exception, match="missing required key 'role'"):
        turns_of(missing).collect()
    with pytest.raises(ValueError):
        Config(budget_safety_margin=0)
