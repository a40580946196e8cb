"""Retention sweep: cases x methods x budgets, metrics, grouped summary."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.functions.text import category_of_run, word_count
from turnweave.lineage import cut
from turnweave.operators.baselines import METHODS
from turnweave.operators.metrics import answer_present, compression_factor, evidence_recall, messages_text, token_reduction_pct
from turnweave.plans.compress import Config, compress, rank

BUDGETS = (0.1, 0.2, 0.3, 0.5, 0.75)


def grid(methods: list[str], budgets: tuple[float, ...] = BUDGETS) -> list[tuple[str, float]]:
    """(method, budget fraction); full_context only at 1.0. Unknown methods and bounds raise."""
    known = {*METHODS, "pipeline"}
    if unknown := set(methods) - known:
        raise ValueError(f"unknown methods {sorted(unknown)}; known: {sorted(known)}")
    if any(not 0 < b <= 1 for b in budgets):
        raise ValueError("budgets must be in (0, 1]")
    return [(m, b) for m in methods for b in ((1.0,) if m == "full_context" else budgets)]


def sweep(turns: DataFrame, cases: DataFrame, methods=("full_context", "last_n", "head_tail"), budgets=BUDGETS, margin: float = 0.9, config: Config | None = None) -> DataFrame:
    """A row per case, method and budget.

    turns: (conv_id, turn_id, role, content, token_count, query); cases:
    (conv_id, case_id, category, gold_answer). Each method and budget is one job
    over all conversations; latency_ms is its wall time divided by its cases.
    What the pipeline does before it meets a budget (merging, scores, bigram
    counts) is done once, and its time counts in each of its budgets.
    Methods that keep nothing of a case still have a row of it. So do those that
    fail: error says why, nothing counts as kept, and within_budget is null.
    """
    if not 0 < margin <= 1:
        raise ValueError("margin must be in (0, 1]")
    total = turns.groupBy("conv_id").agg(F.sum("token_count").cast("long").alias("original_tokens"))
    turns = cut(turns)
    base = cut(cases.join(total, "conv_id"))
    n_cases = max(1, base.count())
    ranked, ranking_ms, failed = timed(lambda: rank(turns, config or Config(), repeated=True)) if "pipeline" in methods else (None, 0.0, None)
    parts = []
    for method, b in grid(list(methods), budgets):
        frame = base.withColumns({"method": F.lit(method), "budget_frac": F.lit(float(b))})
        frame = frame.withColumn("budget_tokens", F.greatest(F.lit(1), (F.col("budget_frac") * F.col("original_tokens")).cast("int")))
        frame = frame.withColumn("effective_budget", (F.col("budget_tokens") * F.lit(float(margin))).cast("int"))

        def run(method=method, b=b, frame=frame) -> DataFrame:
            if method == "pipeline":
                one = compress(turns, (config or Config()).__class__(**{**(config or Config()).__dict__, "budget_fraction": b, "budget_safety_margin": margin}), ranked)
                return cut(one.select("conv_id", F.transform("messages", lambda m: m["content"]).alias("contents"), F.col("compressed_tokens")))
            left = METHODS[method](turns.join(frame.select("conv_id", F.col("effective_budget").alias("budget")).distinct(), "conv_id")).groupBy("conv_id")
            return cut(left.agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "content"))), lambda x: x["content"]).alias("contents"), F.sum("token_count").cast("long").alias("compressed_tokens")))

        piped = method == "pipeline"
        kept, milliseconds, error = (None, 0.0, failed) if piped and failed else timed(run)
        milliseconds += ranking_ms * piped
        if error is None:
            frame = frame.join(kept, "conv_id", "left")
        else:
            frame = frame.withColumns({"contents": F.lit(None).cast("array<string>"), "compressed_tokens": F.lit(None).cast("long")})
        parts.append(frame.withColumns({"latency_ms": F.lit(milliseconds / n_cases), "error": F.lit(error).cast("string")}))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("compressed_tokens", F.coalesce("compressed_tokens", F.lit(0).cast("long")))
    recall = evidence_recall(messages_text(F.coalesce("contents", F.array().cast("array<string>"))), F.col("gold_answer"))
    every = every.withColumn("recall", F.when(F.col("error").isNotNull(), 0.0).otherwise(recall))
    return every.select(
        "case_id",
        category_of_run(F.col("category")).alias("category"),
        "method",
        "budget_frac",
        "budget_tokens",
        "effective_budget",
        "original_tokens",
        "compressed_tokens",
        F.bround(token_reduction_pct(F.col("original_tokens"), F.col("compressed_tokens")), 3).alias("token_reduction_pct"),
        F.bround(compression_factor(F.col("original_tokens"), F.col("compressed_tokens")), 4).alias("compression_ratio"),
        F.bround("recall", 4).alias("evidence_recall"),
        answer_present(F.col("recall")).alias("answer_present"),
        F.when((F.col("method") != "full_context") & F.col("error").isNull(), (F.col("compressed_tokens") <= F.col("effective_budget")).cast("int")).alias("within_budget"),
        "latency_ms",
        "error",
    )


def timed(action) -> tuple[object, float, str | None]:
    """(result, milliseconds, error) of a job; an error is kept, not raised."""
    began = time.perf_counter()
    try:
        return action(), (time.perf_counter() - began) * 1000, None
    except Exception as e:  # noqa: BLE001 - reported as data
        return None, (time.perf_counter() - began) * 1000, f"{type(e).__name__}: {e}"


def summarize(results: DataFrame) -> DataFrame:
    """Means per (method, budget) and per (method, budget, category), the
    former as category ALL; rows sort in code-point order."""
    finite = F.when(F.col("compression_ratio") != float("inf"), F.col("compression_ratio"))
    columns = set(results.columns)
    latency = F.col("latency_ms") if "latency_ms" in columns else F.lit(None).cast("double")
    error = F.col("error") if "error" in columns else F.lit(None).cast("string")
    marked = results.withColumns({"finite": finite, "latency": latency, "failed": (F.coalesce(error, F.lit("")) != "").cast("int")})
    out = marked.groupingSets([["method", "budget_frac", "category"], ["method", "budget_frac"]], "method", "budget_frac", "category").agg(
        F.grouping("category").alias("total"),
        F.count("*").alias("n_cases"),
        F.bround(F.avg("token_reduction_pct"), 2).alias("mean_token_reduction_pct"),
        F.bround(F.avg("finite"), 3).alias("mean_compression_ratio"),
        F.bround(F.avg("evidence_recall"), 4).alias("mean_evidence_recall"),
        F.bround(F.avg("answer_present"), 4).alias("answer_present_rate"),
        F.bround(F.avg("within_budget"), 3).alias("within_budget_rate"),
        F.bround(F.avg("latency"), 2).alias("mean_latency_ms"),
        F.sum("failed").alias("n_errors"),
    )
    return out.withColumn("category", F.when(F.col("total") == 1, "ALL").otherwise(F.col("category"))).drop("total").orderBy("method", "budget_frac", "category")


def category_pivot(summary: DataFrame, categories: list[str]) -> DataFrame:
    """Answer rate per method and budget, a column per category."""
    rows = summary.where("category <> 'ALL'")
    return rows.groupBy("budget_frac", "method").pivot("category", categories).agg(F.first("answer_present_rate"))


def rate_distortion(summary: DataFrame) -> DataFrame:
    """Points (method, reduction, recall, answer rate) in order of reduction."""
    points = summary.where("category = 'ALL'").select("method", "budget_frac", "mean_token_reduction_pct", "mean_evidence_recall", "answer_present_rate")
    return points.orderBy("method", "mean_token_reduction_pct", "mean_evidence_recall")


def derived_cases(turns: DataFrame, n_words: int = 3) -> DataFrame:
    """A case per conversation of turns(conv_id, turn_id, content, ...): the last
    turn asks, and the first n_words words of the middle turn are the answer."""
    middle = turns.groupBy("conv_id").agg(F.max("turn_id").alias("last")).withColumn("mid", F.expr("last div 2"))
    gold = F.array_join(F.slice(F.regexp_extract_all(F.col("content"), F.lit(r"(?U)\S+"), F.lit(0)), 1, n_words), " ")
    rows = turns.join(middle, "conv_id").where("turn_id = mid and last > 0")
    kind = F.when(F.col("last") < 4, "recency").otherwise("lexical")
    return rows.select("conv_id", F.col("conv_id").cast("string").alias("case_id"), kind.alias("category"), gold.alias("gold_answer"), F.col("mid").cast("int").alias("evidence_turn_id"), word_count(F.col("content")).alias("evidence_words"))
