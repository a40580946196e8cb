"""Summaries as console text and files. What is formatted here is a row per
method, budget and category, so it is collected."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from turnweave.plans.evaluate import rate_distortion


def table(header: list[str], rows: Iterable[Iterable[object]]) -> str:
    """Columns as wide as their longest cell: the first flush left, others right; None is a dash."""
    cells = [header, *[["-" if x is None else f"{x:g}" if isinstance(x, float) else str(x) for x in row] for row in rows]]
    width = [max(map(len, column)) for column in zip(*cells)]
    lines = ["  ".join(c.ljust(w) if not k else c.rjust(w) for k, (c, w) in enumerate(zip(row, width))) for row in cells]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:]])


def overall(summary: list[Row]) -> str:
    fields = ["method", "budget_frac", "n_cases", "mean_token_reduction_pct", "mean_evidence_recall", "answer_present_rate", "within_budget_rate", "mean_latency_ms", "n_errors"]
    header = ["method", "budget", "cases", "reduction %", "recall", "answer", "in budget", "ms", "errors"]
    return table(header, [[r[f] for f in fields] for r in summary if r.category == "ALL"])


def by_category(summary: list[Row]) -> str:
    """A table of answer rates for each budget: methods down, categories across."""
    categories = sorted({r.category for r in summary} - {"ALL"})
    out = []
    for budget in sorted({r.budget_frac for r in summary}):
        rate = {(r.method, r.category): r.answer_present_rate for r in summary if r.budget_frac == budget}
        rows = [[m, *(rate.get((m, c)) for c in categories)] for m in sorted({m for m, _ in rate})]
        out.append(f"answer rate at budget {budget:g}\n" + table(["method", *categories], rows))
    return "\n\n".join(out)


def plot(summary: DataFrame, path: str) -> bool:
    """Recall and answer rate against reduction as a picture; False without matplotlib."""
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return False
    points = rate_distortion(summary).collect()
    figure = Figure(figsize=(11, 4.5))
    for axis, field, title in zip(figure.subplots(1, 2), ("mean_evidence_recall", "answer_present_rate"), ("Evidence recall", "Answer present")):
        for method in sorted({p.method for p in points}):
            own = [p for p in points if p.method == method]
            axis.plot([p.mean_token_reduction_pct for p in own], [p[field] for p in own], "o-", label=method)
        axis.set(xlabel="Token reduction (%)", ylabel=title, ylim=(-0.02, 1.05))
        axis.legend()
    figure.savefig(path)
    return True


def validation_text(lines: list[Row], summary: Row, counts: list[Row]) -> str:
    """Findings by line, then totals, cases per category, lengths and the verdict."""
    out = [f"line {r.line_no} [{r.case_id or '?'}] {r.level} {r.code}: {r.message}" for r in lines]
    out += ["", f"cases {summary.n_cases} (usable {summary.n_usable}), errors {summary.n_errors}, warnings {summary.n_warnings}"]
    out += [f"  {r.category}: {r.n_cases}" for r in counts]
    if summary.min_turns is not None:
        out.append(f"turns: {summary.min_turns} to {summary.max_turns}, mean {summary.mean_turns:.1f}")
    return "\n".join([*out, f"result: {summary.status}"])


def write_one_csv(df: DataFrame, folder: str) -> None:
    """df as one CSV file with a header (results of a sweep are few)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(folder)


def flattened(results: DataFrame) -> DataFrame:
    """Result rows as text cells: infinite ratios read inf, missing values nothing."""
    return results.select(*[F.when(F.col(c) == float("inf"), "inf").otherwise(F.col(c).cast("string")).alias(c) if t == "double" else F.col(c) for c, t in results.dtypes])
