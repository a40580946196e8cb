"""python -m turnweave.cli evaluate | validate | compress: the command line."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.lineage import cut
from turnweave.operators.validate import category_counts, report_lines, summarize_validation, validate_lines
from turnweave.plans import report
from turnweave.plans.compress import Config, compress, turns_of
from turnweave.plans.evaluate import BUDGETS, summarize, sweep
from turnweave.sources.jsonl import read_cases, tolerant_lines

METHODS = ("full_context", "last_n", "head_tail", "pipeline")


def fractions(text: str) -> tuple[float, ...]:
    try:
        out = tuple(float(x) for x in text.split(",") if x.strip())
    except ValueError:
        raise argparse.ArgumentTypeError("must be numbers with commas between") from None
    if not out or not all(0 < x <= 1 for x in out):
        raise argparse.ArgumentTypeError("each must be in (0, 1]")
    return out


def names(text: str) -> tuple[str, ...]:
    out = tuple(x.strip() for x in text.split(",") if x.strip())
    if unknown := set(out) - set(METHODS):
        raise argparse.ArgumentTypeError(f"unknown: {sorted(unknown)}")
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="turnweave")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("evaluate", help="methods by budgets over the cases of a JSON-lines file")
    one.add_argument("path")
    one.add_argument("--out-dir", default="report")
    one.add_argument("--methods", type=names, default=METHODS)
    one.add_argument("--budgets", type=fractions, default=BUDGETS)
    one.add_argument("--safety-margin", type=lambda x: fractions(x)[0], default=0.9)
    one.add_argument("--limit", type=int, default=0, help="first cases only")
    one.add_argument("--by-category", action="store_true")
    one.add_argument("--no-plot", action="store_true")
    two = commands.add_parser("validate", help="the rules over a JSON-lines file; exit code 1 if it fails")
    two.add_argument("path")
    two.add_argument("--strict", action="store_true", help="warnings fail too")
    three = commands.add_parser("compress", help="the histories of a JSON-lines file to message lists")
    three.add_argument("path")
    three.add_argument("out")
    three.add_argument("--budget", type=int, default=4000)
    return top


def histories(cases: DataFrame) -> DataFrame:
    """Turns of the cases, by line number as conversation."""
    return turns_of(cases.select(F.col("line_no").alias("conv_id"), "query", "history"))


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    cases = cut(read_cases(spark, args.path, args.limit))
    asked = cases.select(F.col("line_no").alias("conv_id"), "case_id", "category", "gold_answer")
    results = cut(sweep(histories(cases), asked, args.methods, args.budgets, args.safety_margin))
    summary = cut(summarize(results))
    report.write_one_csv(report.flattened(results), f"{args.out_dir}/results")
    report.write_one_csv(summary.orderBy("method", "budget_frac", "category"), f"{args.out_dir}/summary")
    rows = summary.orderBy("method", "budget_frac", "category").collect()
    print(report.overall(rows))
    if args.by_category:
        print("\n" + report.by_category(rows))
    if not args.no_plot and not report.plot(summary, os.path.join(args.out_dir, "rate_distortion.png")):
        print("no matplotlib: no plot")
    if failed := sum(r.n_errors for r in rows if r.category == "ALL"):
        print(f"{failed} runs failed: see error in the results")
    return 0


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    found = cut(validate_lines(tolerant_lines(spark, args.path)))
    summary = summarize_validation(found, args.strict).first()
    lines = report_lines(found).orderBy("line_no", "level", "code").toLocalIterator()
    print(report.validation_text(lines, summary, category_counts(found).orderBy("category").collect()))
    return int(summary.status == "FAIL")


def condense(spark: SparkSession, args: argparse.Namespace) -> int:
    compress(histories(read_cases(spark, args.path)), Config(token_budget=args.budget)).write.mode("overwrite").json(args.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("turnweave").getOrCreate()
    if "://" not in args.path and not os.path.exists(args.path):
        print(f"no such file: {args.path}")
        return 1
    return {"evaluate": evaluate, "validate": validate, "compress": condense}[args.command](spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
