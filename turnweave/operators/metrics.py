"""Retention metrics of message lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnweave.functions.text import gold_parts, normalize


def messages_text(contents: Column) -> Column:
    """The normal form of all contents together, so that a match may span two."""
    return normalize(F.array_join(contents, "\n"))


def token_reduction_pct(original: Column, compressed: Column) -> Column:
    return F.when(original <= 0, F.lit(0.0)).otherwise(100.0 * (1.0 - compressed / original))


def compression_factor(original: Column, compressed: Column) -> Column:
    """Original over compressed: infinite if nothing is left of something, 0 of nothing."""
    return F.when(compressed > 0, original / compressed).when(original > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def evidence_recall(text: Column, gold: Column) -> Column:
    """Share of the gold parts that stand in text (a normal form); 0 without parts."""
    parts = gold_parts(gold)
    found = F.size(F.filter(parts, lambda p: F.contains(text, normalize(p))))
    return F.when(F.size(parts) > 0, found / F.size(parts)).otherwise(F.lit(0.0))


def answer_present(recall: Column) -> Column:
    return F.when(recall == 1.0, F.lit(1.0)).otherwise(F.lit(0.0))
