"""Methods to compare with: everything, the last turns, and head with tail.

Each takes turns(conv_id, turn_id, role, content, token_count) with a budget
column and returns the rows it keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _spent(newest_first: bool, tokens: Column) -> Column:
    """Running sum of tokens over a conversation, from one end."""
    order = F.col("turn_id").desc() if newest_first else F.col("turn_id").asc()
    return F.sum(tokens).over(Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def full_context(turns: DataFrame, budget: str = "budget") -> DataFrame:
    return turns


def last_n(turns: DataFrame, budget: str = "budget") -> DataFrame:
    """The longest suffix within the budget: sizes are not negative, so the
    suffix sum only grows and stopping is filtering."""
    return turns.withColumn("spent", _spent(True, F.col("token_count"))).where(F.col("spent") <= F.col(budget)).drop("spent")


def head_tail(turns: DataFrame, budget: str = "budget", head_turns: int = 2) -> DataFrame:
    """Up to head_turns first turns, then a suffix of the others in what is left."""
    every = Window.partitionBy("conv_id")
    head = (F.row_number().over(every.orderBy("turn_id")) <= head_turns) & (_spent(False, F.col("token_count")) <= F.col(budget))
    marked = turns.withColumn("is_head", head)
    used = F.coalesce(F.sum(F.when(F.col("is_head"), F.col("token_count"))).over(every), F.lit(0))
    tail = _spent(True, F.when(~F.col("is_head"), F.col("token_count")))
    marked = marked.withColumns({"used": used, "spent": tail})
    return marked.where(F.col("is_head") | (F.col("spent") <= F.col(budget) - F.col("used"))).drop("is_head", "used", "spent")


METHODS = {"full_context": full_context, "last_n": last_n, "head_tail": head_tail}
