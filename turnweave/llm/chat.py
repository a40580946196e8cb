"""Preference formatting: one prompt, two masked completions.

Method. The longest common prefix of the chosen and the rejected conversation's
turns (equal role and text) is rendered once as the prompt; what follows in
each is its completion, with the character spans of its assistant turns as the
loss mask. Turns are rendered as

    <|im_start|>role\\ntext<|im_end|>\\n

and the mask of an assistant turn covers its text and end marker. Marker strings
inside a text are broken by a zero-width space, so a text cannot open a turn.

At scale. Row-wise column functions: a pair costs its own size and nothing is
shuffled. ``pairs_from_turns`` shuffles once, by conversation.

Edge cases. Null roles read as ``user``, null texts as empty; a null or empty
conversation is all prefix. Equal conversations have two empty completions and
are marked ``same``. Repeated pairs are formatted one by one; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE, _BREAK = "<|im_start|>", "<|im_end|>", "​"
_TURNS = "array<struct<role:string,text:string>>"


def _clean(turns: Column) -> Column:
    text = lambda t: F.replace(F.replace(F.coalesce(t["text"], F.lit("")), F.lit(_OPEN), F.lit(_OPEN[0] + _BREAK + _OPEN[1:])), F.lit(_CLOSE), F.lit(_CLOSE[0] + _BREAK + _CLOSE[1:]))
    return F.transform(F.coalesce(turns, F.array().cast(_TURNS)), lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), text(t).alias("text")))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(_OPEN), t["role"], F.lit("\n"), t["text"], F.lit(_CLOSE + "\n"))), "")


def _mask(turns: Column) -> Column:
    """Spans (begin, end) of the assistant turns in the rendered text."""
    overhead = len(_OPEN) + 1 + len(_CLOSE) + 1
    width = lambda t: F.length(t["role"]) + F.length(t["text"]) + overhead
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["role"]) + len(_OPEN) + 1
        span = F.array(F.struct(begin.alias("begin"), (begin + F.length(t["text"]) + len(_CLOSE)).alias("end")))
        return F.struct((state["at"] + width(t)).alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda state: state["spans"])


def preference_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", ident: str = "conv_id") -> DataFrame:
    """conv_id, n_prompt_turns, prompt, chosen_completion, chosen_mask,
    rejected_completion, rejected_mask, same of every pair of turn arrays."""
    rows = pairs.select(F.col(ident).alias("conv_id"), _clean(F.col(chosen)).alias("a"), _clean(F.col(rejected)).alias("b"))
    shortest = F.least(F.size("a"), F.size("b"))
    differs = F.array_position(F.zip_with(F.slice("a", 1, shortest), F.slice("b", 1, shortest), lambda x, y: (x != y).cast("int")), F.lit(1)).cast("int")
    rows = rows.withColumn("n", F.when(differs > 0, differs - 1).otherwise(shortest))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    rows = rows.select("conv_id", "n", F.slice("a", 1, F.col("n")).alias("head"), rest("a").alias("a"), rest("b").alias("b"))
    return rows.select(
        "conv_id",
        F.col("n").alias("n_prompt_turns"),
        _render(F.col("head")).alias("prompt"),
        _render(F.col("a")).alias("chosen_completion"),
        _mask(F.col("a")).alias("chosen_mask"),
        _render(F.col("b")).alias("rejected_completion"),
        _mask(F.col("b")).alias("rejected_mask"),
        ((F.size("a") == 0) & (F.size("b") == 0)).alias("same"),
    )


def pairs_from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) from turns(conv_id, turn, role, text).

    chosen is the conversation; rejected ends where chosen's last assistant turn
    stands, and says there what the assistant said first (nothing, if that turn
    is its only one). A conversation without an assistant turn is rejected as a
    whole, with itself. Turns are ordered by (turn, role, text).
    """
    packed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    plain = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rows = packed.select("conv_id", plain.alias("chosen"))
    said = F.filter(F.transform("chosen", lambda t, i: F.struct((t["role"] == "assistant").alias("own"), i.alias("i"), t["text"].alias("text"))), lambda x: x["own"])
    rows = rows.withColumn("said", said)
    last = F.element_at("said", -1)
    reply = F.struct(F.lit("assistant").alias("role"), F.element_at("said", 1)["text"].alias("text"))
    tail = F.when(F.size("said") > 1, F.array(reply)).otherwise(F.array().cast(_TURNS))
    rejected = F.when(F.size("said") == 0, F.col("chosen")).otherwise(F.concat(F.slice("chosen", 1, last["i"]), tail))
    return rows.select("conv_id", "chosen", rejected.alias("rejected"))
