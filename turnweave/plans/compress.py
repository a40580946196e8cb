"""The whole pipeline: merge near-duplicates, score, allocate, assemble."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.functions.text import word_count
from turnweave.functions.vectors import hashed_embeddings
from turnweave.lineage import bucketed, cut
from turnweave.operators.allocate import allocate_tiers
from turnweave.operators.assemble import assemble
from turnweave.operators.condense import Bigrams, compress_texts, count_bigrams
from turnweave.operators.dedup import assign_survivors, check_fraction, merged_groups
from turnweave.operators.relevance import hybrid_score


@dataclass(frozen=True)
class Config:
    """Settings of a compression run; every hook is a function on columns or DataFrames."""

    token_budget: int = 4000
    budget_fraction: float | None = None  # of each conversation's tokens, instead of token_budget
    semantic_weight: float = 0.6
    lexical_weight: float = 0.4
    preserve_recent_n: int = 2
    compression_ratio: float = 0.3
    max_recency_fraction: float = 0.5
    dedup_similarity_threshold: float = 0.92
    budget_safety_margin: float = 0.9
    counter: Callable = word_count
    embedder: Callable = hashed_embeddings
    scorer: Callable | None = None
    compressor: Callable = compress_texts
    pruner: Callable | None = None  # of words, where compress_texts goes below sentences

    def __post_init__(self):
        for name in ("budget_safety_margin", "compression_ratio", "max_recency_fraction", "dedup_similarity_threshold"):
            check_fraction(name, getattr(self, name))
        if self.budget_fraction is not None:
            check_fraction("budget_fraction", self.budget_fraction)
        if self.preserve_recent_n < 0:
            raise ValueError(f"preserve_recent_n must be >= 0, got {self.preserve_recent_n}")

    def score(self, turns: DataFrame) -> DataFrame:
        if self.scorer is not None:
            return self.scorer(turns)
        return hybrid_score(turns, ["conv_id"], "turn_id", "content", "query", self.semantic_weight, self.lexical_weight, self.embedder)


def turns_of(history: DataFrame, counter=word_count) -> DataFrame:
    """(conv_id, turn_id, role, content, token_count[, query]) from nested
    (conv_id, history[, query]); ids are list positions. A message without a
    role or content raises."""
    missing = lambda what: F.raise_error(F.concat(F.lit("history["), F.col("turn_id").cast("string"), F.lit(f"] is missing required key {what}")))
    extra = ["query"] if "query" in history.columns else []
    flat = history.select("conv_id", *extra, F.posexplode("history").alias("turn_id", "m"))
    flat = flat.select("conv_id", "turn_id", F.coalesce("m.role", missing("'role'")).alias("role"), F.coalesce("m.content", missing("'content'")).alias("content"), *extra)
    return flat.withColumn("token_count", counter(F.col("content")))


def split_latest(turns: DataFrame) -> DataFrame:
    """Earlier turns, each with the conversation's last content as query."""
    last = turns.groupBy("conv_id").agg(F.max_by("content", "turn_id").alias("query"), F.max("turn_id").alias("last"))
    return turns.join(last, "conv_id").where("turn_id < last").drop("last")


def score(turns: DataFrame, config: Config = Config()) -> DataFrame:
    """conv_id, turn_id, score of turns(…, query); no merging here."""
    return config.score(turns).select("conv_id", "turn_id", "score")


@dataclass(frozen=True)
class Ranked:
    """What no budget changes: the turns, their survivors, those alive, and the
    scores of these, with the bigram counts that pruning will ask for, if made."""

    turns: DataFrame
    assigned: DataFrame
    alive: DataFrame
    scores: DataFrame
    counts: Bigrams | None = None


def rank(turns: DataFrame, config: Config = Config(), repeated: bool = False) -> Ranked:
    """Merges and scores. With ``repeated``, for use under several budgets, the
    scores and bigram counts are tables too, made once, and those alive are dealt
    out once."""
    turns = turns if hasattr(turns, "cut_folder") else cut(turns)
    assigned = cut(assign_survivors(turns, ["conv_id"], "turn_id", "content", config.dedup_similarity_threshold, config.embedder))
    alive = turns.join(assigned.where("turn_id = survivor").select("conv_id", "turn_id"), ["conv_id", "turn_id"], "left_semi")
    alive = bucketed(alive, "conv_id", "turn_id") if repeated else cut(alive)
    scores = score(alive, config)
    if not repeated:
        return Ranked(turns, assigned, alive, scores)
    counts = count_bigrams(turns, "content") if config.compressor is compress_texts and config.pruner is None else None
    return Ranked(turns, assigned, alive, cut(scores), counts)


def compress(turns: DataFrame, config: Config = Config(), ranked: Ranked | None = None) -> DataFrame:
    """One report row per conversation of turns(conv_id, turn_id, role, content,
    token_count, query). Duplicates go first, so all counts are of survivors."""
    ranked = ranked or rank(turns, config)
    turns, keys = ranked.turns, ["conv_id", "turn_id"]
    # the competition needs sizes and scores; texts meet its outcome afterwards
    scored = ranked.alive.select(*keys, "token_count").join(ranked.scores, keys, "left")
    if config.budget_fraction is None:
        whole = F.lit(config.token_budget)
    else:
        total = turns.groupBy("conv_id").agg(F.greatest(F.lit(1), (F.sum("token_count") * F.lit(config.budget_fraction)).cast("int")).alias("whole"))
        scored, whole = scored.join(total, "conv_id"), F.col("whole")
    scored = scored.withColumn("budget", (whole * F.lit(config.budget_safety_margin)).cast("int"))
    tier = allocate_tiers(scored, config.preserve_recent_n, config.compression_ratio, config.max_recency_fraction).select(*keys, "tier")
    # only turns that are shortened ask for the query
    tiers = cut(ranked.alive.join(tier, keys).withColumn("query", F.when(F.col("tier") == "COMPRESS", F.col("query"))))
    groups = merged_groups(ranked.assigned, ["conv_id"], "turn_id")
    options = {"embedder": config.embedder, "weights": (config.semantic_weight, config.lexical_weight)} if config.compressor is compress_texts else {}
    if config.compressor is compress_texts:
        options |= {"corpus_text": "content", "pruner": config.pruner, "counts": ranked.counts}
    return assemble(tiers, config.compression_ratio, config.counter, groups, turns, config.compressor, **options)
