"""Registered queries over the standard tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.functions import text as T
from turnweave.functions.vectors import cosine, hashed_embeddings
from turnweave.operators.allocate import allocate_tiers, recent_turns
from turnweave.operators.baselines import full_context, head_tail, last_n
from turnweave.operators.condense import compress_texts, prune_by_information, select_sentences, word_information
from turnweave.operators.dedup import assign_survivors, merged_groups
from turnweave.operators.metrics import token_reduction_pct
from turnweave.operators.relevance import bm25, hybrid_score
from turnweave.operators.validate import summarize_validation, validate_lines
from turnweave.plans import adapter
from turnweave.plans.compress import Config, compress, score, split_latest
from turnweave.plans.evaluate import category_pivot, derived_cases, rate_distortion, summarize, sweep

THETA = 0.85


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = rows.select("conv_id", F.col("turn").cast("int").alias("turn_id"), "role", F.col("text").alias("content"))
    return rows.withColumn("token_count", T.word_count(F.col("content")))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier turns with their conversation's last turn as query."""
    return split_latest(turns(spark, sf_dir))


def budgeted(spark: SparkSession, sf_dir: str, fraction: float = 0.3) -> DataFrame:
    return with_budget(turns(spark, sf_dir), fraction)


def with_budget(rows: DataFrame, fraction: float) -> DataFrame:
    """rows with ``budget``: a fraction of their conversation's tokens."""
    total = F.sum("token_count").over(Window.partitionBy("conv_id"))
    return rows.withColumn("budget", F.greatest(F.lit(1), (total * F.lit(fraction)).cast("int")))


def token_counts(spark, sf_dir):
    rows = turns(spark, sf_dir)
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("token_count").alias("n_tokens"), F.max("token_count").alias("most"))


def lexical_tokens(spark, sf_dir):
    rows = turns(spark, sf_dir).select(F.explode(T.lexical_tokens(F.col("content"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


def sentences(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn_id", F.posexplode(T.sentences(F.col("content"))).alias("sent_id", "sentence"))
    return rows.select("conv_id", "turn_id", "sent_id", "sentence")


def normalize_text(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn_id", T.normalize(F.col("content")).alias("normal"))


def content_words(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn_id", F.array_join(F.array_sort(T.content_words(F.col("content"))), " ").alias("words"))


def normalize_roles(spark, sf_dir):
    rows = turns(spark, sf_dir).where("role <> 'system'").withColumn("given", F.when(F.col("role") == "user", "Human").otherwise("AI"))
    return rows.groupBy(T.normal_role(F.lit(None).cast("string"), F.col("given")).alias("role")).agg(F.count("*").alias("n"))


def _method(method):
    return lambda spark, sf_dir: method(budgeted(spark, sf_dir)).select("conv_id", "turn_id", "token_count")


def token_reduction(spark, sf_dir):
    rows = budgeted(spark, sf_dir)
    total = rows.groupBy("conv_id").agg(F.sum("token_count").alias("original"))
    kept = last_n(rows).groupBy("conv_id").agg(F.sum("token_count").alias("kept"))
    both = total.join(kept, "conv_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return both.select("conv_id", "original", "kept", F.round(token_reduction_pct(F.col("original"), F.col("kept")), 3).alias("reduction_pct"))


def bm25_scores(spark, sf_dir):
    out = bm25(asked(spark, sf_dir), ["conv_id"], "turn_id", "content", "query")
    return out.select("conv_id", "turn_id", "bm25")


def hashed_vectors(spark, sf_dir):
    out = hashed_embeddings(turns(spark, sf_dir), ["conv_id", "turn_id"], "content")
    return out.select("conv_id", "turn_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ").alias("vector"))


def hybrid_scores(spark, sf_dir):
    out = hybrid_score(asked(spark, sf_dir), ["conv_id"], "turn_id", "content", "query")
    return out.select("conv_id", "turn_id", "cosine", "score")


def score_only(spark, sf_dir):
    return score(asked(spark, sf_dir)).select("conv_id", "turn_id", "score")


def embedding_survivors(spark, sf_dir):
    """Vectors in runs of 40 by id, as a conversation's turns would be."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("run", F.expr("vec_id div 40"))
    return assign_survivors(rows, ["run"], "vec_id", None, 0.3).select("run", "vec_id", "survivor")


def dedup_survivors(spark, sf_dir):
    return assign_survivors(turns(spark, sf_dir), ["conv_id"], "turn_id", "content", THETA).select("conv_id", "turn_id", "survivor")


def dedup_groups(spark, sf_dir):
    groups = merged_groups(assign_survivors(turns(spark, sf_dir), ["conv_id"], "turn_id", "content", THETA), ["conv_id"], "turn_id")
    return groups.select("conv_id", "survivor", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


def recency_floor(spark, sf_dir):
    out = recent_turns(budgeted(spark, sf_dir), 3, 0.5)
    return out.select("conv_id", "turn_id", "is_recent")


def tier_assignment(spark, sf_dir):
    """Tiers of the earlier turns by their hybrid score for the last one."""
    rows = with_budget(asked(spark, sf_dir), 0.5)
    scores = hybrid_score(rows, ["conv_id"], "turn_id", "content", "query").select("conv_id", "turn_id", "score")
    return allocate_tiers(rows.join(scores, ["conv_id", "turn_id"]), 1, 0.3, 0.5).select("conv_id", "turn_id", "tier")


def tier_counts(spark, sf_dir):
    return tier_assignment(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))


def word_info(spark, sf_dir):
    rows = turns(spark, sf_dir)
    return word_information(rows, ["conv_id", "turn_id"], "content").select("conv_id", "turn_id", "pos", "word", "info")


def prune_words(spark, sf_dir):
    """The more informative half of each turn's words."""
    rows = word_information(turns(spark, sf_dir), ["conv_id", "turn_id"], "content")
    return prune_by_information(rows, ["conv_id", "turn_id"], 0.5)


def extractive_select(spark, sf_dir):
    rows = asked(spark, sf_dir).withColumn("target", F.greatest(F.lit(1), F.ceil(F.col("token_count") * F.lit(0.45)).cast("int")))
    return select_sentences(rows, ["conv_id", "turn_id"], "content", "query", "target")


def compress_turns(spark, sf_dir):
    rows = asked(spark, sf_dir).withColumn("target", F.greatest(F.lit(1), F.ceil(F.col("token_count") * F.lit(0.3)).cast("int")))
    return compress_texts(rows, ["conv_id", "turn_id"])


def _flat(report):
    return report.select(
        "conv_id",
        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("messages"),
        "original_tokens",
        "compressed_tokens",
        F.round("compression_ratio", 6).alias("compression_ratio"),
        F.array_join(F.transform(F.map_entries("tier_assignment"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",").alias("tiers"),
        F.array_join(F.transform("dropped_turn_ids", lambda x: x.cast("string")), ",").alias("dropped"),
        F.to_json("merged_groups").alias("merged_groups"),
    )


def compress_pipeline(spark, sf_dir):
    """Flagship: every conversation compressed to half of its tokens for its last turn."""
    return _flat(compress(asked(spark, sf_dir), Config(budget_fraction=0.5, dedup_similarity_threshold=THETA)))


def generous_pipeline(spark, sf_dir):
    """With the default budget of 4000 nothing is cut: all turns come back."""
    out = compress(asked(spark, sf_dir), Config(dedup_similarity_threshold=1.0, budget_safety_margin=1.0))
    return out.select("conv_id", F.size("messages").alias("n_messages"), "original_tokens", "compressed_tokens", "compression_ratio")


def adapter_batch(spark, sf_dir):
    rows = turns(spark, sf_dir).where("role <> 'system'")
    out = adapter.batch(rows, Config(budget_fraction=0.5))
    return out.select("conv_id", F.size("messages").alias("n_messages"), F.element_at("messages", -1)["content"].alias("latest"))


def _sweep(spark, sf_dir):
    rows = turns(spark, sf_dir)
    return sweep(rows, derived_cases(rows))


def eval_results(spark, sf_dir):
    return _sweep(spark, sf_dir).drop("latency_ms", "error")


def eval_summary(spark, sf_dir):
    """All columns but the latency, which no two runs share."""
    return summarize(_sweep(spark, sf_dir)).drop("mean_latency_ms")


def answer_pivot(spark, sf_dir):
    return category_pivot(summarize(_sweep(spark, sf_dir)), ["lexical", "recency"])


def eval_rate_distortion(spark, sf_dir):
    return rate_distortion(summarize(_sweep(spark, sf_dir)))


def eval_pipeline(spark, sf_dir):
    rows = asked(spark, sf_dir)
    cases = derived_cases(rows)
    return summarize(sweep(rows, cases, methods=("pipeline",)))


def leakage_check(spark, sf_dir):
    """Turns other than the evidence that contain a case's answer, here one word."""
    rows = turns(spark, sf_dir)
    both = rows.join(derived_cases(rows, 1).select("conv_id", "gold_answer", "evidence_turn_id"), "conv_id")
    return both.where((F.col("turn_id") != F.col("evidence_turn_id")) & F.contains(F.lower("content"), F.lower("gold_answer"))).select("conv_id", "turn_id", "gold_answer")


def _cases_as_lines(spark, sf_dir):
    """The derived cases as the validator's lines."""
    rows = turns(spark, sf_dir)
    history = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "role", "content"))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("history"))
    both = history.join(derived_cases(rows), "conv_id")
    query = F.element_at("history", -1)["content"]
    line = F.to_json(F.struct("case_id", "category", "history", query.alias("query"), "gold_answer", F.array("evidence_turn_id").alias("evidence_turn_ids")))
    return both.select((F.col("conv_id") + 1).alias("line_no"), line.alias("line"), F.lit(False).alias("is_fence"))


def validation_findings(spark, sf_dir):
    found = validate_lines(_cases_as_lines(spark, sf_dir))
    return found.select("line_no", "case_id", "n_turns", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


def validation_roles(spark, sf_dir):
    """Cases whose roles do not alternate from user, or are unknown."""
    found = validate_lines(_cases_as_lines(spark, sf_dir))
    return found.select("case_id", F.array_contains("errors", "V9").alias("bad_role"), F.array_contains("errors", "V10").alias("bad_order"))


def validation_summary(spark, sf_dir):
    return summarize_validation(validate_lines(_cases_as_lines(spark, sf_dir)))


QUERIES = {
    "token_counts": token_counts,
    "lexical_tokens": lexical_tokens,
    "sentences": sentences,
    "normalize_text": normalize_text,
    "content_words": content_words,
    "normalize_roles": normalize_roles,
    "full_context": _method(full_context),
    "last_n": _method(last_n),
    "head_tail": _method(head_tail),
    "token_reduction": token_reduction,
    "bm25_scores": bm25_scores,
    "hashed_vectors": hashed_vectors,
    "hybrid_scores": hybrid_scores,
    "score_only": score_only,
    "embedding_survivors": embedding_survivors,
    "dedup_survivors": dedup_survivors,
    "dedup_groups": dedup_groups,
    "recency_floor": recency_floor,
    "tier_assignment": tier_assignment,
    "tier_counts": tier_counts,
    "word_information": word_info,
    "prune_words": prune_words,
    "extractive_select": extractive_select,
    "compress_turns": compress_turns,
    "compress_pipeline": compress_pipeline,
    "generous_pipeline": generous_pipeline,
    "adapter_batch": adapter_batch,
    "eval_results": eval_results,
    "eval_summary": eval_summary,
    "category_pivot": answer_pivot,
    "rate_distortion": eval_rate_distortion,
    "eval_pipeline": eval_pipeline,
    "leakage_check": leakage_check,
    "validation_findings": validation_findings,
    "validation_roles": validation_roles,
    "validation_summary": validation_summary,
}

# --- SQL ---------------------------------------------------------------------

_WORDS = r"regexp_extract_all({0}, '[^\s\x0B]+')"
_BASE = f"""t AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn_id, role, text AS content, len({_WORDS.format('text')}) AS tc FROM conversations)"""
_BUDGET = """b AS (SELECT t.*, greatest(1, CAST(floor(sum(tc) OVER (PARTITION BY conv_id) * {0}::DOUBLE) AS INTEGER)) AS budget FROM t)"""
_LEX = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_ASKED = """a AS (SELECT * FROM (SELECT t.*, last_value(content) OVER w AS query, max(turn_id) OVER w AS mt FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE turn_id < mt)"""
_SENT = r"list_filter(list_transform(string_split(regexp_replace(trim(content), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def _bm25(src: str, key: str, ident: str, text: str) -> str:
    """CTEs tok, st, idf, bm(key, ident, bm25) over src(key, ident, text, query)."""
    return f"""
     doc AS (SELECT {key}, {ident}, {_LEX.format(text)} AS terms, {_LEX.format('query')} AS q FROM {src}),
     st AS (SELECT {key}, count(*) AS n, avg(len(terms)) AS avgdl FROM doc GROUP BY {key}),
     tf AS (SELECT {key}, {ident}, term, count(*) AS tf FROM (SELECT {key}, {ident}, unnest(terms) AS term FROM doc) GROUP BY ALL),
     df AS (SELECT {key}, term, count(*) AS df FROM tf GROUP BY ALL),
     raw AS (SELECT df.*, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN st USING ({key})),
     idf AS (SELECT *, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY {key}) ELSE raw END AS idf FROM raw),
     qt AS (SELECT {key}, {ident}, term, count(*) AS qn FROM (SELECT {key}, {ident}, unnest(q) AS term FROM doc) GROUP BY ALL),
     bm AS (SELECT {key}, {ident}, round(coalesce(sum(idf * qn * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(terms) / avgdl))), 0), 6) AS bm25
            FROM doc LEFT JOIN (tf JOIN qt USING ({key}, {ident}, term) JOIN idf USING ({key}, term)) USING ({key}, {ident}) LEFT JOIN st USING ({key}) GROUP BY ALL)"""


def _vec(src: str, keys: str, text: str, name: str) -> str:
    bucket = "(('0x' || substr(md5(w), 31, 2))::INTEGER % 64)"
    return f"""
     {name}w AS (SELECT {keys}, {bucket} AS b, count(*) AS n FROM (SELECT {keys}, unnest({_LEX.format(text)}) AS w FROM {src}) GROUP BY ALL),
     {name} AS (SELECT {keys}, list(coalesce(n, 0)::DOUBLE ORDER BY i) AS v FROM (SELECT {keys}, unnest(range(64)) AS i FROM {src}) x LEFT JOIN (SELECT {keys}, b AS i, n FROM {name}w) y USING ({keys}, i) GROUP BY {keys})"""


_COS = "round(list_inner_product({0}, {1}) / ((sqrt(list_inner_product({0}, {0})) + 1e-12) * (sqrt(list_inner_product({1}, {1})) + 1e-12)), 6)"


def _scale(x: str, key: str) -> str:
    lo, hi = f"min({x}) OVER (PARTITION BY {key})", f"max({x}) OVER (PARTITION BY {key})"
    return f"CASE WHEN {hi} - {lo} < 1e-12 THEN 0.5 ELSE ({x} - {lo}) / ({hi} - {lo}) END"


_SCORES = f"""WITH {_BASE}, {_ASKED}, {_bm25('a', 'conv_id', 'turn_id', 'content')}, {_vec('a', 'conv_id, turn_id', 'content', 'dv')},
     qs AS (SELECT DISTINCT conv_id, query FROM a), {_vec('qs', 'conv_id', 'query', 'qv')},
     cs AS (SELECT dv.conv_id, dv.turn_id, {_COS.format('dv.v', 'qv.v')} AS cosine FROM dv JOIN qv USING (conv_id)),
     sc AS (SELECT conv_id, turn_id, cosine, round(0.6 * ({_scale('cosine', 'conv_id')}) + 0.4 * ({_scale('bm25', 'conv_id')}), 6) AS score FROM cs JOIN bm USING (conv_id, turn_id))
"""


def _fold(src: str, key: str, theta: float) -> str:
    """CTE s(key, id, survivor): src(key, id, v) folded in id order by recursion."""
    return f"""
     o AS (SELECT {key} AS k, id, v, row_number() OVER (PARTITION BY {key} ORDER BY id) AS i FROM {src}),
     p AS (SELECT x.k, x.i, list(y.i ORDER BY y.i) AS near FROM o x JOIN o y ON x.k = y.k AND y.i < x.i AND {_COS.format('x.v', 'y.v')} >= {theta} GROUP BY ALL),
     f AS (SELECT k, 0::BIGINT AS i, [0::BIGINT] AS kept, 0::BIGINT AS own FROM (SELECT DISTINCT k FROM o)
           UNION ALL
           SELECT f.k, o.i, CASE WHEN len(list_intersect(coalesce(p.near, []::BIGINT[]), f.kept)) = 0 THEN list_append(f.kept, o.i) ELSE f.kept END,
                  coalesce(list_min(list_intersect(coalesce(p.near, []::BIGINT[]), f.kept)), o.i)
           FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1 LEFT JOIN p ON p.k = o.k AND p.i = o.i),
     s AS (SELECT o.k AS {key}, o.id, m.id AS survivor FROM f JOIN o ON o.k = f.k AND o.i = f.i JOIN o m ON m.k = f.k AND m.i = f.own)"""


_SURVIVORS = f"""WITH RECURSIVE {_BASE}, {_vec('t', 'conv_id, turn_id', 'content', 'dv')}, src AS (SELECT conv_id, turn_id AS id, v FROM dv), {_fold('src', 'conv_id', THETA)}"""

_CASES = f"""m AS (SELECT conv_id, max(turn_id) AS last, max(turn_id) // 2 AS mid FROM t GROUP BY conv_id),
     c AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS case_id, CASE WHEN last < 4 THEN 'recency' ELSE 'lexical' END AS category,
                  array_to_string(({_WORDS.format('content')})[1:3], ' ') AS gold, mid FROM t JOIN m USING (conv_id) WHERE turn_id = mid AND last > 0),
     z AS (SELECT c.*, s.orig, method, frac, greatest(1, CAST(floor(frac * orig) AS INTEGER)) AS budget FROM c JOIN (SELECT conv_id, sum(tc) AS orig FROM t GROUP BY conv_id) s USING (conv_id),
           (SELECT 'full_context' AS method, 1.0::DOUBLE AS frac UNION ALL SELECT m, f FROM (SELECT unnest(['last_n', 'head_tail']) AS m), (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.75]::DOUBLE[]) AS f))),
     y AS (SELECT *, CAST(floor(budget * 0.9::DOUBLE) AS INTEGER) AS eff FROM z),
     w AS (SELECT y.conv_id, method, frac, eff, turn_id, content, tc, row_number() OVER up AS rn, sum(tc) OVER up AS up, sum(tc) OVER down AS down FROM y JOIN t USING (conv_id)
           WINDOW up AS (PARTITION BY y.conv_id, method, frac ORDER BY turn_id ROWS UNBOUNDED PRECEDING), down AS (PARTITION BY y.conv_id, method, frac ORDER BY turn_id DESC ROWS UNBOUNDED PRECEDING)),
     h AS (SELECT *, rn <= 2 AND up <= eff AS head FROM w),
     h2 AS (SELECT *, coalesce(sum(tc) FILTER (head) OVER (PARTITION BY conv_id, method, frac), 0) AS used,
                   sum(tc) FILTER (NOT head) OVER (PARTITION BY conv_id, method, frac ORDER BY turn_id DESC ROWS UNBOUNDED PRECEDING) AS tail FROM h),
     k AS (SELECT conv_id, method, frac, sum(tc) AS kept, trim(regexp_replace(lower(string_agg(content, chr(10) ORDER BY turn_id)), '\\s+', ' ', 'g')) AS txt FROM h2
           WHERE method = 'full_context' OR (method = 'last_n' AND down <= eff) OR (method = 'head_tail' AND (head OR tail <= eff - used)) GROUP BY ALL),
     e AS (SELECT case_id, category, y.method, y.frac AS budget_frac, budget AS budget_tokens, eff AS effective_budget, CAST(orig AS BIGINT) AS original_tokens, CAST(coalesce(kept, 0) AS BIGINT) AS compressed_tokens,
                  round_even(100.0::DOUBLE * (1.0::DOUBLE - coalesce(kept, 0) / orig), 3) AS token_reduction_pct,
                  CASE WHEN kept > 0 THEN round_even(orig / kept, 4) ELSE 'inf'::DOUBLE END AS compression_ratio,
                  CASE WHEN contains(coalesce(txt, ''), trim(regexp_replace(lower(gold), '\\s+', ' ', 'g'))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS evidence_recall,
                  CASE WHEN y.method <> 'full_context' THEN CAST(coalesce(kept, 0) <= eff AS INTEGER) END AS within_budget
           FROM y LEFT JOIN k ON k.conv_id = y.conv_id AND k.method = y.method AND k.frac = y.frac)"""

_SUMMARY = f"""WITH {_BASE}, {_CASES}, su AS (SELECT method, budget_frac, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS n_cases,
       round_even(avg(token_reduction_pct), 2) AS mean_token_reduction_pct, round_even(avg(compression_ratio) FILTER (compression_ratio <> 'inf'::DOUBLE), 3) AS mean_compression_ratio,
       round_even(avg(evidence_recall), 4) AS mean_evidence_recall, round_even(avg(evidence_recall), 4) AS answer_present_rate, round_even(avg(within_budget), 3) AS within_budget_rate, CAST(0 AS BIGINT) AS n_errors
     FROM e GROUP BY GROUPING SETS ((method, budget_frac, category), (method, budget_frac)))"""

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TIERS = f"""{_SCORES.replace('WITH', 'WITH RECURSIVE', 1)},
     d AS (SELECT a.*, score, greatest(1, CAST(floor(sum(tc) OVER (PARTITION BY conv_id) * 0.5::DOUBLE) AS INTEGER)) AS budget, sum(tc) OVER n AS spent, row_number() OVER n AS rn FROM a JOIN sc USING (conv_id, turn_id)
           WINDOW n AS (PARTITION BY conv_id ORDER BY turn_id DESC ROWS UNBOUNDED PRECEDING)),
     o AS (SELECT conv_id, turn_id, tc, score, budget, rn <= 1 AND spent <= budget * 0.5::DOUBLE AS recent, CAST(ceil(tc * 0.3::DOUBLE) AS BIGINT) AS short FROM d),
     q AS (SELECT o.*, row_number() OVER (PARTITION BY conv_id ORDER BY recent DESC, score DESC, turn_id) AS i FROM o),
     f AS (SELECT conv_id, 0::BIGINT AS i, CAST(max(budget) AS BIGINT) AS left_, NULL::VARCHAR AS tier, 0 AS turn_id FROM q GROUP BY conv_id
           UNION ALL
           SELECT f.conv_id, q.i, CAST(left_ - CASE WHEN recent OR left_ >= tc THEN tc WHEN left_ >= short THEN short ELSE 0 END AS BIGINT),
                  CASE WHEN recent THEN 'KEEP_RECENT' WHEN left_ >= tc THEN 'KEEP_FULL' WHEN left_ >= short THEN 'COMPRESS' ELSE 'DROP' END, q.turn_id
           FROM f JOIN q ON q.conv_id = f.conv_id AND q.i = f.i + 1)"""
_INFO = f"""WITH {_BASE}, x AS (SELECT conv_id, turn_id, unnest({_WORDS.format('content')}) AS word, generate_subscripts({_WORDS.format('content')}, 1) - 1 AS pos FROM t),
      y AS (SELECT *, lower(word) AS w, lag(lower(word)) OVER (PARTITION BY conv_id, turn_id ORDER BY pos) AS v FROM x), pr AS (SELECT v, w, count(*) AS vw FROM y WHERE v IS NOT NULL GROUP BY ALL),
      hd AS (SELECT v, sum(vw) AS vn FROM pr GROUP BY v), sz AS (SELECT count(DISTINCT w) AS size FROM pr),
      i AS (SELECT conv_id, turn_id, pos, word, CASE WHEN v IS NOT NULL THEN round(-ln((vw + 0.1::DOUBLE) / (vn + 0.1::DOUBLE * size)), 6) END AS own FROM y LEFT JOIN pr USING (v, w) LEFT JOIN hd USING (v), sz),
      wi AS (SELECT conv_id, turn_id, CAST(pos AS INTEGER) AS pos, word, coalesce(own, median(own) OVER (PARTITION BY conv_id, turn_id), 0) AS info FROM i)"""

ORACLE_SQL = {
    "token_counts": f"WITH {_BASE} SELECT conv_id, count(*) AS n_turns, CAST(sum(tc) AS BIGINT) AS n_tokens, CAST(max(tc) AS INTEGER) AS most FROM t GROUP BY conv_id",
    "lexical_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest({_LEX.format('text')}) AS token FROM conversations) GROUP BY token",
    "sentences": f"WITH {_BASE}, x AS (SELECT conv_id, turn_id, {_SENT} AS l FROM t) SELECT conv_id, turn_id, CAST(unnest(range(len(l))) AS INTEGER) AS sent_id, unnest(l) AS sentence FROM x",
    "normalize_text": r"SELECT conv_id, CAST(turn AS INTEGER) AS turn_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS normal FROM conversations",
    "content_words": f"SELECT conv_id, CAST(turn AS INTEGER) AS turn_id, array_to_string(list_sort(list_distinct(list_filter({_LEX.format('text')}, lambda w: length(w) >= 4 AND w NOT IN ({_STOP})))), ' ') AS words FROM conversations",
    "normalize_roles": "SELECT role, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY role",
    "full_context": f"WITH {_BASE} SELECT conv_id, turn_id, CAST(tc AS INTEGER) AS token_count FROM t",
    "last_n": f"WITH {_BASE}, {_BUDGET.format('0.3')} SELECT conv_id, turn_id, CAST(tc AS INTEGER) AS token_count FROM (SELECT *, sum(tc) OVER (PARTITION BY conv_id ORDER BY turn_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM b) WHERE s <= budget",
    "head_tail": f"""WITH {_BASE}, {_BUDGET.format('0.3')}, h AS (SELECT *, row_number() OVER w <= 2 AND sum(tc) OVER w <= budget AS head FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn_id ROWS UNBOUNDED PRECEDING)),
      u AS (SELECT *, coalesce(sum(tc) FILTER (head) OVER (PARTITION BY conv_id), 0) AS used, sum(tc) FILTER (NOT head) OVER (PARTITION BY conv_id ORDER BY turn_id DESC ROWS UNBOUNDED PRECEDING) AS tail FROM h)
      SELECT conv_id, turn_id, CAST(tc AS INTEGER) AS token_count FROM u WHERE head OR tail <= budget - used""",
    "token_reduction": f"""WITH {_BASE}, {_BUDGET.format('0.3')}, s AS (SELECT *, sum(tc) OVER (PARTITION BY conv_id ORDER BY turn_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM b)
      SELECT conv_id, CAST(sum(tc) AS BIGINT) AS original, CAST(coalesce(sum(tc) FILTER (s <= budget), 0) AS BIGINT) AS kept, round(100.0::DOUBLE * (1.0::DOUBLE - coalesce(sum(tc) FILTER (s <= budget), 0) / sum(tc)), 3) AS reduction_pct FROM s GROUP BY conv_id""",
    "bm25_scores": f"WITH {_BASE}, {_ASKED}, {_bm25('a', 'conv_id', 'turn_id', 'content')} SELECT conv_id, turn_id, bm25 FROM bm",
    "hashed_vectors": f"WITH {_BASE}, {_vec('t', 'conv_id, turn_id', 'content', 'dv')} SELECT conv_id, turn_id, array_to_string(list_transform(v, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ' ') AS vector FROM dv",
    "hybrid_scores": f"{_SCORES} SELECT conv_id, turn_id, cosine, score FROM sc",
    "score_only": f"{_SCORES} SELECT conv_id, turn_id, score FROM sc",
    "embedding_survivors": f"WITH RECURSIVE src AS (SELECT CAST(vec_id // 40 AS BIGINT) AS run, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), {_fold('src', 'run', 0.3)} SELECT run, id AS vec_id, survivor FROM s",
    "dedup_survivors": f"{_SURVIVORS} SELECT conv_id, id AS turn_id, CAST(survivor AS BIGINT) AS survivor FROM s",
    "dedup_groups": f"{_SURVIVORS} SELECT conv_id, CAST(survivor AS BIGINT) AS survivor, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM s GROUP BY ALL HAVING count(*) > 1",
    "recency_floor": f"WITH {_BASE}, {_BUDGET.format('0.3')} SELECT conv_id, turn_id, row_number() OVER w <= 3 AND sum(tc) OVER w <= budget * 0.5::DOUBLE AS is_recent FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn_id DESC ROWS UNBOUNDED PRECEDING)",
    "tier_assignment": f"{_TIERS} SELECT conv_id, turn_id, tier FROM f WHERE i > 0",
    "tier_counts": f"{_TIERS} SELECT tier, count(*) AS n FROM f WHERE i > 0 GROUP BY tier",
    "word_information": f"{_INFO} SELECT * FROM wi",
    "prune_words": f"""{_INFO}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn_id ORDER BY info DESC, pos) AS rn, count(*) OVER (PARTITION BY conv_id, turn_id) AS n FROM wi)
      SELECT conv_id, turn_id, string_agg(word, ' ' ORDER BY pos) AS text FROM r WHERE rn <= greatest(1, round_even(n * 0.5::DOUBLE, 0)) GROUP BY ALL""",
    "generous_pipeline": f"WITH {_BASE}, {_ASKED} SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages, CAST(sum(tc) AS BIGINT) AS original_tokens, CAST(sum(tc) AS BIGINT) AS compressed_tokens, 1.0::DOUBLE AS compression_ratio FROM a GROUP BY conv_id",
    "eval_results": f"WITH {_BASE}, {_CASES} SELECT *, evidence_recall AS answer_present FROM e",
    "eval_summary": f"{_SUMMARY} SELECT * FROM su",
    "category_pivot": f"{_SUMMARY} SELECT budget_frac, method, max(answer_present_rate) FILTER (category = 'lexical') AS lexical, max(answer_present_rate) FILTER (category = 'recency') AS recency FROM su GROUP BY ALL",
    "rate_distortion": f"{_SUMMARY} SELECT method, budget_frac, mean_token_reduction_pct, mean_evidence_recall, answer_present_rate FROM su WHERE category = 'ALL'",
    "leakage_check": f"WITH {_BASE}, {_CASES.replace('[1:3]', '[1:1]')} SELECT t.conv_id, t.turn_id, gold AS gold_answer FROM t JOIN c USING (conv_id) WHERE t.turn_id <> c.mid AND contains(lower(t.content), lower(gold))",
    "validation_roles": f"WITH {_BASE}, {_CASES} SELECT case_id, bool_or(role NOT IN ('user', 'assistant')) AS bad_role, bool_or(role IN ('user', 'assistant') AND role <> CASE WHEN turn_id % 2 = 0 THEN 'user' ELSE 'assistant' END) AS bad_order FROM t JOIN c USING (conv_id) GROUP BY case_id",
}
