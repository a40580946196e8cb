"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm import chat, decontaminate, language_model, minhash, mixing, quality, repeats, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


#: The contract's rules: host and path prefix, verdict.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: The method's own list, for what no rule decides: hosts that sell and cheat.
BLOCKED = ["adult-x.example.net/", "casino-win.example.com/", "cheap-pills.example.com/", "cheap-pills.example.net/", "casino-win.example.net/", "adult-x.example.com/", "spam-farm.example.com/", "spam-farm.example.net/"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(key, verdict, key) for key, verdict in RULES] + [(key, "block", None) for key in BLOCKED]
    named = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("verdict"), F.lit(r).cast("string").alias("rule")) for k, v, r in rows]
    listed = spark.range(1).select(F.inline(F.array(*named)))
    return url_filter.judge(_table(spark, sf_dir, "pages"), listed).select("page_id", "host", "path", "rule", "verdict")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_table(spark, sf_dir, "documents"), _fold(7) != 2)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "n_links")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.pairs_from_turns(_table(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return chat.preference_pairs(pairs).withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents")).drop("removed")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _fold(3) == 1)
    return out.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


#: Passages of 50 words and a little less: 99 of 100 runs of 51 words of prose have 246 bytes or more.
PASSAGE_BYTES = 240


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), passage=PASSAGE_BYTES).drop("kept")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_language_model": op2_language_model,
    "op3_decontaminate": op3_decontaminate,
    "op4_minhash": op4_minhash,
    "op5_mixing": op5_mixing,
    "op6_chat_format": op6_chat_format,
    "op8_warc": op8_warc,
    "op7_quality_rules": op7_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_repeats": op10_repeats,
}
_OP1 = """
WITH u AS (SELECT page_id, url, strpos(url, '://') AS p FROM pages),
     r AS (SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) END AS rest FROM u),
     h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
     l(key, verdict, rule) AS (VALUES %s),
     m AS (SELECT h.*, l.rule, l.verdict, row_number() OVER (PARTITION BY page_id ORDER BY (l.rule IS NOT NULL) DESC, length(l.key) DESC, l.key DESC) AS n
           FROM h LEFT JOIN l ON (h.host = split_part(l.key, '/', 1) OR ends_with(h.host, '.' || split_part(l.key, '/', 1)))
                             AND starts_with(h.path, substr(l.key, strpos(l.key, '/'))))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
""" % ", ".join([f"('{k}', '{v}', '{k}')" for k, v in RULES] + [f"('{k}', 'block', NULL)" for k in BLOCKED])

_OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
     bs AS (SELECT item, least(13, len(w)) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS size FROM b WHERE len(w) > 0),
     bw AS (SELECT DISTINCT item, n, array_to_string(l[1 : n], ' ') AS g FROM (SELECT item, n, i, size, list(x) OVER (PARTITION BY item ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l FROM bs) WHERE i + n - 1 <= size),
     ns AS (SELECT DISTINCT n FROM bw),
     ds AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS size FROM d WHERE len(w) > 0),
     dl AS (SELECT doc_id, i, size, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l FROM ds),
     dw AS (SELECT doc_id, n, i, array_to_string(l[1 : n], ' ') AS g FROM dl JOIN ns ON i + n - 1 <= size),
     hit AS (SELECT doc_id, n, i, item FROM dw JOIN bw USING (n, g)),
     word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
     its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_OP6 = """
WITH t AS (SELECT conv_id, coalesce(role, 'user') AS role, role AS raw_role, coalesce(text, '') AS raw,
                  replace(replace(coalesce(text, ''), '<|im_start|>', '<' || chr(8203) || '|im_start|>'), '<|im_end|>', '<' || chr(8203) || '|im_end|>') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations),
     s AS (SELECT conv_id, max(i) FILTER (role = 'assistant') AS last, min(i) FILTER (role = 'assistant') AS first, max(i) AS n,
                  max(text) FILTER (role = 'assistant' AND i = (SELECT min(i) FROM t u WHERE u.conv_id = t.conv_id AND u.role = 'assistant')) AS reply FROM t GROUP BY conv_id),
     f AS (SELECT s.*, coalesce((SELECT text FROM t WHERE t.conv_id = s.conv_id AND t.i = s.last), '') AS own FROM s),
     p AS (SELECT *, CASE WHEN last IS NULL THEN n WHEN last > first AND own = reply THEN last ELSE last - 1 END AS k, CASE WHEN last > first AND own <> reply THEN reply END AS other FROM f),
     r AS (SELECT t.conv_id, i, t.role, '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) AS line, k FROM t JOIN p USING (conv_id)),
     c AS (SELECT *, coalesce(sum(length(line)) FILTER (i > k) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM r)
SELECT conv_id, k AS n_prompt_turns, coalesce(string_agg(line, '' ORDER BY i) FILTER (i <= k), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY i) FILTER (i > k), '') AS chosen_completion,
       coalesce(string_agg(CAST(CAST(begun AS BIGINT) + 13 + length(role) AS VARCHAR) || '-' || CAST(CAST(begun AS BIGINT) + length(line) - 1 AS VARCHAR), ',' ORDER BY i) FILTER (i > k AND role = 'assistant'), '') AS chosen_mask,
       coalesce('<|im_start|>assistant' || chr(10) || any_value(other) || '<|im_end|>' || chr(10), '') AS rejected_completion,
       coalesce('22-' || CAST(22 + length(any_value(other)) + 10 AS VARCHAR), '') AS rejected_mask,
       count(*) FILTER (i > k) = 0 AND any_value(other) IS NULL AS same
FROM c JOIN (SELECT conv_id, other FROM p) USING (conv_id) GROUP BY conv_id, k
"""

_OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
     ws AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
     g AS (SELECT doc_id, i, n, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM ws WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
     m AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE i + 2 <= n) WHERE c > 1),
     rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM m) GROUP BY doc_id),
     l AS (SELECT doc_id, host, line, array_to_string(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> ''), ' ') AS norm
           FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
     dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
     size AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
     freq AS (SELECT host, norm FROM l JOIN size USING (host) GROUP BY host, norm, docs HAVING count(DISTINCT doc_id) > greatest(20, docs * 0.01)),
     lost AS (SELECT doc_id, sum(len(string_split(norm, ' '))) AS lost FROM l JOIN freq USING (host, norm) GROUP BY doc_id),
     o AS (SELECT doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS c, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost
           FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, coalesce(c, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, lost AS n_boilerplate_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 * n_words AS kept
FROM o
"""

_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
     m AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN n >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> least THEN least END AS refers_to
FROM m
"""

ORACLE_SQL: dict[str, str] = {"op1_url_filter": _OP1, "op3_decontaminate": _OP3, "op6_chat_format": _OP6, "op7_quality_rules": _OP7, "op8_warc": _OP8}
