"""The operators' queries over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontamination, html, lm, negatives, packing, quality, repeats, simhash, toxicity, vectors, warc
from .common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) == 1)


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) == 0)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_summary(warc.archive_round_trip(_table(spark, sf_dir, "pages")))


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(_table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat.conversation_digests(chat.format_conversations(turns))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(table.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_warc": op7_warc,
    "op8_suffix_tree_lm": op8_suffix_tree_lm,
    "op9_packing": op9_packing,
    "op10_chat_format": op10_chat_format,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": r"""
WITH d AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS s
  FROM d, (SELECT 5 AS m UNION SELECT len(w) FROM b WHERE len(w) BETWEEN 1 AND 4)
), bs AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
  FROM b WHERE len(w) > 0
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) / n_shingles >= 0.8
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS last FROM p
), g AS (
  SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(i * 5 + 1 AS INTEGER), 5) AS BIGINT)) AS v FROM d
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((v[CAST(i // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM g
""",
    "op10_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS same,
    length(regexp_replace(role, '([<\[])(\\*(?:/?s>|/?INST\]|/?SYS>>|\|(?:start|body|next|end)\|>))', '\1\\\2', 'g')) AS role_chars,
    length(regexp_replace(text, '([<\[])(\\*(?:/?s>|/?INST\]|/?SYS>>|\|(?:start|body|next|end)\|>))', '\1\\\2', 'g')) AS text_chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(CAST(sum(CASE WHEN role = 'assistant' THEN length(text) END) AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN same THEN 8 ELSE 24 + role_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op11_suffix_dedup": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p, h FROM d
), s AS (
  SELECT doc_id, p, sha256(substr(h, 2 * p + 1, 100)) AS k FROM w
), g AS (
  SELECT doc_id, p FROM s QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id
), r AS (
  SELECT doc_id, p, CASE WHEN lag(p) OVER (PARTITION BY doc_id ORDER BY p) >= p - 50 THEN 0 ELSE 1 END AS new FROM g
), c AS (
  SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM r
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM c GROUP BY doc_id, span
), k AS (
  SELECT doc_id, b AS start, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS stop FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, -1, 0 FROM d)
)
SELECT doc_id, any_value(length(h)) // 2 AS n_bytes, any_value(length(h)) // 2 - CAST(sum(coalesce(stop, length(h) // 2) - start) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
  sha256(unhex(string_agg(substr(h, 2 * start + 1, 2 * (coalesce(stop, length(h) // 2) - start)), '' ORDER BY start))) AS kept_sha256
FROM k JOIN d USING (doc_id) GROUP BY doc_id
""",
    "op12_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_dot_product(a.v, o.v) AS BIGINT) AS score
  FROM e a JOIN e o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
""",
    "op13_filter_audit": r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, CAST(len(w) < 200 AS INT) + CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) * 2
    + CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS INT) * 4
    + CAST(regexp_matches(text, '[#$%&*|]') AS INT) * 8 + CAST(coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS INT) * 16 AS mask
  FROM t
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, step, bit, (SELECT coalesce(sum(y.bit), 0) FROM letters y WHERE strpos(filter_order, y.x) < step) AS before
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step) s JOIN letters ON substr(filter_order, step, 1) = x
), r AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, (SELECT filter_order, step, bit, CAST(before AS INT) AS before FROM steps) GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
""",
}
