"""Registered queries of the training-data operators: thin callers with production parameters.

Each takes (spark, sf_dir) and reads whole tables. ``LLM_ORACLES`` has DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (chat_format, filter_audit, license_scan, multi_index, packing, personal_data,
                            quality, secret_scan, sentencepiece_bpe, simhash_vptree, toxicity, voronoi_topk, whitening)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.secret_digest(docs, secret_scan.secret_field(docs))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_digest(_table(spark, sf_dir, "documents"),
                                           public_tokenizers.path("piece_bpe_32k.model"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_digest(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
                      "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat_format.format_digest(chat_format.records_of_rows(rows.unionByName(probe)))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_digest(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


LLM_QUERIES = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_pack": op3_pack,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_license_scan": op5_license_scan,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_multi_index": op8_multi_index,
    "op9_top_k": op9_top_k,
    "op10_chat_format": op10_chat_format,
    "op11_pii": op11_pii,
    "op12_filter_audit": op12_filter_audit,
    "op13_whitening": op13_whitening,
}

# A vector that can be compared: no NULL or non-finite component, not zero.
_FINE = """embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

# The template of op10 in SQL: one backslash behind the first character of a control string (one more if there are some).
_CONTROL = (r"([<\[])(\\*)(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\]|SYS>>|/SYS>>|\|im_start\|>|\|im_end\|>"
            r"|\|endoftext\|>|\|startoftext\|>)")

LLM_ORACLES: dict[str, str] = {
    "op10_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '{_CONTROL}', '\\1\\\\\\2\\3', 'g')) AS r,
             length(regexp_replace(text, '{_CONTROL}', '\\1\\\\\\2\\3', 'g')) AS t FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(r + t + length('<|turn|><|text|><|end|>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op8_multi_index": f"""
WITH RECURSIVE fine AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND {_FINE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least.c AS component_id, e.vec_id = least.c AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op12_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s::INTEGER AS step, filter_order[s] AS own, filter_order[1:s - 1] AS before
          FROM orders, range(1, 6) AS r(s)),
r AS (
  SELECT part, filter_order, step, own,
         n, good, toxic, contains(fails, own) AS hit,
         len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone, fails = own AS only_own
  FROM c, steps),
g AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (only_own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM g""",
    "op9_top_k": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE {_FINE}),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
