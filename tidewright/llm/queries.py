"""The registered queries of the ten operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, exact_dedup, jaccard, mixing, packing, quality, suffix_dedup, tokens, toxicity, url_filter
from .common import only, table, tune

URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_CONTROL = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, read back from what was rendered."""
    rows = only(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", _CONTROL), (-7, 1, "assistant", _CONTROL)], "conv_id long, turn long, role string, text string")
    tune(spark)
    return chat_format.digests(chat_format.pieces(chat_format.fold_events(rows.unionByName(extra))))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(only(table(spark, sf_dir, "documents"), "doc_id", "text"), tokens.tokenizer_path())


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.tokenize_documents(only(table(spark, sf_dir, "documents"), "doc_id", "text"), tokens.tokenizer_path())
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(only(table(spark, sf_dir, "pages"), "page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(only(table(spark, sf_dir, "documents"), "doc_id", "source"))
    return mixed.select("doc_id", "source", "mix_block", "mix_rank", "mix_slot")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *quality.BASE, "base_failed", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_best_fit_packing, op3_token_records, op4_ngram_jaccard, op5_url_filter, op6_source_mixing, op7_quality_rules, op8_exact_dedup, op9_suffix_dedup, op10_toxicity)}

_ESCAPED = "length({0}) + length({0}) - length(replace(replace(replace({0}, '\\', ''), '#', ''), '<', ''))"

ORACLES = {
    "op1_chat_format": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + {_ESCAPED.format("role")} + length(role) - length(replace(role, ':', '')) + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op5_url_filter": """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM d""",
    "op6_source_mixing": f"""
WITH RECURSIVE n AS (SELECT greatest(1, (count(*) + {mixing.BUCKET_ROWS - 1}) // {mixing.BUCKET_ROWS}) AS buckets FROM documents),
k AS (SELECT doc_id, source, coalesce(source, '') AS s, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS key FROM documents),
r AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY key % buckets, key, doc_id) - 1 AS nth FROM k, n),
c AS (SELECT s, CAST(floor(sqrt(count(*))) AS BIGINT) AS root FROM r GROUP BY s),
w AS (SELECT row_number() OVER (ORDER BY s) AS i, s, greatest(1, ({mixing.PARTS} * root) // (SELECT CAST(sum(root) AS BIGINT) FROM c)) AS a FROM c),
l AS (SELECT list(a ORDER BY i) AS la, CAST(sum(a) AS BIGINT) AS q FROM w),
e AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(la, lambda x: CAST(0 AS BIGINT)) AS c, CAST(0 AS BIGINT) AS pick, la, q FROM l
  UNION ALL
  SELECT t + 1, list_transform(c, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p, la, q FROM (
    SELECT *, list_position(d, list_min(d)) AS p FROM (
      SELECT *, list_transform(la, lambda x, i: CASE WHEN (c[i] * q) // x <= t THEN ((c[i] + 1) * q + x - 1) // x ELSE 9000000000000000 END) AS d FROM e WHERE t < q))),
f AS (SELECT pick AS i, t - 1 AS slot, q, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM e WHERE t > 0)
SELECT r.doc_id, r.source, r.nth // {mixing.BLOCK_ROWS} AS mix_block, r.nth % {mixing.BLOCK_ROWS} AS mix_rank,
  ((r.nth // {mixing.BLOCK_ROWS}) // w.a) * f.q + f.slot AS mix_slot
FROM r JOIN w ON r.s = w.s JOIN f ON f.i = w.i AND f.j = (r.nth // {mixing.BLOCK_ROWS}) % w.a""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
}
