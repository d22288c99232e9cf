"""Queries for the text functions, over whole columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, text
from .registry import query

_SPLIT = r"regexp_replace(' ' || trim({0}) || ' ', '[\{{\}}\[\](),.\"'';:!?&^/*-]', ' ', 'g')"
_ASCII = "strip_accents(replace(replace(replace({0}, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'))"
_CASE = f"lower({_ASCII.format('trim(' + _SPLIT + ')')})"
_STRIPPED = "trim(trim(trim({0}, ' -_.,''?!'), '\"'))"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_VALID = f"({_STRIPPED.format('w')} != '' AND NOT regexp_full_match({_STRIPPED.format('w')}, '[0-9]+') AND (length({_STRIPPED.format('w')}) > 2 OR (regexp_full_match({_STRIPPED.format('w')}, '\\pL+') AND {_STRIPPED.format('w')} = upper({_STRIPPED.format('w')}))) AND {_STRIPPED.format('w')} NOT IN ({_STOP}))"


def case_sql(c: str) -> str:
    return _CASE.format(c)


def tokens_sql(c: str) -> str:
    """A list; words of the phrase that are valid (single digits never are)."""
    return f"list_filter(list_filter(string_split_regex(trim({case_sql(c)}), '\\s+'), lambda x: x != ''), lambda w: {_VALID})"


_TEXTS = "texts AS (SELECT 'part' AS t, p_partkey AS id, p_name AS v FROM part UNION ALL SELECT 'benchmark', item_id, text FROM benchmark UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation UNION ALL SELECT 'pages', page_id, url FROM pages)"


def texts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, k, c in (("part", "p_partkey", "p_name"), ("benchmark", "item_id", "text"), ("nation", "n_nationkey", "n_name"), ("pages", "page_id", "url")):
        df = spark.read.parquet(f"{d}/{t}.parquet").select(F.lit(t).alias("t"), F.col(k).cast("long").alias("id"), F.col(c).alias("v"))
        out = df if out is None else out.unionByName(df)
    return out


def _of(name: str, sql: str, column: Callable[[], Column]) -> None:
    @query(name, f"WITH {_TEXTS} SELECT t, CAST(id AS BIGINT) AS id, {sql} AS out FROM texts")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return texts(spark, d).select("t", "id", column().alias("out"))


def register() -> None:
    _of("text_stripped", _STRIPPED.format("v"), lambda: text.stripped("v"))
    _of("text_case_phrase", case_sql("v"), lambda: text.case_phrase("v"))
    _of("text_tokens", f"array_to_string({tokens_sql('v')}, '|')", lambda: F.array_join(text.tokens("v"), "|"))
    _of("text_valid_phrase", f"nullif(array_to_string({tokens_sql('v')}, ' '), '')", lambda: text.valid_phrase("v"))
    _of("text_acronym", f"CASE WHEN len({tokens_sql('v')}) BETWEEN 3 AND 7 THEN array_to_string(list_transform({tokens_sql('v')}, lambda x: upper(substr(x, 1, 1))), '') END", lambda: text.acronym(text.tokens("v")))
    _of("text_ngrams", "array_to_string(list_transform(range(1, greatest(length(v) - 1, 1)), lambda i: substr(v, i, 3)), '~')", lambda: F.array_join(text.char_ngrams("v", 3), "~"))
    _of("text_distinct_chars", "CAST(len(list_distinct(string_split(v, ''))) AS INTEGER)", lambda: text.distinct_chars("v"))
    _of("text_numeric", "regexp_full_match(translate(v, ',.', ''), '[0-9]+')", lambda: text.is_numeric("v"))
    _of("text_code_chars", "translate(v, '-’', '–''')", lambda: text.code_chars("v"))
    _of("text_synonyms", "replace(replace(v, 'a', 'b'), 'b', 'cc')", lambda: text.replace_synonyms("v", [("a", "b"), ("b", "cc")]))
    _of("text_cover_score", f"CASE WHEN greatest(length(v), length({case_sql('v')})) = 0 THEN 0 ELSE 100.0 * CAST(least(length(v), length({case_sql('v')})) AS DOUBLE) / greatest(length(v), length({case_sql('v')})) END", lambda: text.cover_score("v", text.case_phrase("v")))
    _of("text_category", "CASE WHEN regexp_matches(lower(v), 'http') THEN 'link' WHEN regexp_matches(lower(v), 'th') THEN 'prose' END", lambda: text.category("v", [("http", "link"), ("th", "prose")]))


register()

_PHONE = "'0' || CAST(1 + c_custkey % 9 AS VARCHAR) || ' ' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ' 12 34 56'"


@query("text_char_template", "SELECT o_orderkey, CASE WHEN length(v) BETWEEN 5 AND 16 AND regexp_matches(v, '[0-9]') THEN regexp_replace(regexp_replace(regexp_replace(v, '[^0-9A-Za-z]', '?', 'g'), '[A-Za-z]', 'L', 'g'), '[0-9]', 'D', 'g') || '$' END AS template FROM (SELECT o_orderkey, o_orderpriority AS v FROM orders)")
def text_char_template(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.char_template("o_orderpriority").alias("template"))


@query("type_phone", f"SELECT c_custkey, '+33 ' || substr(p, 2, 1) || ' ' || substr(p, 4, 2) || ' 12 34 56' AS phone FROM (SELECT c_custkey, {_PHONE} AS p FROM customer)")
def type_phone(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("0"), (1 + F.col("c_custkey") % 9).cast("string"), F.lit(" "), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit(" 12 34 56"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", checks.phone(raw).alias("phone"))


@query("type_date", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS iso, strftime(o_orderdate, '%m/%Y') AS month_only FROM orders")
def type_date(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", checks.date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("iso"), checks.date(F.date_format("o_orderdate", "MM/yyyy")).alias("month_only"))


_LUHN = "(10 - (list_sum(list_transform(range(1, 9), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(b, i, 1) AS INT) ELSE CAST(substr(b, i, 1) AS INT) * 2 - CASE WHEN CAST(substr(b, i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10)) % 10"


@query("type_luhn", f"SELECT p_partkey, v, CASE WHEN CAST(substr(v, 9, 1) AS INT) = {_LUHN} THEN v END AS siren FROM (SELECT p_partkey, lpad(CAST(10000000 + p_partkey * 7919 AS VARCHAR), 8, '0') AS b, lpad(CAST(10000000 + p_partkey * 7919 AS VARCHAR), 8, '0') || CAST(p_partkey % 10 AS VARCHAR) AS v FROM part)")
def type_luhn(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat(F.lpad((10000000 + F.col("p_partkey") * 7919).cast("string"), 8, "0"), (F.col("p_partkey") % 10).cast("string"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", v.alias("v"), checks.siren(v).alias("siren"))


@query("type_email", "SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), '') AS email FROM documents")
def type_email(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.column_types import EMAIL

    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.nullif(F.regexp_extract("text", EMAIL, 0), F.lit("")).alias("email"))


@query("type_url", "SELECT page_id, nullif(regexp_extract(url, '^https?://[^\\s<>\"]+'), '') AS url FROM pages")
def type_url(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.column_types import URL

    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.nullif(F.regexp_extract("url", f"^{URL}", 0), F.lit("")).alias("url"))


@query("prefix_code", "SELECT o_orderkey, CASE WHEN regexp_full_match(substr(v, 1, 5), '[0-9]{5}') THEN substr(v, 1, 5) END AS code, CASE WHEN regexp_full_match(substr(v, 1, 5), '[0-9]{5}') THEN trim(substr(v, 6)) END AS rest FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 5, '0') || ' ' || o_orderpriority ELSE o_orderpriority END AS v FROM orders)")
def prefix_code(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lpad(F.col("o_custkey").cast("string"), 5, "0"), F.lit(" "), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.prefix_code(v).alias("p")).select("o_orderkey", "p.code", "p.rest")


@query("ngram_counts", "WITH g AS (SELECT unnest(list_transform(range(1, greatest(length(p_name) - 1, 1)), lambda i: substr(p_name, i, 3))) AS gram FROM part) SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 3")
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    grams = spark.read.parquet(f"{d}/part.parquet").select(F.explode(text.char_ngrams("p_name", 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("unique_concat", "SELECT p_brand, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def unique_concat(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").groupBy("p_brand").agg(text.joined_unique(F.array_sort(F.collect_set("p_type"))).alias("types"))


@query("type_composite", "SELECT p_partkey AS row_id, 'Brand part' AS type, v AS hit FROM (SELECT p_partkey, p_brand || ' ' || p_type AS v FROM part) UNION ALL SELECT p_partkey, 'Brand', p_brand FROM part UNION ALL SELECT p_partkey, 'Kind', p_type FROM part")
def type_composite(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import column_types as ct

    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("row_id"), F.concat_ws(" ", "p_brand", "p_type").alias("v"))
    found = ct.composite("Brand part", r"^(Brand#[0-9]+) (.+)$", [("Brand", "^Brand"), ("Kind", "^[A-Z]+$")])
    return ct.expression_hits(ct.cells_of(rows, ["v"]), found).select("row_id", "type", "hit")


@query("type_vocabulary", f"SELECT p_partkey AS row_id, nullif(regexp_extract({case_sql('p_name')}, '\\b((?:ring|bolt|gear)\\b.*)$', 1), '') AS hit FROM part WHERE regexp_matches({case_sql('p_name')}, '\\b(ring|bolt|gear)\\b')")
def type_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import column_types as ct

    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("row_id"), "p_name")
    return ct.expression_hits(ct.cells_of(rows, ["p_name"]), [ct.vocabulary("Piece", ["ring", "bolt", "gear"])]).select("row_id", "hit")
