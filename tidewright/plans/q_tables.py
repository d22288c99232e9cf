"""Queries for pages, samples, upserts, projections and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import link, sampling
from ..sources import tables
from . import project
from .registry import query

_COLS = "event_id, user_id, event_type, value"


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value")


@query("page_by_id", f"SELECT {_COLS} FROM events WHERE event_id BETWEEN 100 AND 149")
def page_by_id(spark: SparkSession, d: str) -> DataFrame:
    return sampling.page_by_id(events(spark, d), "event_id", 100, 50)


@query("page_by_id_desc", f"SELECT {_COLS} FROM events WHERE event_id BETWEEN (SELECT max(event_id) FROM events) - 29 AND (SELECT max(event_id) FROM events) - 10")
def page_by_id_desc(spark: SparkSession, d: str) -> DataFrame:
    return sampling.page_by_id(events(spark, d), "event_id", 10, 20, descending=True)


_NULLED = "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS v FROM events"


@query("page_sorted_nulls", f"SELECT event_id, v FROM ({_NULLED}) ORDER BY v ASC NULLS FIRST, event_id LIMIT 40 OFFSET 10")
def page_sorted_nulls(spark: SparkSession, d: str) -> DataFrame:
    v = events(spark, d).select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("v"))
    return sampling.page_sorted(v, "v", "event_id", 10, 40)


@query("page_sorted_nulls_desc", f"SELECT event_id, v FROM ({_NULLED}) ORDER BY v DESC NULLS LAST, event_id LIMIT 40 OFFSET 10")
def page_sorted_nulls_desc(spark: SparkSession, d: str) -> DataFrame:
    v = events(spark, d).select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("v"))
    return sampling.page_sorted(v, "v", "event_id", 10, 40, descending=True)


@query("sample_head", f"SELECT {_COLS} FROM events ORDER BY event_id LIMIT 50")
def sample_head(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(events(spark, d), "event_id")


@query("sample_distinct", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type ORDER BY event_id LIMIT 50")
def sample_distinct(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(events(spark, d).select("event_id", "user_id", "event_type"), "event_id", distinct=True)


@query("mini_table", f"SELECT {_COLS} FROM events ORDER BY event_id LIMIT 500")
def mini_table(spark: SparkSession, d: str) -> DataFrame:
    return sampling.mini(events(spark, d), "event_id", 500)


@query("index_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'new' ELSE p_name END AS p_name FROM part UNION ALL SELECT -1, 'added'")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    changed = part.where("p_partkey % 10 = 0").select("p_partkey", F.lit("new").alias("p_name")).unionByName(spark.sql("SELECT -1L AS p_partkey, 'added' AS p_name"))
    return tables.upsert(part, changed, "p_partkey")


@query("select_with_flags", "SELECT c_name, c_name = 'x' AS c_name__MODIFIED FROM customer")
def select_with_flags(spark: SparkSession, d: str) -> DataFrame:
    return tables.select_columns(spark.read.parquet(f"{d}/customer.parquet").withColumn("c_name__MODIFIED", F.col("c_name") == "x"), ["c_name"])


@query("typed_na_strings", "SELECT c_custkey, CASE WHEN v IN ('NA', 'null') THEN NULL ELSE v END AS v FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NA' WHEN c_custkey % 3 = 1 THEN 'null' ELSE c_name END AS v FROM customer)")
def typed_na_strings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    v = spark.read.parquet(f"{d}/customer.parquet").select(k, F.when(k % 3 == 0, "NA").when(k % 3 == 1, "null").otherwise(F.col("c_name")).alias("v"))
    return v.select("c_custkey", F.when(~F.col("v").isin(*tables.NA_STRINGS), F.col("v")).alias("v"))


@query("row_ids", "SELECT count(*) AS n, min(row_id) AS lo, max(row_id) AS hi, count(DISTINCT row_id) AS distinct_ids FROM (SELECT row_number() OVER () - 1 AS row_id FROM orders)")
def row_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.with_row_id(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.count_distinct("row_id").alias("distinct_ids"))


@query("postings", "WITH w AS (SELECT p_partkey AS ref_id, string_split(lower(p_name), ' ') AS t FROM part), l AS (SELECT ref_id, list_filter(t, lambda x: length(x) > 2) AS t FROM w), x AS (SELECT ref_id, CAST(len(t) AS INTEGER) AS dl, unnest(t) AS term FROM l) SELECT 'p_name' AS field, 'words' AS analyzer, term, ref_id, dl, count(*) AS tf FROM x GROUP BY term, ref_id, dl")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return link.postings(spark.read.parquet(f"{d}/part.parquet"), "p_partkey", {"p_name": ("words",)})


_PROJECTS = "SELECT 'p' || CAST(c_custkey AS VARCHAR) AS project_id, c_custkey % 2 = 0 AS public, CAST(c_custkey * 3600 AS DOUBLE) AS created, CAST(c_custkey * 7200 AS DOUBLE) AS last_used FROM customer"


def projects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("p"), k.cast("string")).alias("project_id"), (k % 2 == 0).alias("public"), (k * 3600).cast("double").alias("created"), (k * 7200).cast("double").alias("last_used"))


@query("projects_by_access", f"SELECT * FROM ({_PROJECTS}) WHERE public")
def projects_by_access(spark: SparkSession, d: str) -> DataFrame:
    return project.by_access(projects(spark, d), "public")


@query("projects_by_age", f"SELECT * FROM ({_PROJECTS}) WHERE last_used < 1000000 - 3600 * 24")
def projects_by_age(spark: SparkSession, d: str) -> DataFrame:
    return project.by_age(projects(spark, d), "last_used", "before", 24, 1_000_000)
