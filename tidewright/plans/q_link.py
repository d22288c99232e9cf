"""Queries for linking and institution matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import grid, joins, link
from ..sources.shared import stored
from .q_text import case_sql, tokens_sql
from .registry import query


def read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def _key(*cols: str) -> str:
    joined = " || ' ' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)
    return f"nullif(trim({case_sql('trim(' + joined + ')')}), '')"


@query("link_exact_inner", f"SELECT n_nationkey, n_name, r_regionkey AS r_regionkey__REF, r_name AS r_name__REF FROM nation JOIN region ON {_key('n_regionkey')} = {_key('r_regionkey')}")
def link_exact_inner(spark: SparkSession, d: str) -> DataFrame:
    return joins.exact_link(read(spark, d, "nation"), read(spark, d, "region"), [(["n_regionkey"], ["r_regionkey"])]).select("n_nationkey", "n_name", "r_regionkey__REF", "r_name__REF")


@query("link_exact_left", "SELECT c_custkey, o_orderkey AS o_orderkey__REF, o_custkey AS o_custkey__REF FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def link_exact_left(spark: SparkSession, d: str) -> DataFrame:
    """All customers with their orders; customers without one stay."""
    return joins.exact_link(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select("o_orderkey", "o_custkey"), [(["c_custkey"], ["o_custkey"])], "left").select("c_custkey", "o_orderkey__REF", "o_custkey__REF")


@query("link_composite_key", f"SELECT a.p_partkey, b.k AS k__REF FROM part a JOIN (SELECT upper(p_name) AS n, p_brand AS b, min(p_partkey) AS k FROM part GROUP BY ALL) b ON {_key('a.p_name', 'a.p_brand')} = {_key('b.n', 'b.b')}")
def link_composite_key(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    ref = part.groupBy(F.upper("p_name").alias("n"), F.col("p_brand").alias("b")).agg(F.min("p_partkey").alias("k"))
    return joins.exact_link(part.select("p_partkey", "p_name", "p_brand"), ref, [(["p_name", "p_brand"], ["n", "b"])]).select("p_partkey", "k__REF")


@query("auto_label", "SELECT o_orderkey AS source_id, c_custkey AS ref_id FROM orders JOIN customer ON o_custkey = c_custkey")
def auto_label(spark: SparkSession, d: str) -> DataFrame:
    o, c = read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "customer").select("c_custkey")
    return joins.exact_link(o, c, [(["o_custkey"], ["c_custkey"])]).select(F.col("o_orderkey").alias("source_id"), F.col("c_custkey__REF").alias("ref_id"))


_AB = "a AS (SELECT item_id AS source_id, unnest(list_distinct({0})) AS t FROM benchmark), b AS (SELECT p_partkey AS ref_id, unnest(list_distinct({1})) AS t FROM part)"
_PART_A = "SELECT CAST(p_partkey AS BIGINT) AS sid, p_name || ' ' || lower(p_type) AS s FROM part WHERE p_partkey % 2 = 0"
_PART_B = "SELECT CAST(p_partkey AS BIGINT) AS rid, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS r FROM part WHERE p_partkey % 2 = 1"


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, d, "part").withColumn("t", F.concat_ws(" ", "p_name", F.lower("p_type")))
    source = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("sid"), F.col("t").alias("s"))
    return source, p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("rid"), F.concat_ws(" ", "t", F.lower("p_brand")).alias("r"))


@query(
    "link_token_overlap_top1",
    f"WITH s AS ({_PART_A}), f AS ({_PART_B}), a AS (SELECT sid AS source_id, unnest(list_distinct({tokens_sql('s')})) AS t FROM s), b AS (SELECT rid AS ref_id, unnest(list_distinct({tokens_sql('r')})) AS t FROM f),"
    " n AS (SELECT source_id, ref_id, count(*) AS overlap FROM a JOIN b ON a.t = b.t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY overlap DESC, ref_id) AS k FROM n) SELECT source_id, ref_id, overlap FROM r WHERE k = 1",
)
def link_token_overlap_top1(spark: SparkSession, d: str) -> DataFrame:
    s, r = _parts(spark, d)
    return link.token_overlap_top1(s, "sid", "s", r, "rid", "r")


def _bm25_sql(ref_where: str = "", forbid: str = "") -> str:
    return (
        f"WITH s AS ({_PART_A}), f AS (SELECT * FROM ({_PART_B}) {ref_where}), w AS (SELECT rid, {tokens_sql('r')} AS words FROM f), l AS (SELECT rid, len(words) AS dl, unnest(words) AS term FROM w),"
        " p AS (SELECT rid, dl, term, count(*) AS tf FROM l GROUP BY ALL), n AS (SELECT count(*) AS n FROM f), g AS (SELECT avg(dl) AS avgdl FROM (SELECT DISTINCT rid, dl FROM p)),"
        " df AS (SELECT term, count(*) AS df FROM p GROUP BY term), i AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, n),"
        f" q AS (SELECT sid, unnest(list_distinct({tokens_sql('s')})) AS term FROM s),"
        " m AS (SELECT sid, rid, sum(2.0 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN i USING (term) JOIN p USING (term), g GROUP BY sid, rid),"
        f" k AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY round(score, 9) DESC, rid) AS k FROM m {forbid})"
        " SELECT sid AS source_id, rid AS \"__ID_REF\", round(score, 6) AS \"__ES_SCORE\", CAST(3.5 AS DOUBLE) AS \"__THRESH\", round(score / 3.5, 6) AS \"__CONFIDENCE\", score / 3.5 >= 1 AS \"__IS_MATCH\" FROM k WHERE k = 1"
    )


_TEMPLATE = [link.Clause("must", "s", "r", "words", 2.0)]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("__ES_SCORE", F.round("__ES_SCORE", 6)).withColumn("__CONFIDENCE", F.round("__CONFIDENCE", 6))


@query("link_bm25_top1", _bm25_sql())
def link_bm25_top1(spark: SparkSession, d: str) -> DataFrame:
    s, r = _parts(spark, d)
    return _rounded(link.bm25_best(s, "sid", r, "rid", _TEMPLATE, 3.5))


def _as_text(sql: str) -> str:
    return f"SELECT 'S' || CAST(source_id AS VARCHAR) AS source_id, 'R' || lpad(CAST(\"__ID_REF\" AS VARCHAR), 9, '0') AS \"__ID_REF\", \"__ES_SCORE\", \"__THRESH\", \"__CONFIDENCE\", \"__IS_MATCH\" FROM ({sql})"


@query("link_text_ids", _as_text(_bm25_sql()))
def link_text_ids(spark: SparkSession, d: str) -> DataFrame:
    """link_bm25_top1 with ids that are text on both sides."""
    s, r = _parts(spark, d)
    s = s.withColumn("sid", F.concat(F.lit("S"), F.col("sid").cast("string")))
    r = r.withColumn("rid", F.concat(F.lit("R"), F.lpad(F.col("rid").cast("string"), 9, "0")))
    return _rounded(link.bm25_best(s, "sid", r, "rid", _TEMPLATE, 3.5))


@query("link_must_filters", _bm25_sql(f"WHERE list_contains({tokens_sql('r')}, 'small') AND NOT list_contains({tokens_sql('r')}, 'ring')"))
def link_must_filters(spark: SparkSession, d: str) -> DataFrame:
    s, r = _parts(spark, d)
    return _rounded(link.bm25_best(s, "sid", link.with_filters(r, {"r": ["small"]}, {"r": ["ring"]}), "rid", _TEMPLATE, 3.5))


_FIRST_BEST = _bm25_sql()
_FORBIDDEN = _bm25_sql("", "WHERE NOT EXISTS (SELECT 1 FROM no WHERE no.source_id = sid AND no.ref_id = rid)")


@query(
    "link_forced_pairs",
    f"WITH no AS (SELECT source_id, \"__ID_REF\" AS ref_id FROM ({_FIRST_BEST}) WHERE source_id % 10 = 0), base AS ({_FORBIDDEN}),"
    " x AS (SELECT CAST(p_partkey AS BIGINT) AS source_id, CAST(p_partkey + 1 AS BIGINT) AS ref_id FROM part WHERE p_partkey % 20 = 0)"
    " SELECT * FROM base WHERE source_id NOT IN (SELECT source_id FROM x) UNION ALL SELECT source_id, ref_id, NULL, 3.5, 999.0, true FROM x",
)
def link_forced_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The best matches of a tenth of the rows are told to be none, so their second best ones come; others are forced."""
    s, r = _parts(spark, d)
    forced = read(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("source_id"), (F.col("p_partkey") + 1).alias("ref_id"))
    index = stored(link.index_of(r, "rid", _TEMPLATE), "index")
    forbidden = link.bm25_best(s.where("sid % 10 = 0"), "sid", r, "rid", _TEMPLATE, 3.5, index=index).select("source_id", F.col("__ID_REF").alias("ref_id"))
    return _rounded(link.bm25_best(s, "sid", r, "rid", _TEMPLATE, 3.5, forced, forbidden, index))


_LINKED = "linked AS (SELECT CAST(o_orderkey AS BIGINT) AS sid, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE c_name END AS name__REF, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(c_custkey AS BIGINT) END AS \"__ID_REF\", CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS \"__ES_SCORE\", CAST(3.5 AS DOUBLE) AS \"__THRESH\", CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS DOUBLE) / 3.5 END AS \"__CONFIDENCE\", CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 7 >= 3.5 END AS \"__IS_MATCH\", lower(c_name) AS own FROM orders JOIN customer ON o_custkey = c_custkey)"


def _linked(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    has = F.col("o_orderkey") % 4 != 0
    score = (F.col("o_orderkey") % 7).cast("double")
    return o.select(F.col("o_orderkey").alias("sid"), F.when(has, F.col("c_name")).alias("name__REF"), F.when(has, F.col("c_custkey")).alias("__ID_REF"), F.when(has, score).alias("__ES_SCORE"), F.lit(3.5).alias("__THRESH"), F.when(has, score / 3.5).alias("__CONFIDENCE"), F.when(has, score >= 3.5).alias("__IS_MATCH"), F.lower("c_name").alias("own"))


@query(
    "link_label_update",
    f"WITH {_LINKED}, y AS (SELECT CAST(o_orderkey AS BIGINT) AS source_id, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS BIGINT) ELSE 1 END AS ref_id, o_orderkey % 2 = 1 AS is_match FROM orders WHERE o_orderkey % 5 IN (0, 1)),"
    " j AS (SELECT linked.*, y.ref_id, coalesce(y.is_match, false) AS taken, coalesce(NOT y.is_match AND y.ref_id = \"__ID_REF\", false) AS emptied, c_name FROM linked LEFT JOIN y ON sid = source_id LEFT JOIN customer ON y.is_match AND c_custkey = y.ref_id)"
    " SELECT sid, CASE WHEN emptied THEN NULL WHEN taken THEN c_name ELSE name__REF END AS name__REF, CASE WHEN emptied THEN NULL WHEN taken THEN ref_id ELSE \"__ID_REF\" END AS \"__ID_REF\", CASE WHEN emptied THEN NULL ELSE \"__ES_SCORE\" END AS \"__ES_SCORE\", CASE WHEN emptied THEN NULL ELSE \"__THRESH\" END AS \"__THRESH\","
    " CASE WHEN emptied THEN NULL WHEN taken THEN 999.0 ELSE \"__CONFIDENCE\" END AS \"__CONFIDENCE\", CASE WHEN emptied THEN false WHEN taken THEN true ELSE coalesce(\"__IS_MATCH\", false) END AS \"__IS_MATCH\", own FROM j",
)
def link_label_update(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    first = o.where("o_orderkey % 5 in (0, 1)").select(F.col("o_orderkey").alias("source_id"), F.lit(2).cast("long").alias("ref_id"), F.lit(True).alias("is_match"), F.lit(0).alias("seq"))
    last = o.where("o_orderkey % 5 in (0, 1)").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey")).otherwise(1).alias("ref_id"), (F.col("o_orderkey") % 2 == 1).alias("is_match"), F.lit(1).alias("seq"))
    refs = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return link.update_labels(_linked(spark, d), first.unionByName(last), "sid", refs, "c_custkey")


@query("link_metrics", f"WITH {_LINKED} SELECT count(*) AS n_rows, count(\"__CONFIDENCE\") AS num_match, avg(CASE WHEN \"__CONFIDENCE\" IS NULL THEN 0.0 ELSE 1.0 END) AS perc_match, count(*) FILTER (WHERE \"__CONFIDENCE\" >= 1) AS num_match_thresh_0, avg(CASE WHEN \"__CONFIDENCE\" >= 1 THEN 1.0 ELSE 0.0 END) AS perc_match_thresh_0, count(*) FILTER (WHERE \"__CONFIDENCE\" >= 1.5) AS num_match_thresh_1, avg(CASE WHEN \"__CONFIDENCE\" >= 1.5 THEN 1.0 ELSE 0.0 END) AS perc_match_thresh_1, count(*) FILTER (WHERE \"__CONFIDENCE\" >= 1 AND own IS NOT NULL AND name__REF IS NOT NULL) AS num_verif_samples, avg(CASE WHEN lower(own) = lower(name__REF) THEN 1.0 ELSE 0.0 END) FILTER (WHERE \"__CONFIDENCE\" >= 1 AND own IS NOT NULL AND name__REF IS NOT NULL) AS precision FROM linked")
def link_metrics(spark: SparkSession, d: str) -> DataFrame:
    return link.metrics(_linked(spark, d), "own", "name__REF", lower=True, thresholds=(1.0, 1.5))


@query("link_threshold_nullout", f"WITH {_LINKED}, k AS (SELECT *, coalesce(\"__CONFIDENCE\" >= 1.2, false) AS ok FROM linked) SELECT sid, own, CASE WHEN ok THEN name__REF END AS name__REF, CASE WHEN ok THEN \"__ID_REF\" END AS \"__ID_REF\", CASE WHEN ok THEN \"__ES_SCORE\" END AS \"__ES_SCORE\", CASE WHEN ok THEN \"__THRESH\" END AS \"__THRESH\", CASE WHEN ok THEN \"__CONFIDENCE\" END AS \"__CONFIDENCE\", coalesce(CASE WHEN ok THEN \"__IS_MATCH\" END, false) AS \"__IS_MATCH\" FROM k")
def link_threshold_nullout(spark: SparkSession, d: str) -> DataFrame:
    return link.null_below(_linked(spark, d), 1.2)


@query("link_majority_vote", "WITH v AS (SELECT CAST(l_orderkey AS BIGINT) AS source_id, CAST(l_suppkey AS BIGINT) AS ref_id FROM lineitem), n AS (SELECT source_id, ref_id, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, ref_id) AS k FROM n) SELECT source_id, ref_id, n FROM r WHERE k = 1")
def link_majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return link.majority(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("ref_id")))


@query("template_quality", "WITH f AS (SELECT o_orderkey AS s, o_custkey AS r FROM orders), t AS (SELECT o_orderkey AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1 END AS r FROM orders WHERE o_orderkey % 2 = 0), j AS (SELECT f.r = t.r AS ok FROM f JOIN t ON f.s = t.s) SELECT count(*) AS n_found, count(*) FILTER (WHERE ok) AS n_right, (SELECT count(*) FROM t) AS n_truth, CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS precision, CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / (SELECT count(*) FROM t) AS recall FROM j")
def template_quality(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    truth = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("ref_id"))
    return link.template_quality(o.select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("ref_id")), truth).withColumn("n_right", F.col("n_right").cast("long"))


@query("orphan_links", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def orphan_links(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order."""
    return joins.orphans(read(spark, d, "customer").select("c_custkey", "c_name"), read(spark, d, "orders"), "c_custkey", "o_custkey")


_GRID = (
    f"WITH s AS ({_PART_A}), f AS ({_PART_B}), a AS (SELECT sid, unnest(list_distinct({tokens_sql('s')})) AS token FROM s), b AS (SELECT rid, unnest(list_distinct({tokens_sql('r')})) AS token FROM f),"
    " n AS (SELECT token, count(*) AS n FROM a GROUP BY token), w AS (SELECT token, count(*) AS width FROM b GROUP BY token), k AS (SELECT sid, token, width, row_number() OVER (PARTITION BY sid ORDER BY n DESC, token) AS k FROM a JOIN n USING (token) LEFT JOIN w USING (token)),"
    " j AS (SELECT sid, rid, min(k) AS k FROM k JOIN b USING (token) WHERE k <= 8 GROUP BY sid, rid), t AS (SELECT sid, k, sum(count(*)) OVER (PARTITION BY sid ORDER BY k) AS total FROM j GROUP BY sid, k)"
    " SELECT j.sid AS source_id, j.rid AS ref_id FROM j JOIN t ON j.sid = t.sid AND j.k = t.k WHERE total <= 400"
)


@query("grid_candidates", _GRID)
def grid_candidates(spark: SparkSession, d: str) -> DataFrame:
    s, r = _parts(spark, d)
    return grid.candidates(s, "sid", tokens("s"), r, "rid", tokens("r"), max_candidates=400)


@query("grid_parent", "SELECT s_suppkey AS source_id, n_name AS grid_id, CASE WHEN s_suppkey % 2 = 0 THEN r_name END AS parent_grid FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey".replace("CASE WHEN s_suppkey % 2 = 0 THEN r_name END", "r_name"))
def grid_parent(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ref = n.select(F.col("n_name").alias("grid_id"), F.array("r_name").alias("parents"))
    matched = read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("source_id"), F.col("n_name").alias("grid_id"))
    return grid.parent_of(matched, ref).select("source_id", "grid_id", "parent_grid")


@query("grid_parent_fallback", "WITH m AS (SELECT s_suppkey AS sid, s_name AS l, 'Supplier#' || lpad(CAST(s_suppkey // 2 AS VARCHAR), 9, '0') AS p, CASE WHEN s_suppkey % 3 != 0 THEN 'g' || CAST(s_suppkey AS VARCHAR) END AS g FROM supplier) SELECT a.sid AS source_id, coalesce(a.g, b.g) AS grid_id, a.g IS NULL AND b.g IS NOT NULL AS via_parent FROM m a LEFT JOIN m b ON a.p = b.l AND b.g IS NOT NULL")
def grid_parent_fallback(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey", "s_name", F.concat(F.lit("Supplier#"), F.lpad(F.floor(F.col("s_suppkey") / 2).cast("string"), 9, "0")).alias("parent"))
    matched = s.where("s_suppkey % 3 != 0").select(F.col("s_suppkey").alias("source_id"), F.concat(F.lit("g"), F.col("s_suppkey").cast("string")).alias("grid_id"))
    return grid.parent_fallback(matched, s, "s_suppkey", "parent", "s_name")


@query("grid_gridded", "SELECT count(*) AS n, count(*) FILTER (WHERE s_suppkey % 3 != 0 OR s_suppkey % 2 = 0) AS n_gridded FROM supplier")
def grid_gridded(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return grid.gridded(read(spark, d, "supplier").select(F.when(k % 3 != 0, k).alias("grid_id"), F.when(k % 2 == 0, k).alias("parent_grid")))


@query("grid_best")
def grid_best(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers to institution items made of the same table: names written otherwise, scored and ranked. Candidates come
    from the whole table by the number in the name and the number without its last digit, which ten names share; words
    that all names share are too wide for candidates() and would end its search."""
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    empty = F.array().cast("array<string>")
    ref = s.select(F.concat(F.lit("grid."), F.col("s_suppkey").cast("string")).alias("grid_id"), F.concat(F.lit("University of "), F.replace("s_name", F.lit("#"), F.lit(" number "))).alias("label"), F.lit(None).cast("string").alias("city"), F.col("n_name").alias("country"))
    ref = ref.withColumn("variants", F.array("label", F.concat_ws(" ", "label", "country"))).withColumn("acros", empty).withColumn("urls", empty).withColumn("parents", empty)
    source = s.select("s_suppkey", F.concat(F.lit("Univ. "), F.replace("s_name", F.lit("#"), F.lit(" number "))).alias("label"), F.lit(None).cast("string").alias("city"), F.col("n_name").alias("country"))
    number = F.regexp_extract("label", "([0-9]+)", 1)
    words = F.array(number, F.expr("left(regexp_extract(label, '([0-9]+)', 1), length(regexp_extract(label, '([0-9]+)', 1)) - 1)"))
    pairs = grid.candidates(source, "s_suppkey", words, ref, "grid_id", words)
    return grid.best_items(source, "s_suppkey", ref, pairs).select("source_id", "grid_id", "score")
