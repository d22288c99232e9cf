"""Queries for type inference, phrase and variant matching, recoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import case_phrase, fast_similarity, tokens
from ..operators import column_types as ct
from ..operators import joins, names, recode
from .q_text import case_sql, tokens_sql
from .registry import query

_LEX = "lex AS (SELECT 'Région' AS type, r_name AS label FROM region UNION ALL SELECT 'Pays', n_name FROM nation UNION ALL SELECT 'Segment', c_mktsegment FROM customer UNION ALL SELECT 'Segment', 'AUTOMOBILE')"
_KEYS = f"keys AS (SELECT DISTINCT type, {case_sql('label')} AS key, label FROM lex WHERE {case_sql('label')} != '')"
_CELLS = (
    "cells AS (SELECT CAST(c_custkey AS BIGINT) AS row_id, 'segment' AS col, coalesce(c_mktsegment, '') AS value FROM customer"
    " UNION ALL SELECT CAST(c_custkey AS BIGINT), 'nation', coalesce(n_name, '') FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"
    " UNION ALL SELECT CAST(c_custkey AS BIGINT), 'name', coalesce(c_name, '') FROM customer)"
)
_HITS = f"hits AS (SELECT DISTINCT row_id, col, type || '#label' AS matcher, type, label AS hit FROM cells JOIN keys ON {case_sql('value')} = key)"
_WITH = f"WITH {_LEX}, {_KEYS}, {_CELLS}, {_HITS}"


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    r = lambda t, c, k: spark.read.parquet(f"{d}/{t}.parquet").select(F.lit(k).alias("type"), F.col(c).alias("label"))
    return r("region", "r_name", "Région").unionByName(r("nation", "n_name", "Pays")).unionByName(r("customer", "c_mktsegment", "Segment")).unionByName(spark.sql("SELECT 'Segment' AS type, 'AUTOMOBILE' AS label"))


def people(spark: SparkSession, d: str) -> DataFrame:
    c, n = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"], "left").select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("c_name").alias("name"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return ct.cells_of(people(spark, d), ["segment", "nation", "name"])


def hits(spark: SparkSession, d: str) -> DataFrame:
    return ct.label_hits(cells(spark, d), ct.lexicon_table(lexicon(spark, d)))


@query("type_lexicon_exact", f"{_WITH} SELECT row_id, col, matcher, type, hit FROM hits")
def type_lexicon_exact(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("row_id", "col", "matcher", "type", "hit")


@query("type_diversity", f"{_WITH}, n AS (SELECT matcher, col, count(DISTINCT hit) AS n FROM hits GROUP BY matcher, col) SELECT h.row_id, h.col, h.type, h.hit FROM hits h JOIN n ON h.matcher = n.matcher AND h.col = n.col WHERE n.n >= CASE WHEN h.matcher = 'Pays#label' THEN 6 ELSE 1 END")
def type_diversity(spark: SparkSession, d: str) -> DataFrame:
    return ct.posited(hits(spark, d), {"Pays#label": 6}).select("row_id", "col", "type", "hit")


_SCORES = "scores AS (SELECT h.col, h.type, 100.0 * CAST(count(DISTINCT h.row_id) AS DOUBLE) / min(c.n) AS score FROM hits h JOIN (SELECT col, count(*) AS n FROM cells GROUP BY col) c ON h.col = c.col GROUP BY h.col, h.type)"


@query("type_column_scores", f"{_WITH}, {_SCORES} SELECT * FROM scores WHERE score >= 10")
def type_column_scores(spark: SparkSession, d: str) -> DataFrame:
    return ct.column_scores(cells(spark, d), hits(spark, d))


@query("type_decision", f"{_WITH}, {_SCORES}, best AS (SELECT col, arg_max(type, score) AS type FROM scores WHERE score >= 10 GROUP BY col) SELECT col, type FROM best")
def type_decision(spark: SparkSession, d: str) -> DataFrame:
    found = ct.infer(people(spark, d), ["segment", "nation", "name"], lexicon=lexicon(spark, d), sample_rows=None)["column_types"]
    return spark.createDataFrame(sorted(found.items()), "col string, type string")


@query(
    "type_bailout",
    f"{_WITH}, kinds AS (SELECT DISTINCT col, matcher FROM hits), e AS (SELECT c.row_id, c.col, k.matcher, h.hit IS NOT NULL AS ok FROM cells c JOIN kinds k ON c.col = k.col LEFT JOIN hits h ON h.row_id = c.row_id AND h.col = c.col AND h.matcher = k.matcher),"
    " f AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY matcher, col ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM e) SELECT row_id, col, matcher FROM f WHERE ok AND failed <= 5",
)
def type_bailout(spark: SparkSession, d: str) -> DataFrame:
    return ct.bail_out(cells(spark, d), hits(spark, d)).select("row_id", "col", "matcher")


_EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}')".replace("d'", "d''") for p, x in ct.PARENTS.items() for c in x) + ") AS v(parent, child))"


@query("type_parents", f"{_WITH}, {_SCORES}, {_EDGES}, s AS (SELECT * FROM scores WHERE score >= 10), u AS (SELECT * FROM s UNION ALL SELECT col, parent, max(score) FROM s JOIN edges ON type = child GROUP BY col, parent) SELECT col, type, max(score) AS score FROM u GROUP BY col, type")
def type_parents(spark: SparkSession, d: str) -> DataFrame:
    return ct.roll_up(type_column_scores(spark, d), ct.hierarchy_table(spark))


@query("type_hierarchy", f"WITH {_EDGES} SELECT parent, child FROM edges")
def type_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return ct.hierarchy_table(spark)


@query("type_year_share", "SELECT 'date' AS col, 'Année' AS type, 100.0 * CAST(count(*) FILTER (WHERE regexp_matches(v, '^(19|20)[0-9]{2}\\b')) AS DOUBLE) / count(*) AS score FROM (SELECT strftime(l_shipdate, '%Y') AS v FROM lineitem)")
def type_year_share(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.date_format("l_shipdate", "yyyy").alias("date"))
    c = ct.cells_of(rows.withColumn("row_id", F.monotonically_increasing_id()), ["date"])
    return ct.column_scores(c, ct.posited(ct.expression_hits(c, [m for m in ct.matchers(0) if m.type == "Année"])))


@query("type_zip", "SELECT CAST(o_orderkey AS BIGINT) AS row_id, 'zip' AS col, v AS hit FROM (SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS v FROM orders)")
def type_zip(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), F.lpad(F.col("o_custkey").cast("string"), 5, "0").alias("zip"))
    return ct.expression_hits(ct.cells_of(rows, ["zip"]), [m for m in ct.matchers(0) if m.type == "Code Postal"]).select("row_id", "col", "hit")


_PHRASES = f"phrases AS (SELECT DISTINCT array_to_string({tokens_sql('p_name')}, ' ') AS phrase, 'part' AS type FROM part WHERE len({tokens_sql('p_name')}) > 0 UNION ALL SELECT DISTINCT p_type, 'ptype' FROM (SELECT lower(p_type) AS p_type FROM part))"


def phrases(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    one = part.select(F.array_join(tokens("p_name"), " ").alias("phrase"), F.lit("part").alias("type")).where("phrase != ''").distinct()
    return one.unionByName(part.select(F.lower("p_type").alias("phrase"), F.lit("ptype").alias("type")).distinct())


@query(
    "type_phrase_windows",
    f"WITH {_PHRASES}, w AS (SELECT p_partkey, {tokens_sql('p_name')} AS words FROM part), k AS (SELECT p_partkey, words, unnest(range(1, 4)) AS k FROM w), x AS (SELECT p_partkey, words, k, unnest(range(0, greatest(len(words) - k + 1, 0))) AS pos FROM k),"
    " y AS (SELECT p_partkey, k, pos, array_to_string(list_slice(words, pos + 1, pos + k), ' ') AS phrase FROM x), z AS (SELECT y.*, type, row_number() OVER (PARTITION BY p_partkey, type ORDER BY k DESC, pos, y.phrase) AS n FROM y JOIN phrases p ON y.phrase = p.phrase)"
    " SELECT p_partkey, type, phrase, CAST(k AS INTEGER) AS k, CAST(pos AS INTEGER) AS pos FROM z WHERE n = 1",
)
def type_phrase_windows(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    return joins.phrase_windows(part, tokens("p_name"), phrases(spark, d), 3).select("p_partkey", "type", "phrase", "k", "pos")


_VARIANTS = (("red", "colour"), ("blue", "colour"), ("small", "size"), ("small ring", "ring"), ("hot gear", "gear"), ("bolt", "part"), ("widget", "part"))
_VSQL = ", ".join(f"('{v}', '{m}')" for v, m in _VARIANTS)


@query(
    "variant_expand",
    f"WITH v AS (SELECT * FROM (VALUES {_VSQL}) AS t(variant, main)), w AS (SELECT p_partkey, {tokens_sql('p_name')} AS words FROM part), k AS (SELECT p_partkey, words, unnest(range(1, 3)) AS k FROM w), x AS (SELECT p_partkey, words, k, unnest(range(0, greatest(len(words) - k + 1, 0))) AS pos FROM k)"
    " SELECT DISTINCT p_partkey, v.variant, v.main, (pos = 0 AND k = len(words)) AS \"full\" FROM x JOIN v ON array_to_string(list_slice(words, pos + 1, pos + k), ' ') = v.variant",
)
def variant_expand(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    out = joins.expand_variants(n, tokens("p_name"), spark.createDataFrame(list(_VARIANTS), "variant string, main string"), 2)
    return out.select("p_partkey", "variant", "main", "full")


_HEADERS = (("Email", "email"), ("Email", "courriel"), ("Téléphone", "telephone"), ("Date", "orderdate"), ("Montant", "total price"), ("Etat", "order status"))
_COLUMNS = ("orderdates", "totalprice", "orderstatus", "emails", "telefone", "comment")
_HV, _HC = ", ".join(f"('{t}', '{x}')" for t, x in _HEADERS), ", ".join(f"('{c}')" for c in _COLUMNS)
_SIM = "CASE WHEN d = 0 THEN 100 WHEN d = 1 AND n > 8 THEN 50 WHEN d = 2 AND n > 8 THEN 20 WHEN d = 1 AND n > 4 THEN 20 WHEN d = 2 AND n > 4 THEN 10 WHEN d = 1 THEN 5 ELSE 0 END"


@query("header_match", f"WITH a AS (SELECT header, type, levenshtein(header, label) AS d, length(label) AS n FROM (VALUES {_HC}) AS c(header), (VALUES {_HV}) AS l(type, label)), b AS (SELECT header, type, {_SIM} AS s FROM a WHERE d <= 2), r AS (SELECT header, type, CAST(s AS DOUBLE) AS score, row_number() OVER (PARTITION BY header ORDER BY s DESC, type) AS k FROM b WHERE s > 0) SELECT header, type, score FROM r WHERE k = 1")
def header_match(spark: SparkSession, d: str) -> DataFrame:
    return ct.header_types(list(_COLUMNS), spark.createDataFrame(list(_HEADERS), "type string, label string"))


@query("edit_join2", "WITH p AS (SELECT DISTINCT p_name AS a FROM part), s AS (SELECT DISTINCT p_type AS b FROM part UNION SELECT DISTINCT p_name FROM part) SELECT a, b, levenshtein(a, b) AS distance FROM p, s WHERE abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= 2")
def edit_join2(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    b = part.select(F.col("p_type").alias("b")).unionByName(part.select(F.col("p_name").alias("b")))
    return joins.edit_join(part.select(F.col("p_name").alias("a")), b, "a", "b").withColumn("distance", F.col("distance").cast("long"))


@query("edit_score", f"WITH p AS (SELECT DISTINCT n_name AS a FROM nation), r AS (SELECT DISTINCT n_name AS b FROM nation UNION SELECT DISTINCT r_name FROM region), e AS (SELECT a, b, levenshtein(a, b) AS d, length(b) AS n FROM p, r) SELECT a, b, {_SIM} AS score FROM e WHERE d <= 2")
def edit_score(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("a"))
    b = n.select(F.col("a").alias("b")).unionByName(spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("b")))
    return joins.edit_join(n, b, "a", "b").select("a", "b", fast_similarity("distance", F.length("b")).alias("score"))


_RECODED = f"{_WITH}, r AS (SELECT row_id, col, array_to_string(list_slice(list_sort(list(DISTINCT hit)), 1, 3), ', ') AS value FROM hits WHERE (col = 'segment' AND type = 'Segment') OR (col = 'nation' AND type = 'Pays') GROUP BY row_id, col)"
_TYPES = {"segment": "Segment", "nation": "Pays"}


@query("recode_long", f"{_RECODED} SELECT row_id, col, value FROM r")
def recode_long(spark: SparkSession, d: str) -> DataFrame:
    return recode.normal_values(people(spark, d), _TYPES, lexicon=lexicon(spark, d))


@query(
    "recode_column",
    f"{_RECODED}, p AS (SELECT CAST(c_custkey AS BIGINT) AS row_id, lower(c_mktsegment) AS seg, n_name AS nat FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"
    " SELECT p.row_id, coalesce(a.value, p.seg) AS segment, coalesce(a.value, p.seg) IS DISTINCT FROM p.seg AS segment__MODIFIED, coalesce(b.value, p.nat) AS nation, coalesce(b.value, p.nat) IS DISTINCT FROM p.nat AS nation__MODIFIED"
    " FROM p LEFT JOIN r a ON a.row_id = p.row_id AND a.col = 'segment' LEFT JOIN r b ON b.row_id = p.row_id AND b.col = 'nation'",
)
def recode_column(spark: SparkSession, d: str) -> DataFrame:
    lower = people(spark, d).select("row_id", F.lower("segment").alias("segment"), "nation")
    return recode.recode(lower, _TYPES, lexicon=lexicon(spark, d))


@query("concat_with_init", "SELECT p_partkey AS row_id, p_name, upper(p_name) AS p_name__NORMALIZED, false AS p_name__MODIFIED, p_brand, lower(p_brand) AS p_brand__NORMALIZED FROM part")
def concat_with_init(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("row_id"), "p_name", "p_brand")
    changed = part.select("row_id", F.upper("p_name").alias("p_name"), F.lit(False).alias("p_name__MODIFIED"), F.lower("p_brand").alias("p_brand"))
    return joins.zip_rows(part, changed)


@query("names_parse")
def names_parse(spark: SparkSession, d: str) -> DataFrame:
    """Names in several writings for each customer, to the persons they name."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("Dupont"), F.col("c_custkey").cast("string"), F.lit(", Jean; Dr Marie CURIE et A. Martin")).alias("raw"))
    return c.select("c_custkey", F.inline(names.parse_names("raw")))


@query("fuzz_ratios")
def fuzz_ratios(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import fuzz

    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", case_phrase("p_type").alias("t"))
    return p.select("p_partkey", *[f("p_name", "t").alias(n) for n, f in (("ratio", fuzz.ratio_udf), ("partial", fuzz.partial_ratio_udf), ("token_sort", fuzz.token_sort_udf), ("token_set", fuzz.token_set_udf))])


_MIXED = (
    "mixed AS (SELECT CAST(c_custkey AS BIGINT) AS row_id, n_name AS nation, 'FRANCE' AS home, 'c' || CAST(c_custkey AS VARCHAR) || '@mail.org' AS contact,"
    " 'seen in ' || lower(n_name) || ' again' AS note, CASE WHEN c_custkey % 2 = 0 THEN 'Jean Martin' ELSE 'Dr Marie CURIE' END AS person FROM customer JOIN nation ON c_nationkey = n_nationkey)"
)


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a nation, a constant nation, an address, a nation amid words and a person's name."""
    c = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").cast("long").alias("row_id"), F.col("n_name").alias("nation"), F.lit("FRANCE").alias("home"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@mail.org")).alias("contact"),
        F.concat(F.lit("seen in "), F.lower("n_name"), F.lit(" again")).alias("note"), F.when(F.col("c_custkey") % 2 == 0, "Jean Martin").otherwise("Dr Marie CURIE").alias("person"),
    )


def nations(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").select(F.lit("Pays").alias("type"), F.col("n_name").alias("label"))


@query(
    "type_min_diversity",
    f"WITH {_MIXED}, cells AS (SELECT row_id, 'nation' AS col, nation AS value FROM mixed UNION ALL SELECT row_id, 'home', home FROM mixed), k AS (SELECT DISTINCT {case_sql('n_name')} AS key FROM nation),"
    f" h AS (SELECT col, value FROM cells JOIN k ON {case_sql('value')} = key), n AS (SELECT col, count(*) AS n, count(DISTINCT value) AS d FROM h GROUP BY col)"
    " SELECT col, 'Pays' AS type, 100.0 * n / (SELECT count(*) FROM mixed) AS score FROM n WHERE d >= (SELECT ln(count(*)) / ln(1.8) FROM k)",
)
def type_min_diversity(spark: SparkSession, d: str) -> DataFrame:
    """A column of one label only is not of the label's type."""
    lex = ct.lexicon_table(nations(spark, d))
    found = ct.cells_of(mixed(spark, d), ["nation", "home"])
    return ct.column_scores(found, ct.posited(ct.label_hits(found, lex), ct.lexicon_diversity(lex, "label")))


@query(
    "type_infer_levels",
    f"WITH {_MIXED}, n AS (SELECT count(*) AS n FROM mixed), l AS (SELECT unnest([0, 1, 2]) AS level), s AS ("
    " SELECT 'nation' AS col, 'Pays' AS type, 0 AS least, count(*) FILTER (WHERE nation IN (SELECT n_name FROM nation)) AS k FROM mixed"
    " UNION ALL SELECT 'contact', 'Email', 0, count(*) FILTER (WHERE regexp_matches(contact, '^[a-z0-9]+@mail[.]org$')) FROM mixed"
    " UNION ALL SELECT 'note', 'Pays', 1, count(*) FILTER (WHERE regexp_extract(note, '^seen in (.*) again$', 1) IN (SELECT lower(n_name) FROM nation)) FROM mixed"
    " UNION ALL SELECT 'person', 'Nom de personne', 2, count(*) FILTER (WHERE person IN ('Jean Martin', 'Dr Marie CURIE')) FROM mixed)"
    " SELECT level, col, type, 100.0 * k / n AS score FROM l JOIN s ON least <= level, n",
)
def type_infer_levels(spark: SparkSession, d: str) -> DataFrame:
    """What the matchers of each cost level find."""
    found = ct.cells_of(mixed(spark, d), ["nation", "home", "contact", "note", "person"])
    resources = ct.Resources(labels=nations(spark, d), phrases=nations(spark, d))
    out = None
    for level in range(3):
        here = ct.column_scores(found, ct.posited(*ct.all_hits(found, level, resources))).select(F.lit(level).alias("level"), "col", "type", "score")
        out = here if out is None else out.unionByName(here)
    return out


_TAG_ROWS = ", ".join(f"('{t}', '{w}')" for t, words in sorted(ct.type_tags().items()) for w in words).replace("d'", "d''")


@query("type_tags", f"SELECT * FROM (VALUES {_TAG_ROWS}) AS v(type, tag)")
def type_tags(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, w) for t, words in ct.type_tags().items() for w in words], "type string, tag string")
