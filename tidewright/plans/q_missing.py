"""Queries for missing values: columns of the tables beside small columns with known candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import missing
from .registry import query

#: Small columns, each for one rule.
CASES = {
    "case_len_ratio": ["City name 1", "Another city name", "NA", "NA", "City names are long"],
    "case_letters": ["972", "973", "91", "91", "93", "000"],
    "case_letters_none": ["972", "973", "91", "91", "93", "000", "111"],
    "case_punctuation": ["972", "973", "91", "91", "-", "-"],
    "case_punctuation_none": ["972", "973", "91", "91", "93", "-", "."],
    "case_not_digit": ["4000", "0005", "6000", "91", "dontknow"],
    "case_not_digit_none": ["972", "973", "91", "91", "dontknow", "anumber", "someword"],
    "case_len_diff": ["0000", "0001", "0002", "0003", "1011", "00000"],
    "case_usual": ["some", "kind", "of data", "text", "has", "nan"],
    "case_usual_twice": ["other", "words", "of data", "here", "nan"],
    "case_usual_none": ["none of", "them", "are", "bad", "in", "this example"],
    "case_empty": ["a1", "b22", "", "", "c333"],
}
_VALUES = ", ".join(f"('{c}', '{v}')" for c, vs in CASES.items() for v in vs)
TABLES = (("events", "event_type"), ("orders", "o_orderpriority"), ("orders", "o_orderstatus"), ("documents", "lang"), ("documents", "source"), ("conversations", "role"), ("customer", "c_mktsegment"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    out = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS v(col, val)")
    for t, c in TABLES:
        out = out.unionByName(spark.read.parquet(f"{d}/{t}.parquet").select(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")))
    return out


_CELLS = f"cells AS (SELECT * FROM (VALUES {_VALUES}) AS v(col, val)" + "".join(f" UNION ALL SELECT '{c}', {c} FROM {t}" for t, c in TABLES) + ")"
_TOP = (
    f"WITH {_CELLS}, counted AS (SELECT col, val, count(*) AS n FROM cells WHERE val IS NOT NULL GROUP BY col, val),"
    " ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, val) AS rank, sum(n) OVER (PARTITION BY col) AS total FROM counted),"
    " top AS (SELECT col, val, n, n / total AS share, rank FROM ranked WHERE rank <= 10)"
)
_FLAGS = (
    _TOP + ", g AS (SELECT *, length(val) AS len, CASE WHEN val = '' THEN 0 ELSE len(list_distinct(string_split(val, ''))) END AS chars,"
    " regexp_full_match(translate(val, ',.', ''), '[0-9]+') AS digits, regexp_full_match(val, '[!-/:-@\\[-`{-~ ]*') AS punct,"
    " count(*) OVER (PARTITION BY col) AS n_vals, max(share) OVER (PARTITION BY col) AS top_share FROM top),"
    " h AS (SELECT *, count(*) OVER (PARTITION BY col, len) AS same_len FROM g WHERE top_share < 1),"
    " l AS (SELECT col, count(DISTINCT len) AS n_lens, min(same_len) AS least_same, sum(CASE WHEN digits THEN 0 ELSE 1 END) AS n_words, sum(CASE WHEN punct THEN 1 ELSE 0 END) AS n_punct FROM h GROUP BY col),"
    " f AS (SELECT h.*, n_lens, least_same, n_words, n_punct, row_number() OVER (PARTITION BY h.col ORDER BY len, val) AS by_len, lead(len) OVER (PARTITION BY h.col ORDER BY len, val) AS next_len,"
    " row_number() OVER (PARTITION BY h.col ORDER BY chars, val) AS by_chars, lead(chars) OVER (PARTITION BY h.col ORDER BY chars, val) AS next_chars FROM h JOIN l ON h.col = l.col)"
)
_RULES = {
    "diff": "n_vals >= 4 AND n_lens = 2 AND least_same = 1 AND same_len = 1",
    "len_ratio": "n_vals >= 4 AND by_len = 1 AND 2.9 * len < next_len",
    "not_digit": "n_vals >= 3 AND n_words = 1 AND NOT digits AND regexp_full_match(val, '\\pL+')",
    "punctuation": "n_punct = 1 AND punct",
    "usual": "lower(val) IN ('nan', 'none', 'na', 'n/a', '\\n', ' ', 'non renseigne', 'nr', 'no value', 'null', 'missing value')",
    "always": "val = ''",
    "letter_repeted": "n_vals >= 3 AND by_chars = 1 AND len > 1 AND chars = 1 AND next_chars >= 2",
}
_SCORES = {"diff": "0.3", "len_ratio": "0.2", "not_digit": "CASE WHEN n_vals >= 4 THEN 1.0 ELSE 0.5 END", "punctuation": "1.0", "usual": "0.5", "always": "1000.0", "letter_repeted": "0.7"}


def _rule_sql(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT col, val, CAST({_SCORES[n]} AS DOUBLE) AS score, '{'usual' if n == 'always' else n}' AS origin FROM f WHERE {_RULES[n]}" for n in names)


_SCORED = f"{_FLAGS}, r AS ({_rule_sql(*_RULES)}), s AS (SELECT col, val, sum(score) AS score, string_agg(origin, ',' ORDER BY origin) AS origin FROM r GROUP BY col, val)"


@query("mv_top_values", f"{_TOP} SELECT * FROM top")
def mv_top_values(spark: SparkSession, d: str) -> DataFrame:
    return missing.top_of(cells(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def _rule_query(name: str, *origins: str) -> None:
    @query(name, f"{_FLAGS} SELECT * FROM ({_rule_sql(*origins)})")
    def run(spark: SparkSession, d: str) -> DataFrame:
        kept = missing.rules(missing.top_of(cells(spark, d)))
        wanted = F.col("origin").isin(*["usual" if o == "always" else o for o in origins])
        return kept.where(wanted)


for _name, _origins in (("mv_len_diff", ("diff",)), ("mv_len_ratio", ("len_ratio",)), ("mv_not_digit", ("not_digit",)), ("mv_punctuation", ("punctuation",)), ("mv_usual_forms", ("usual", "always")), ("mv_letter_repetition", ("letter_repeted",))):
    _rule_query(_name, *_origins)


#: Forms of missing values that a user names, in any case.
USER_FORMS = ("P", "4-Not Specified", "BuIlDiNg")


@query("mv_usual_user", f"{_FLAGS} SELECT col, val, CAST(0.5 AS DOUBLE) AS score FROM f WHERE {_RULES['usual'][:-1]}, " + ", ".join(f"'{x.lower()}'" for x in USER_FORMS) + ")")
def mv_usual_user(spark: SparkSession, d: str) -> DataFrame:
    found = missing.rules(missing.top_of(cells(spark, d)), usual=USER_FORMS)
    return found.where("origin = 'usual' and score = 0.5").select("col", "val", "score")


@query("mv_scored", f"{_SCORED} SELECT * FROM s")
def mv_scored(spark: SparkSession, d: str) -> DataFrame:
    return missing.scored(missing.rules(missing.top_of(cells(spark, d))))


@query("mv_common_columns", f"{_SCORED} SELECT val, CAST(1.0 AS DOUBLE) AS score, count(DISTINCT col) AS n_cols FROM s GROUP BY val HAVING count(DISTINCT col) >= 2")
def mv_common_columns(spark: SparkSession, d: str) -> DataFrame:
    return missing.common(mv_scored(spark, d))


@query("mv_top_in_several", f"{_TOP} SELECT val, count(DISTINCT col) AS n_cols FROM top GROUP BY val HAVING count(DISTINCT col) >= 2")
def mv_top_in_several(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.joins import co_occurring

    return co_occurring(missing.top_of(cells(spark, d)))


PARAMS = {"mvs_dict": {"all": [{"val": "O", "score": 1.0}], "columns": {"o_orderpriority": [{"val": "5-LOW", "score": 0.7}, {"val": "2-HIGH", "score": 0.5}]}}, "thresh": 0.6}
_REPLACED = (
    "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('O', '5-LOW') THEN NULL ELSE o_orderpriority END AS o_orderpriority, coalesce(o_orderpriority IN ('O', '5-LOW'), false) AS o_orderpriority__MODIFIED,"
    " CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS o_orderstatus, coalesce(o_orderstatus = 'O', false) AS o_orderstatus__MODIFIED FROM orders"
)


def _replaced(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return missing.replace(orders, PARAMS).drop("o_orderkey__MODIFIED")


@query("mv_replace", f"SELECT o_orderkey, o_orderpriority, o_orderstatus FROM ({_REPLACED})")
def mv_replace(spark: SparkSession, d: str) -> DataFrame:
    return _replaced(spark, d).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("mv_replace_flags", _REPLACED)
def mv_replace_flags(spark: SparkSession, d: str) -> DataFrame:
    return _replaced(spark, d)


@query("mod_counts", f"WITH r AS ({_REPLACED}) SELECT 'o_orderpriority' AS col, count(*) FILTER (WHERE o_orderpriority__MODIFIED) AS n_modified FROM r UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus__MODIFIED) FROM r")
def mod_counts(spark: SparkSession, d: str) -> DataFrame:
    return missing.modified_counts(_replaced(spark, d))


_VALUES_OF = (("event_type", "click"), ("event_type", "view"))
_RUN_SQL = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS col, '{v}' AS val, event_id AS row_id FROM (SELECT event_id, coalesce({c} = '{v}', false) AS is_v, lag(coalesce({c} = '{v}', false)) OVER (ORDER BY event_id) AS was FROM events) WHERE (was IS NULL OR is_v != was) AND is_v ORDER BY event_id LIMIT 4)"
    for c, v in _VALUES_OF
)


@query("mv_run_sample", _RUN_SQL)
def mv_run_sample(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    return missing.run_sample(events, {"event_type": [v for _, v in _VALUES_OF]}, "event_id")
