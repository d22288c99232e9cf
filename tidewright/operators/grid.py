"""Institution matching: items with variants, token candidates, scores of names, countries and cities, parents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions import fuzz
from ..functions.text import acronym, bracketed_acronym, case_phrase, research_unit, tokens

# fixed values
MAX_TOKENS, MAX_CANDIDATES, MIN_STRING = 8, 32, 20
CATEGORIES = {  # parts of words that tell what an institution is
    "University": ("univ[a-z]*", "facult.", "campus", "departe?ment"), "School": ("scol[a-z]*", "school"),
    "Company": ("ltd", "inc", "sas", "gmbh", "sarl", "sa", "ab"),
    "Medical": ("medic[a-z]*", "hospi[a-z]*", "hopi.[a-z]*", "clini[a-z]*", "chu", "ch", "klinik", "service"),
    "Research": ("unite", "unit", "lab[a-z]*", "recherche", "umr", "ufr", "cnrs", "cea"), "Other": ("committee", "comite", "agence", "institute", "bureau"),
}
GENERIC = ("university", "universite", "institute", "institut", "school", "ecole", "centre", "center", "college", "hospital", "laboratory", "laboratoire", "research", "national", "department")
# end of fixed values


def items(grid: DataFrame, aliases: DataFrame, labels: DataFrame, acronyms: DataFrame, links: DataFrame, relations: DataFrame) -> DataFrame:
    """Reference items out of six tables: grid_id, label, city, country, variants, acros, urls, parents.

    Variants are the name, aliases and labels, each also with country, city and state. Nulls and repeats don't count.
    """
    def lists(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.groupBy("grid_id").agg(F.array_sort(F.collect_set(col)).alias(name))

    out = grid.select(F.col("ID").alias("grid_id"), F.col("Name").alias("label"), F.col("City").alias("city"), F.col("State").alias("state"), F.col("Country").alias("country"))
    parents = relations.where("lower(relationship_type) = 'parent'")
    for df, c, n in ((aliases, "alias", "aliases"), (labels, "label", "labels"), (acronyms, "acronym", "acros"), (links, "link", "urls"), (parents, "related_grid_id", "parents")):
        out = out.join(lists(df.withColumnRenamed("label", "label") if c == "label" else df, c, n), "grid_id", "left")
    empty = F.array().cast("array<string>")
    names = F.array_distinct(F.concat(F.array("label"), F.coalesce("aliases", empty), F.coalesce("labels", empty)))
    def full(name: Column) -> Column:
        return F.array(F.concat_ws(" ", name, "country"), F.concat_ws(" ", name, "city", "country"), F.concat_ws(" ", name, "city", "state", "country"))

    variants = F.array_distinct(F.concat(names, F.flatten(F.transform(names, full))))
    return out.select("grid_id", "label", "city", "country", variants.alias("variants"), *[F.coalesce(c, empty).alias(c) for c in ("acros", "urls", "parents")])


def categories(label: str) -> Column:
    """What the words of a label say an institution is: for each word the first category that a part of it belongs to."""
    def of(word: Column) -> Column:
        return F.coalesce(*[F.when(word.rlike("|".join(parts)), F.lit(name)) for name, parts in CATEGORIES.items()])

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(tokens(label), of))))


def domain(url: Column) -> Column:
    """The name in an address: what stands between its first two full stops, hyphens as spaces."""
    return F.nullif(F.trim(case_phrase(F.replace(F.regexp_extract(url, r"^[^.]*\.([^.]+)\.", 1), F.lit("-"), F.lit(" ")))), F.lit(""))


def enrich(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds acronym variants, a research unit's id and categories out of the label."""
    acros = F.array_compact(F.array(acronym(tokens(label)), bracketed_acronym(label)))
    return df.withColumn("acro", F.array_distinct(acros)).withColumn("ur_id", research_unit(label)).withColumn("categories", categories(label))


def with_country(source: DataFrame, source_id: str, countries: DataFrame, label: str = "label") -> DataFrame:
    """source with a country where it has none: the first word of the label that is the name of one. countries: (country)."""
    known = countries.where("country is not null").groupBy(F.trim(case_phrase("country")).alias("word")).agg(F.min("country").alias("_found"))
    words = source.select(F.col(source_id).alias("_id"), F.posexplode(tokens(label)).alias("at", "word")).join(known, "word")
    first = words.groupBy("_id").agg(F.min_by("_found", "at").alias("_found"))
    out = source.join(first, F.col(source_id) == F.col("_id"), "left")
    return out.withColumn("country", F.coalesce("country", "_found")).select(*dict.fromkeys([*source.columns, "country"]))


def token_counts(df: DataFrame, c: Column) -> DataFrame:
    """(token, n): rows of df with the token."""
    return df.select(F.explode(F.array_distinct(c)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def candidates(source: DataFrame, source_id: str, words: Column, ref: DataFrame, ref_id: str, ref_words: Column, max_tokens: int = MAX_TOKENS, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """(source_id, ref_id): reference rows that share one of the first max_tokens tokens of a source row.

    Tokens go in descending order of their number of source rows, ties by token, and each adds its reference rows;
    before the set would pass max_candidates it stops. Tokens with more reference rows than that can never be taken,
    so they leave before the join, which bounds what a hot token can produce.
    """
    freq = token_counts(source, words)
    posted = ref.select(F.col(ref_id).alias("ref_id"), F.explode(F.array_distinct(ref_words)).alias("token"))
    width = posted.groupBy("token").agg(F.count(F.lit(1)).alias("width"))
    asked = source.select(F.col(source_id).alias("source_id"), F.explode(F.array_distinct(words)).alias("token"))
    asked = asked.join(freq, "token").join(width, "token", "left")
    w = Window.partitionBy("source_id").orderBy(F.desc("n"), "token")
    asked = asked.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_tokens)
    # what comes behind a token that alone is too wide isn't reached
    before = Window.partitionBy("source_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.withColumn("too_wide", F.max((F.coalesce("width", F.lit(0)) > max_candidates).cast("int")).over(before)).where("too_wide = 0 and width is not null")
    met = asked.join(posted, "token").groupBy("source_id", "ref_id").agg(F.min("k").alias("k"))
    so_far = met.groupBy("source_id", "k").agg(F.count(F.lit(1)).alias("new"))
    total = F.sum("new").over(Window.partitionBy("source_id").orderBy("k"))
    reached = so_far.withColumn("total", total).where(F.col("total") <= max_candidates).select("source_id", "k")
    return met.join(reached, ["source_id", "k"]).select("source_id", "ref_id")


def char_score(a: str, b: str) -> float:
    if a and a == b:
        return 100.0
    r, p = fuzz.ratio(a, b), fuzz.partial_ratio(a, b)
    return 0.0 if r < 20 or p < 30 else r * p / 100


def proper(text: str) -> str:
    return " ".join(w for w in text.split() if len(w) > 2 and w not in GENERIC)


def words_score(a: str, b: str) -> float:
    s, t = fuzz.token_sort_ratio(a, b), fuzz.token_set_ratio(a, b)
    if s < 40 or t < 50:
        return 0.0
    x, y = proper(a), proper(b)
    if (x or y) and (fuzz.token_sort_ratio(x, y) < 80 or fuzz.token_set_ratio(x, y) < 60):
        return 0.0
    return s * t / 100


def translated(text: str, dictionary: dict[str, str]) -> str:
    return " ".join(dictionary.get(w, w) for w in text.split())


def string_score(a: str, b: str, dictionary: dict[str, str] | None = None) -> float:
    """The best of the scores by characters, by words and, with a dictionary (word to its main form), by translated words;
    60 and less count for nothing."""
    scores = [0.0]
    if 200 * min(len(a), len(b)) > 60 * (len(a) + len(b)):  # else no ratio of theirs is above 60
        scores += [char_score(a, b), words_score(a, b)]
    if dictionary:
        scores.append(words_score(translated(a, dictionary), translated(b, dictionary)))
    return best if (best := max(scores)) > 60 else 0.0


def best_string_score(dictionary: dict[str, str] | None = None):
    """A column function: the best score of the variants of two rows (arrays of normalized texts), and which they are."""
    @F.pandas_udf(StructType([StructField("score", DoubleType()), StructField("a", StringType()), StructField("b", StringType())]))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out, known = [], {}
        for p, q in zip(a, b, strict=True):
            best = (0.0, None, None)
            for x in p if p is not None else ():
                for y in q if q is not None else ():
                    if best[0] == 100:
                        break
                    if (x, y) not in known:
                        known[x, y] = string_score(x, y, dictionary)
                    if known[x, y] > best[0]:
                        best = (known[x, y], x, y)
            out.append(best)
        return pd.DataFrame(out, columns=["score", "a", "b"])

    return run


def place_score(a: Column, b: Column) -> Column:
    """50 where one is unknown, 100 where both are alike, else 0."""
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 50.0).when(fuzz.ratio_udf(F.lower(a), F.lower(b)) > 80, 100.0).otherwise(0.0)


def best_items(source: DataFrame, source_id: str, ref: DataFrame, pairs: DataFrame, dictionary: dict[str, str] | None = None) -> DataFrame:
    """(source_id, grid_id, score, reason): the best accepted candidate of each source row, of equal ones the greatest id.

    source: source_id, label, city, country; ref: as items(). Rows that both have categories share one. Names are
    compared in all variants; the same research unit, or the name in an address of the reference row, counts 100.
    Accepted are string scores of 20 or more whose product with those of country and city, over 10000, is a tenth or
    more. dictionary: words to their main form, for a comparison of translated words.
    """
    s = enrich(source).select(F.col(source_id).alias("source_id"), F.concat(F.array(F.trim(case_phrase("label"))), F.transform("acro", lambda x: F.lower(x))).alias("sv"), F.col("city").alias("s_city"), F.col("country").alias("s_country"), F.col("categories").alias("s_cat"), F.col("ur_id").alias("s_ur"))
    r = enrich(ref).select(F.col("grid_id").alias("ref_id"), F.transform(F.concat("variants", "acros"), lambda x: F.trim(case_phrase(x))).alias("rv"), "city", "country", "categories", "ur_id", F.array_compact(F.transform("urls", domain)).alias("domains"))
    m = pairs.join(s, "source_id").join(r, "ref_id").where("size(s_cat) = 0 or size(categories) = 0 or arrays_overlap(s_cat, categories)")
    m = m.withColumn("names", best_string_score(dictionary)("sv", "rv"))
    unit, address = F.coalesce(F.col("s_ur") == F.col("ur_id"), F.lit(False)), F.arrays_overlap("sv", "domains")
    m = m.withColumn("string", F.when(unit | F.coalesce(address, F.lit(False)), 100.0).otherwise(F.col("names.score"))).where(F.col("string") >= MIN_STRING)
    m = m.withColumn("in_country", place_score(F.col("s_country"), F.col("country"))).withColumn("in_city", place_score(F.col("s_city"), F.col("city")))
    m = m.withColumn("score", F.col("string") * F.col("in_country") * F.col("in_city") / 10000).where(F.col("score") >= MIN_STRING * 50 / 100)
    said = F.when(F.col("names.score") >= F.col("string"), F.concat(F.lit('Matching variants "'), F.col("names.a"), F.lit('" / "'), F.col("names.b"), F.lit('"')))
    said = said.when(unit, F.concat(F.lit("Matching research unit IDs "), F.col("ur_id"))).otherwise(F.lit("Matching URL"))
    reason = F.concat_ws(" + ", said, F.when(F.col("in_country") == 100, F.concat(F.lit("Matching countries "), F.col("s_country"), F.lit(" / "), F.col("country"))), F.when(F.col("in_city") == 100, F.concat(F.lit("Matching cities "), F.col("s_city"), F.lit(" / "), F.col("city"))))
    best = m.withColumn("reason", reason).groupBy("source_id").agg(F.max_by(F.struct("ref_id", "score", "reason"), F.struct("score", "ref_id")).alias("b"))
    return best.select("source_id", F.col("b.ref_id").alias("grid_id"), F.col("b.score").alias("score"), F.col("b.reason").alias("reason"))


def parent_fallback(matched: DataFrame, source: DataFrame, source_id: str, parent_label: str, label: str) -> DataFrame:
    """Unmatched rows take the match of the row whose label their parent label names: source_id, grid_id, via_parent."""
    ids = source.select(F.col(source_id).alias("source_id"), F.col(parent_label).alias("_p"), F.col(label).alias("_l"))
    own = ids.join(matched.select("source_id", "grid_id"), "source_id", "left")
    of_label = own.where("grid_id is not null").groupBy("_l").agg(F.min("grid_id").alias("_pg"))
    out = own.join(of_label.withColumnRenamed("_l", "_pl"), F.col("_p") == F.col("_pl"), "left")
    return out.select("source_id", F.coalesce("grid_id", "_pg").alias("grid_id"), (F.col("grid_id").isNull() & F.col("_pg").isNotNull()).alias("via_parent"))


def parent_of(matched: DataFrame, ref: DataFrame) -> DataFrame:
    """Adds parent_grid: the first parent of the matched item."""
    return matched.join(ref.select("grid_id", F.expr("get(parents, 0)").alias("parent_grid")), "grid_id", "left")


def gridded(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grid_id").isNotNull() | F.col("parent_grid").isNotNull()).alias("n_gridded"))


def output(matched: DataFrame, ref: DataFrame) -> DataFrame:
    """city, country and grid_label of the matched item, or else of its parent."""
    own = ref.select(F.col("grid_id"), F.col("label").alias("_l"), F.col("city").alias("_c"), F.col("country").alias("_k"))
    up = ref.select(F.col("grid_id").alias("parent_grid"), F.col("label").alias("_pl"), F.col("city").alias("_pc"), F.col("country").alias("_pk"))
    j = matched.join(own, "grid_id", "left").join(up, "parent_grid", "left")
    return j.select("source_id", "grid_id", "parent_grid", F.coalesce("_c", "_pc").alias("city"), F.coalesce("_k", "_pk").alias("country"), F.coalesce("_l", "_pl").alias("grid_label"))
