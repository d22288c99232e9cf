"""Semantic column types: all matchers in one pass over the unpivoted cells, then a decision for each column."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.fuzz import address_udf
from ..functions.text import case_phrase, cover_score, fast_similarity, inner_acronyms, to_ascii, tokens
from . import grid
from .joins import dictionary_join, edit_join, expand_variants, phrase_windows
from .names import parser as person_parser

# fixed values
MAX_FATAL, MAX_ERROR_RATE, ERROR_RATE_FROM, SUBTYPING_RATIO, MIN_SHARE = 5, 20, 100, 2.0, 10.0
#: A lexicon's least number of distinct hits is the logarithm of its size to these bases.
LABEL_BASE, PHRASE_BASE = 1.8, 1.5
SAMPLE_ROWS, CHUNK_ROWS = 3000, 3000
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"https?://[^\s<>\"]+"
#: Parents of types: the subtypes of each.
PARENTS = {
    "Nom de personne": ("Titre", "Prénom"),
    "Date": ("Année",),
    "Type structuré": ("Date", "URL", "Email", "Téléphone"),
    "Institution de recherche": ("Structure de recherche", "Partenaire de recherche", "Collaborateur d'essai clinique"),
    "Etablissement": ("Etablissement des premier et second degrés", "Etablissement d'Enseignement Supérieur"),
    "Entité MESR": ("Institution de recherche", "Mention APB", "Domaine de Recherche", "Etablissement", "Académie"),
    "Adresse": ("Voie", "Code Postal", "Commune", "Pays"),
    "Entité Géo": ("Adresse", "Code Postal", "Commune", "Département", "Région", "Pays"),
    "ID publication": ("DOI", "ISSN"),
    "Article": ("Résumé", "ID publication", "Contenu d'article"),
    "Publication": ("Titre de revue", "ID publication", "Article", "Résumé"),
    "Texte": ("Français", "Anglais", "Article", "Résumé"),
    "Entité biomédicale": ("Nom d'essai clinique", "Spécialité médicale"),
    "Entité agro": ("Phyto",),
    "ID organisation": ("SIREN", "SIRET", "Numéro National de Structure", "UAI", "Numéro UMR"),
    "ID personne": ("Nom de personne", "Email", "Téléphone", "NIR"),
    "ID": ("ID organisation", "ID personne", "ID publication"),
    "Institution": ("Structure de recherche", "Etablissement", "Entreprise"),
}
OTHERS = "Autres types"
#: Words that a type is also found by.
TAGS = {
    "Nom de personne": ("Nom", "Nom de personne"), "Prénom": ("Nom de personne",), "Nom": ("Patronyme", "Nom de personne"),
    "Email": ("Adresse", "Courriel"), "URL": ("Adresse",), "Code INSEE": ("ID", "Code", "Numéro"), "NIF": ("ID",), "NIR": ("ID",),
    "Numéro National de Structure": ("Numéro National de Structure", "NumNatStruct", "RNSR"), "TVA": ("ID",),
    "Intitulé GRID": ("ID", "GRID", "Recherche", "Index"), "Année": ("Date",), "Mois": ("Date",), "Téléphone": ("Numéro",), "Adresse": ("Entité Géo",),
    "Code Postal": ("CP", "Code", "Adresse", "Entité Géo"), "Pays": ("Adresse", "Entité Géo"), "Commune": ("Ville", "Adresse", "Entité Géo"),
    "Voie": ("Rue", "Adresse", "Entité Géo"), "Département": ("Adresse", "Entité Géo"), "Région": ("Adresse", "Entité Géo"),
    "ID": ("Identifiant", "Code", "Numéro"), "ID organisation": ("Organisation", "Structure", "Identifiant", "Code", "Numéro"),
    "ID personne": ("Personne", "Individu", "Identifiant", "Code", "Numéro"), "Entreprise": ("Société", "Organisation"),
    "SIREN": ("Identifiant", "Numéro"), "SIRET": ("Identifiant", "Numéro"), "ID publication": ("Publication", "Identifiant", "Numéro"),
    "DOI": ("Identifiant", "Numéro"), "UAI": ("Identifiant", "Numéro"), "Numéro UMR": ("Identifiant", "Numéro", "Recherche"),
    "Structure de recherche": ("Organisation", "Structure", "Recherche"), "Partenaire de recherche": ("Organisation", "Structure", "Recherche"),
    "Institution de recherche": ("Recherche",), "Education Nationale": ("Education", "Enseignement"), "Académie": ("Enseignement",),
    "Etablissement": ("Enseignement",), "Etablissement des premier et second degrés": ("Primaire", "Secondaire", "Lycée", "Collège"),
    "Etablissement d'Enseignement Supérieur": ("Enseignement supérieur",), "Corps et Grades": ("Corps", "Grade", "Fonction publique"),
}
# end of fixed values
#: Rows of a bucket in which failures are counted in order.
BUCKET_ROWS = 4096


@dataclass(frozen=True)
class Matcher:
    """An expression matcher: hit gives the matched text of a cell or null; a negation takes the type from the cell."""

    type: str
    hit: Column
    score: Column | int = 100
    negates: bool = False
    min_diversity: int = 1
    level: int = 0


def pattern(type_: str, regex: str, group: int = 0, partial: bool = False, value: str = "value", **kw) -> Matcher:
    """At word boundaries: the start of the cell, or its first match if partial; full where it covers the cell."""
    p = rf"\b(?:{regex})\b"
    hit = F.nullif(F.regexp_extract(F.col(value), p if partial else f"^(?:{p})", group), F.lit(""))
    return Matcher(type_, hit, **kw)


def matchers(level: int = 1, value: str = "value") -> list[Matcher]:
    """The expression matchers up to a cost level, in order."""
    v = F.col(value)
    found = [
        Matcher("Email", F.nullif(F.regexp_extract(v, f"^({EMAIL})$", 1), F.lit(""))),
        Matcher("URL", F.nullif(F.regexp_extract(v, f"^({URL})", 1), F.lit(""))),
        Matcher("Téléphone", checks.phone(v)),
        Matcher("Téléphone", F.nullif(F.regexp_extract(v, r"((?:\+33|0)[ .-]?[1-9](?:[ .-]?[0-9]{2}){4})", 1), F.lit("")), score=75, level=2),
        Matcher("NIR", checks.nir(v)), Matcher("NIF", checks.nif(v)), Matcher("TVA", checks.tva(v)),
        Matcher("Année", F.nullif(F.regexp_extract(v, r"^\b(19[0-9]{2})\b", 1), F.lit(""))),
        Matcher("Année", F.nullif(F.regexp_extract(v, r"^\b(20[0-9]{2})\b", 1), F.lit(""))),
        Matcher("Date", checks.date(v), level=1),
        Matcher("SIREN", checks.siren(v)), Matcher("SIRET", checks.siret(v)),
        pattern("Numéro National de Structure", "[0-9]{9}[a-zA-Z]", value=value), pattern("UAI", "[0-9]{7}[a-zA-Z]", value=value),
        pattern("Numéro UMR", "UMR-?[ A-Z]{0,8}([0-9]{3,4})", 1, partial=True, value=value),
        Matcher("Date", F.when(v.rlike(r"^([0-9]{9}|[0-9]{14})$"), v), negates=True),
        Matcher("Académie", F.nullif(F.regexp_extract(F.lower(to_ascii(v)), "(acad.mie.*)$", 1), F.lit(""))),
        pattern("Code Postal", "[0-9]{5}", value=value),
        Matcher("Commune", F.nullif(F.regexp_extract(F.lower(v), r"^(?:commune|ville) +de+ +(.+)$", 1), F.lit(""))),
        Matcher("Nom de personne", F.when(F.lower(to_ascii(v)).rlike(r"\b(rue|avenue|boulevard|place|chemin|allee|impasse)\b"), v), negates=True),
        Matcher("DOI", F.nullif(F.regexp_extract(v, r"\b(10\.[0-9]{4,}(?:\.[0-9]+)*/[^\"&'<>\s]+)", 1), F.lit(""))),
        pattern("ISSN", "[0-9]{4}-[0-9]{3}[0-9xX]", value=value),
        Matcher("Adresse", F.nullif(F.regexp_extract(F.lower(to_ascii(v)), r"^([0-9]+ ?(?:bis|ter)?,? +(?:rue|avenue|av|boulevard|bd|place|chemin|allee|impasse|route|quai) .+)$", 1), F.lit("")), level=1),
    ]
    return [m for m in found if m.level <= level]


def composite(type_: str, regex: str, parts: list[tuple[str, str]], value: str = "value") -> list[Matcher]:
    """A matcher for the whole and one for each group's type; every group has to meet its own pattern."""
    groups = [F.regexp_extract(F.col(value), regex, i) for i in range(1, len(parts) + 1)]
    ok = F.col(value).rlike(regex)
    for g, (_, valid) in zip(groups, parts, strict=True):
        ok = ok & g.rlike(valid)
    return [Matcher(type_, F.when(ok, F.col(value))), *(Matcher(t, F.when(ok, g)) for g, (t, _) in zip(groups, parts, strict=True))]


def vocabulary(type_: str, terms: list[str], value: str = "value", **kw) -> Matcher:
    """Values that hold one of the terms, with what follows it."""
    return Matcher(type_, F.nullif(F.regexp_extract(case_phrase(value), rf"\b((?:{'|'.join(terms)})\b.*)$", 1), F.lit("")), **kw)


def acronym_hits(cells: DataFrame) -> DataFrame:
    """Acronyms of a value's own words that stand in the same value."""
    words = F.filter(F.split(F.trim(case_phrase("value")), r"\s+"), lambda w: w != "")
    found = F.filter(inner_acronyms(words), lambda a: F.array_contains(words, F.lower(a)))
    return cells.select("row_id", "col", F.explode(found).alias("hit")).select("row_id", "col", F.lit("Acronyme#own").alias("matcher"), F.lit("Acronyme").alias("type"), F.lit(100.0).alias("score"), F.lit(False).alias("full"), "hit", F.lit(False).alias("negates"))


def address_hits(cells: DataFrame, points: DataFrame, longest: int = 3) -> DataFrame:
    """Cells to the best point of a table (label, street, zip, city) that shares a word window with it and scores above
    100; values of fewer than four characters are left out. It stands where a geocoding service could be asked."""
    known = points.select("label", "street", "zip", "city", F.explode(tokens("label")).alias("phrase"))
    met = phrase_windows(cells.where(F.length("value") >= 4), tokens("value"), known.select("phrase", F.col("label").alias("type")), longest, first_only=False)
    pairs = met.select("row_id", "col", "value", F.col("type").alias("label")).distinct()
    scored = pairs.withColumn("score", address_udf(case_phrase("value"), case_phrase("label"))).where("score > 100")
    best = scored.groupBy("row_id", "col").agg(F.max_by("label", F.struct("score", "label")).alias("label"))
    return best.join(points, "label").select("row_id", "col", "label", "street", "zip", "city")


def cells_of(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """(row_id, col, value); null counts as empty."""
    made = F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])
    return df.select(F.col(row_id).alias("row_id"), F.inline(made))


def expression_hits(cells: DataFrame, found: list[Matcher]) -> DataFrame:
    """(row_id, col, matcher, type, score, full, hit, negates): one projection for all expression matchers."""
    def struct(i: int, m: Matcher) -> Column:
        return F.when(m.hit.isNotNull(), F.struct(
            F.lit(f"{m.type}#{i}").alias("matcher"), F.lit(m.type).alias("type"), (m.score if isinstance(m.score, Column) else F.lit(m.score)).cast("double").alias("score"),
            (F.length(m.hit) == F.length("value")).alias("full"), m.hit.alias("hit"), F.lit(m.negates).alias("negates"),
        ))

    return cells.select("row_id", "col", F.inline(F.array_compact(F.array(*[struct(i, m) for i, m in enumerate(found)]))))


def lexicon_table(labels: DataFrame, tokenize: bool = False) -> DataFrame:
    """(type, label) to (type, key, label)."""
    key = F.array_join(tokens("label"), " ") if tokenize else case_phrase("label")
    return labels.select("type", key.alias("key"), "label").where("key != ''").distinct()


def label_hits(cells: DataFrame, lexicon: DataFrame, close: bool = False) -> DataFrame:
    """Exact label matches; close: those within two edits too, scored by distance and length."""
    if not close:
        hits = dictionary_join(cells, case_phrase("value"), lexicon)
        return hits.select("row_id", "col", F.concat("type", F.lit("#label")).alias("matcher"), "type", F.lit(100.0).alias("score"), F.lit(True).alias("full"), F.explode("hits").alias("hit"), F.lit(False).alias("negates"))
    keyed = cells.withColumn("key", case_phrase("value")).where("key != ''")
    pairs = edit_join(keyed.select("key"), lexicon.select(F.col("key").alias("label_key")), "key", "label_key")
    near = pairs.join(lexicon.select(F.col("key").alias("label_key"), "type", "label"), "label_key")
    best = Window.partitionBy("key", "type").orderBy("distance", "label")
    near = near.withColumn("n", F.row_number().over(best)).where("n = 1").withColumn("score", fast_similarity("distance", F.length("label_key")).cast("double"))
    return keyed.join(near.where("score > 0"), "key").select("row_id", "col", F.concat("type", F.lit("#close")).alias("matcher"), "type", "score", (F.col("distance") == 0).alias("full"), F.col("label").alias("hit"), F.lit(False).alias("negates"))


def phrase_hits(cells: DataFrame, lexicon: DataFrame, longest: int = 4) -> DataFrame:
    words = tokens("value")
    hits = phrase_windows(cells, words, lexicon.select(F.col("key").alias("phrase"), "type").distinct(), longest)
    return hits.select("row_id", "col", F.concat("type", F.lit("#phrase")).alias("matcher"), "type", cover_score("phrase", F.array_join(words, " ")).alias("score"), (F.col("phrase") == F.array_join(words, " ")).alias("full"), F.col("phrase").alias("hit"), F.lit(False).alias("negates"))


def variant_hits(cells: DataFrame, variants: DataFrame, type_: str, longest: int = 4) -> DataFrame:
    hits = expand_variants(cells, tokens("value"), variants, longest)
    return hits.select("row_id", "col", F.lit(f"{type_}#variant").alias("matcher"), F.lit(type_).alias("type"), F.lit(100.0).alias("score"), "full", F.col("main").alias("hit"), F.lit(False).alias("negates"))


def header_types(headers: list[str], names: DataFrame) -> DataFrame:
    """(header, type, score): the best close match of each header. names: (type, label)."""
    spark = names.sparkSession
    cells = spark.createDataFrame([(i, "header", h) for i, h in enumerate(headers)], "row_id long, col string, value string")
    hits = label_hits(cells, lexicon_table(names), close=True).join(cells.select("row_id", "value"), "row_id")
    w = Window.partitionBy("value").orderBy(F.desc("score"), "type")
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("value").alias("header"), "type", "score")


def bail_out(cells: DataFrame, hits: DataFrame, max_fatal: int = MAX_FATAL, chunk_rows: int | None = None, fatal: bool = True) -> DataFrame:
    """Hits that a matcher finds before it gives up on the column, in row order.

    It gives up after max_fatal + 1 cells without a match; where failures aren't fatal, as soon as they are more than
    MAX_ERROR_RATE percent of ERROR_RATE_FROM cells or more. Order-dependent, for comparison with sequential runs;
    without it whole columns are judged. Failures are counted in buckets of row ids, then in order inside each bucket,
    so no task sorts a column.
    """
    kinds = hits.select("col", "matcher").distinct()
    hit = hits.select("row_id", "col", "matcher").distinct().withColumn("ok", F.lit(1))
    chunk = F.floor(F.col("row_id") / chunk_rows) if chunk_rows else F.lit(0).cast("long")
    every = cells.select("row_id", "col").join(kinds, "col").join(hit, ["row_id", "col", "matcher"], "left")
    every = every.select("row_id", "col", "matcher", F.col("ok").isNull().cast("long").alias("bad"), chunk.alias("chunk"), F.floor(F.col("row_id") / BUCKET_ROWS).alias("bucket"))
    keys = ["matcher", "col", "chunk"]
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = every.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
    sums = sums.select(*keys, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    at = every.withColumn("n", F.count(F.lit(1)).over(inside)).withColumn("k", F.coalesce(F.sum("bad").over(inside), F.lit(0))).join(sums, [*keys, "bucket"])
    seen, failed = F.col("n0") + F.col("n"), F.col("k0") + F.col("k")
    over = failed > max_fatal if fatal else (seen >= ERROR_RATE_FROM) & (failed * 100 > seen * MAX_ERROR_RATE)
    stops = at.where(over).groupBy(*keys).agg(F.min("row_id").alias("_stop"))
    out = hits.withColumn("chunk", chunk).join(stops, keys, "left").where("_stop is null or row_id < _stop")
    return out.select(*hits.columns)


def label_diversity(n_labels: int, base: float = LABEL_BASE) -> int:
    """Distinct hits that a lexicon of so many labels must have in a column: the logarithm of its size, rounded up."""
    return max(1, math.ceil(math.log(n_labels, base) - 1e-9)) if n_labels > 1 else 1


def lexicon_diversity(lexicon: DataFrame, kind: str, base: float = LABEL_BASE) -> dict[str, int]:
    """The least distinct hits of each type's matcher of a kind; lexicon: (type, key, label). One number for each type."""
    sizes = lexicon.groupBy("type").agg(F.count_distinct("key").alias("n")).collect()
    return {f"{r['type']}#{kind}": label_diversity(r["n"], base) for r in sizes}


def posited(hits: DataFrame, diversity: dict[str, int] | None = None) -> DataFrame:
    """Hits of matchers with enough distinct hits in the column, without the types that were negated for the cell."""
    enough = hits.where("not negates").groupBy("matcher", "col").agg(F.count_distinct("hit").alias("n"))
    if diversity:
        named = F.create_map(*[F.lit(x) for pair in sorted(diversity.items()) for x in pair])
        enough = enough.where(F.col("n") >= F.coalesce(named[F.col("matcher")], F.lit(1)))
    negated = hits.where("negates").select("row_id", "col", "type").distinct()
    return hits.where("not negates").join(enough.select("matcher", "col"), ["matcher", "col"]).join(negated, ["row_id", "col", "type"], "left_anti")


def column_scores(cells: DataFrame, hits: DataFrame, least: float = MIN_SHARE) -> DataFrame:
    """(col, type, score): percent of all cells of the column with the type; under least it is dropped."""
    n = cells.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    by_cell = hits.groupBy("row_id", "col", "type").agg(F.max("score").alias("score")).where("score > 0")
    share = by_cell.groupBy("col", "type").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n), "col")
    return share.select("col", "type", (100.0 * F.col("k") / F.col("n")).alias("score")).where(F.col("score") >= least)


def descendants(parents: dict[str, tuple[str, ...]] = PARENTS) -> dict[str, set[str]]:
    def below(t: str) -> set[str]:
        return {x for c in parents.get(t, ()) for x in {c, *below(c)}}

    return {t: below(t) for t in parents}


def decide(columns: list[str], scores: list[tuple[str, str, float]], headers: dict[str, str] | None = None, parents: dict[str, tuple[str, ...]] = PARENTS) -> dict[str, str]:
    """A type for each column out of at most columns x types scores, in column order.

    The header's type is the default. Of the types in order of their scores the first stays that no column without a
    type yet scores higher for, and of which no subtype scores more than half of it.
    """
    by: dict[str, dict[str, float]] = {c: {} for c in columns}
    for c, t, s in scores:
        by[c][t] = s
    below, out = descendants(parents), dict(headers or {})
    done: set[str] = set()
    for c in columns:
        for t, s in sorted(by[c].items(), key=lambda x: (-x[1], x[0])):
            if any(o != c and o not in done and o not in out and by[o].get(t, 0) > s for o in columns):
                continue
            if any(by[c].get(x, 0) * SUBTYPING_RATIO > s for x in below.get(t, ())):
                continue
            out[c] = t
            break
        if c in out:
            done.add(c)
    return out


def hierarchy(types: list[str], parents: dict[str, tuple[str, ...]] = PARENTS) -> dict[str, list[str]]:
    """Parent to children, the rest under one name."""
    known = {c for x in parents.values() for c in x} | set(parents)
    return {p: list(c) for p, c in parents.items()} | {OTHERS: sorted(t for t in set(types) if t not in known)}


def hierarchy_table(spark, parents: dict[str, tuple[str, ...]] = PARENTS) -> DataFrame:
    return spark.createDataFrame([(p, c) for p, x in parents.items() for c in x], "parent string, child string")


def roll_up(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """Scores of parents: the greatest of their children's."""
    up = scores.join(F.broadcast(edges), scores["type"] == edges["child"]).groupBy("col", F.col("parent").alias("type")).agg(F.max("score").alias("score"))
    return scores.unionByName(up).groupBy("col", "type").agg(F.max("score").alias("score"))


def person_hits(cells: DataFrame, first_names: frozenset[str] | None = None) -> DataFrame:
    """Values that name persons with a first and a last name; the hit is how they are written in the end."""
    found = cells.where(F.length("value") >= 4).withColumn("people", person_parser(first_names, sure=True)("value"))
    found = found.where(F.expr("size(people) > 0 and forall(people, p -> p.first != '' and p.last != '')"))
    shown = F.array_join(F.transform("people", lambda p: F.concat_ws(" ", F.nullif(p["title"], F.lit("")), p["first"], F.upper(p["last"]))), "; ")
    return found.select("row_id", "col", F.lit("Nom de personne#people").alias("matcher"), F.lit("Nom de personne").alias("type"), F.lit(100.0).alias("score"), F.lit(True).alias("full"), shown.alias("hit"), F.lit(False).alias("negates"))


def grid_hits(cells: DataFrame, institutions: DataFrame) -> DataFrame:
    """Values that match an institution; institutions: as grid.items(). Each distinct value is matched once."""
    values = cells.where("value != ''").select("value").distinct()
    source = values.select("value", F.col("value").alias("label"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("country"))
    pairs = grid.candidates(source, "value", tokens("label"), institutions, "grid_id", F.flatten(F.transform("variants", lambda v: tokens(v))))
    best = grid.best_items(source, "value", institutions, pairs).join(institutions.select("grid_id", F.col("label").alias("hit")), "grid_id")
    found = cells.join(best.select(F.col("source_id").alias("value"), "hit"), "value")
    return found.select("row_id", "col", F.lit("Intitulé GRID#grid").alias("matcher"), F.lit("Intitulé GRID").alias("type"), F.lit(100.0).alias("score"), F.lit(True).alias("full"), "hit", F.lit(False).alias("negates"))


@dataclass(frozen=True)
class Resources:
    """What matchers need beside the cells: lexicons and reference tables. What isn't given has no matcher.

    labels, phrases, close: (type, label), for labels that equal a cell, stand in it as a run of words, or are within two
    edits of it. variants: type to (variant, main). vocabularies: type to terms. composites: as composite() gives them.
    persons: whether persons' names are looked for, first_names: normal forms of first names. points: (label, street,
    zip, city). institutions: as grid.items(). diversity: least distinct hits of a matcher, where it isn't that of its
    lexicon's size. levels: the cost level from which a kind of matcher runs.
    """

    labels: DataFrame | None = None
    phrases: DataFrame | None = None
    close: DataFrame | None = None
    variants: dict[str, DataFrame] = field(default_factory=dict)
    vocabularies: dict[str, list[str]] = field(default_factory=dict)
    composites: tuple[Matcher, ...] = ()
    persons: bool = True
    first_names: frozenset[str] | None = None
    points: DataFrame | None = None
    institutions: DataFrame | None = None
    diversity: dict[str, int] = field(default_factory=dict)
    levels: dict[str, int] = field(default_factory=lambda: {"labels": 0, "variants": 0, "vocabularies": 0, "phrases": 1, "close": 2, "composites": 2, "persons": 2, "acronyms": 2, "points": 2, "institutions": 2})


def all_hits(cells: DataFrame, level: int = 1, resources: Resources | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The hits of all matchers up to a cost level, and the least distinct hits of those that ask for more than one."""
    r = resources or Resources()
    on = {kind for kind, least in r.levels.items() if level >= least}
    found = matchers(level)
    if "vocabularies" in on:
        found += [vocabulary(t, terms) for t, terms in sorted(r.vocabularies.items())]
    if "composites" in on:
        found += list(r.composites)
    least = {f"{m.type}#{i}": m.min_diversity for i, m in enumerate(found) if m.min_diversity > 1}
    hits = expression_hits(cells, found)
    if r.labels is not None and "labels" in on:
        lexicon = lexicon_table(r.labels)
        hits, least = hits.unionByName(label_hits(cells, lexicon)), least | lexicon_diversity(lexicon, "label")
    if r.close is not None and "close" in on:
        lexicon = lexicon_table(r.close)
        hits, least = hits.unionByName(label_hits(cells, lexicon, close=True)), least | lexicon_diversity(lexicon, "close")
    if r.phrases is not None and "phrases" in on:
        lexicon = lexicon_table(r.phrases, tokenize=True)
        hits, least = hits.unionByName(phrase_hits(cells, lexicon)), least | lexicon_diversity(lexicon, "phrase", PHRASE_BASE)
    if "variants" in on:
        for t, table in sorted(r.variants.items()):
            hits = hits.unionByName(variant_hits(cells, table, t))
    if r.persons and "persons" in on:
        hits = hits.unionByName(person_hits(cells, r.first_names))
    if "acronyms" in on:
        hits = hits.unionByName(acronym_hits(cells))
    if r.points is not None and "points" in on:
        near = address_hits(cells, r.points)
        hits = hits.unionByName(near.select("row_id", "col", F.lit("Adresse#points").alias("matcher"), F.lit("Adresse").alias("type"), F.lit(100.0).alias("score"), F.lit(True).alias("full"), F.col("label").alias("hit"), F.lit(False).alias("negates")))
    if r.institutions is not None and "institutions" in on:
        hits = hits.unionByName(grid_hits(cells, r.institutions))
    return hits, least | r.diversity


def type_tags(parents: dict[str, tuple[str, ...]] = PARENTS) -> dict[str, list[str]]:
    """Words by which each type is found: its own, its name, and those of the types above it."""
    tags = {t: [*words, *([t] if t not in words else [])] for t, words in TAGS.items()}
    for parent, children in parents.items():
        for word in tags.setdefault(parent, [parent]):
            for child in children:
                own = tags.setdefault(child, [])
                if word not in own:
                    own.append(word)
    return tags


def infer(df: DataFrame, columns: list[str], row_id: str = "row_id", lexicon: DataFrame | None = None, header_names: DataFrame | None = None, level: int = 1, sample_rows: int | None = SAMPLE_ROWS, fail_fast: bool = False, resources: Resources | None = None) -> dict:
    """{'column_types', 'all_types', 'type_tags'}; by default over the first sample_rows rows by row id, None: all rows.

    All matchers that the level and the resources allow take part; lexicon is short for resources with these labels.
    """
    if resources is None:
        resources = Resources(labels=lexicon)
    rows = df.where(F.col(row_id) < sample_rows) if sample_rows is not None else df
    cells = cells_of(rows, columns, row_id)
    hits, least = all_hits(cells, level, resources)
    if fail_fast:
        hits = bail_out(cells, hits)
    found = [(r["col"], r["type"], r["score"]) for r in column_scores(cells, posited(hits, least)).collect()]
    headers = {r["header"]: r["type"] for r in header_types(columns, header_names).collect()} if header_names is not None else {}
    return {"column_types": decide(columns, found, headers), "all_types": hierarchy([t for _, t, _ in found]), "type_tags": type_tags()}
