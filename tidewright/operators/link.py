"""Linking: token index, relevance-ranked best match with filters and fixed pairs, label updates, metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import case_phrase, char_ngrams, tokens
from ..sources.shared import stored

# fixed values
K1, B = 1.2, 0.75
MANUAL_CONFIDENCE, DECISION, MAX_PAIRS, MAX_SEARCH_VALUES = 999.0, 1.0, 5, 15
LINK_COLUMNS = ("__ID_REF", "__ES_SCORE", "__THRESH", "__CONFIDENCE", "__IS_MATCH")
# end of fixed values
#: Postings of a term are dealt to tasks in slices of so many rows. For a first bound on a row's best score, so many of
#: its rarest terms and about so many postings of each are looked at.
SLICE_ROWS, FIRST_TERMS, FIRST_ROWS = 10_000, 3, 32
#: A token of at most so many reference ids, and so large a share of them, is rare.
RARE_ROWS, RARE_SHARE = 100, 0.01
#: Source rows that a labeller asks about.
SAMPLE_ROWS = 3000
#: Scores that differ by less are equal.
EPSILON = 1e-6


@dataclass(frozen=True)
class Clause:
    """must or should, source column, reference column, analyzer, boost."""

    kind: str
    source: str
    ref: str
    analyzer: str = "words"
    boost: float = 1.0


@dataclass
class ColumnMatch:
    source: list[str]
    ref: list[str]
    exact_only: bool = False


def column_matches(found: list[dict]) -> list[ColumnMatch]:
    """Checked column matches: duplicates out, both sides filled, one to five of them."""
    out = [ColumnMatch(list(dict.fromkeys(m["source"])), list(dict.fromkeys(m["ref"])), bool(m.get("exact_only"))) for m in found]
    out = [m for m in out if m.source and m.ref]
    if not 1 <= len(out) <= MAX_PAIRS:
        raise ValueError(f"one to {MAX_PAIRS} column matches are asked for")
    return out


#: Endings that establishment terms lose, longest first; what is left has three letters at least.
ENDINGS = "issements|issement|ements|ement|ations|ation|iques|ique|aires|aire|euses|euse|elles|elle|aux|eurs|eur|ives|ive|ites|ite|ees|ee|es|s|e"


def light_stem(word: Column) -> Column:
    """A word without one ending of number, gender or derivation, so that forms of one word meet."""
    return F.regexp_replace(word, f"^([a-z]{{3,}}?)(?:{ENDINGS})$", "$1")


def analyze(c: str, analyzer: str, phrases: tuple[str, ...] = ()) -> Column:
    """Terms of a text column: keyword, words, establishment (stemmed words), n_grams, integers, city or country.

    city and country keep those of the given phrases, brought to a normal form, that the text holds as whole words; the
    lists are parameters (a lexicon's labels). Without a list they give the words, each by itself.
    """
    value = F.coalesce(F.col(c).cast("string"), F.lit(""))
    if analyzer == "keyword":
        return F.filter(F.array(F.trim(case_phrase(value))), lambda t: t != "")
    if analyzer == "n_grams":
        return char_ngrams(F.trim(case_phrase(value)), 3)
    if analyzer == "integers":
        return F.regexp_extract_all(value, F.lit("([0-9]+)"), 1)
    if analyzer == "words":
        return tokens(value)
    if analyzer == "establishment":
        return F.transform(tokens(value), light_stem)
    if analyzer in ("city", "country"):
        if not phrases:
            return tokens(value)
        text = F.concat(F.lit(" "), F.regexp_replace(F.trim(case_phrase(value)), r"\s+", " "), F.lit(" "))
        known = F.array(*[F.regexp_replace(F.trim(case_phrase(F.lit(p))), r"\s+", " ") for p in phrases])
        return F.filter(known, lambda p: (p != "") & F.contains(text, F.concat(F.lit(" "), p, F.lit(" "))))
    raise ValueError(f"no analyzer {analyzer}")


# fixed values: sets of analyzers, and the set of a column by its type
PLACE_SET, CITY_SET, COUNTRY_SET = ("establishment", "n_grams", "integers", "city", "country"), ("establishment", "n_grams", "city"), ("establishment", "n_grams", "country")
MIXED_SET, TEXT_SET, CODE_SET, EXACT_SET = ("establishment", "n_grams", "integers"), ("establishment", "n_grams"), ("n_grams", "integers"), ("keyword",)
ANALYZERS = {
    "Académie": PLACE_SET, "Adresse": PLACE_SET, "Entité MESR": PLACE_SET, "Entreprise": PLACE_SET, "Etablissement": PLACE_SET,
    "Etablissement d'Enseignement Supérieur": PLACE_SET, "Etablissement des premier et second degrés": PLACE_SET, "Institution": PLACE_SET,
    "Institution de recherche": PLACE_SET, "Intitulé GRID": PLACE_SET, "Région": PLACE_SET, "Structure de recherche": PLACE_SET,
    "Commune": CITY_SET, "Pays": COUNTRY_SET,
    "Article": MIXED_SET, "Département": MIXED_SET, "Entité agro": MIXED_SET, "Entité biomédicale": MIXED_SET, "Phyto": MIXED_SET, "Publication": MIXED_SET, "Texte": MIXED_SET,
    "Corps et Grades": TEXT_SET, "Date": TEXT_SET, "Nom": TEXT_SET, "Nom de personne": TEXT_SET, "Prénom": TEXT_SET, "Spécialité médicale": TEXT_SET, "Titre": TEXT_SET,
    "Année": CODE_SET, "Code INSEE": CODE_SET, "Code Postal": CODE_SET, "DOI": CODE_SET, "ID": CODE_SET, "ID organisation": CODE_SET, "ID personne": CODE_SET,
    "ID publication": CODE_SET, "ISSN": CODE_SET, "Mois": CODE_SET, "NIF": CODE_SET, "NIR": CODE_SET, "Numéro National de Structure": CODE_SET, "Numéro UMR": CODE_SET,
    "SIREN": CODE_SET, "SIRET": CODE_SET, "Téléphone": CODE_SET, "UAI": CODE_SET, "URL": CODE_SET, "Voie": CODE_SET,
    "Email": EXACT_SET,
}
ALL_ANALYZERS = PLACE_SET
# end of fixed values


def columns_to_index(columns: list[str], types: dict[str, str], matched: list[str], exact_only: list[str] = ()) -> dict[str, tuple[str, ...]]:
    """Analyzers of each column: none but keyword for columns that aren't matched or are for exact use."""
    return {c: ("keyword",) if c not in matched or c in exact_only else (*ANALYZERS.get(types.get(c, ""), ALL_ANALYZERS),) for c in columns}


def postings(ref: DataFrame, ref_id: str, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """(field, analyzer, term, ref_id, tf, dl): one row for each term of each field of each row."""
    fields = [F.struct(F.lit(c).alias("field"), F.lit(a).alias("analyzer"), analyze(c, a).alias("terms")) for c, found in columns.items() for a in found]
    rows = ref.select(F.col(ref_id).alias("ref_id"), F.inline(F.array(*fields)))
    return rows.select("field", "analyzer", "ref_id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("field", "analyzer", "term", "ref_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def field_stats(posted: DataFrame, n_rows: DataFrame) -> DataFrame:
    """(field, analyzer, n_docs, avgdl): mean length over the rows that have terms; n_docs counts all rows."""
    per_row = posted.select("field", "analyzer", "ref_id", "dl").distinct()
    return per_row.groupBy("field", "analyzer").agg(F.avg("dl").alias("avgdl")).crossJoin(F.broadcast(n_rows))


def key_of(field: Column | str, analyzer: Column | str, term: Column | str) -> Column:
    return F.concat_ws("\x01", field, analyzer, term)


def weighted(posted: DataFrame, n_rows: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Postings with what each adds to a score: (key, ref_id, impact, df, slice, slices). among: (ref_id), if only these
    rows are to be found; the statistics count all rows."""
    stats = field_stats(posted, n_rows)
    df = posted.groupBy("field", "analyzer", "term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(stats), ["field", "analyzer"])
    idf = df.withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).select("field", "analyzer", "term", "df", "idf", "avgdl")
    found = posted if among is None else posted.join(among, "ref_id", "left_semi")
    impact = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    slices = F.ceil(F.col("df") / SLICE_ROWS)
    return found.join(idf, ["field", "analyzer", "term"]).select(key_of("field", "analyzer", "term").alias("key"), "ref_id", impact.alias("impact"), "df", F.pmod(F.xxhash64("ref_id"), slices).alias("slice"), slices.alias("slices"))


def asked_terms(source: DataFrame, source_id: str, template: list[Clause]) -> DataFrame:
    """(source_id, clause, key, boost): each distinct term that a source row asks a clause for."""
    clauses = [F.struct(F.lit(i).alias("clause"), F.lit(c.ref).alias("field"), F.lit(c.analyzer).alias("analyzer"), F.lit(float(c.boost)).alias("boost"), F.array_distinct(analyze(c.source, c.analyzer)).alias("terms")) for i, c in enumerate(template)]
    asked = source.select(F.col(source_id).alias("source_id"), F.inline(F.array(*clauses))).select("source_id", "clause", "field", "analyzer", "boost", F.explode("terms").alias("term"))
    return asked.select("source_id", "clause", key_of("field", "analyzer", "term").alias("key"), "boost")


def index_of(ref: DataFrame, ref_id: str, template: list[Clause]) -> DataFrame:
    wanted: dict[str, tuple[str, ...]] = {}
    for c in template:
        wanted[c.ref] = tuple(dict.fromkeys((*wanted.get(c.ref, ()), c.analyzer)))
    return postings(ref, ref_id, wanted)


def must_of(template: list[Clause]) -> list[int]:
    return [i for i, c in enumerate(template) if c.kind == "must"]


def _met(asked: DataFrame, postings_: DataFrame) -> DataFrame:
    """asked joined with postings on the key; slices of a hot term's postings fill many tasks."""
    hot = postings_.where("slices > 1").select("key", "slices").distinct()
    spread = asked.join(hot, "key", "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    return spread.join(postings_.select("key", "slice", "ref_id", "impact"), ["key", "slice"])


def bm25_scores(source: DataFrame, source_id: str, ref: DataFrame, ref_id: str, template: list[Clause], index: DataFrame | None = None) -> DataFrame:
    """(source_id, ref_id, score): the sum over clauses of boost times BM25, for all pairs that share a term, of each must
    clause one at least. All terms count, however common; for the best pair of each row best_scores is the way."""
    posted = index if index is not None else index_of(ref, ref_id, template)
    met = _met(asked_terms(source, source_id, template), weighted(posted, ref.agg(F.count(F.lit(1)).alias("n_docs"))))
    must = must_of(template)
    out = met.groupBy("source_id", "ref_id").agg(F.sum(F.col("boost") * F.col("impact")).alias("score"), F.collect_set("clause").alias("clauses"))
    if must:
        out = out.where(F.size(F.array_intersect("clauses", F.array(*[F.lit(i) for i in must]))) == len(must))
    return out.select("source_id", "ref_id", "score")


def best_scores(asked: DataFrame, posted: DataFrame, must: list[int] | None = None, forbidden: DataFrame | None = None) -> DataFrame:
    """(source_id, ref_id, score): of each source row the best pair, exactly; ties go to the smaller id, of any type.

    asked: (source_id, clause, key, boost), posted: weighted(). Not all pairs are made. A few postings of a row's rarest
    terms give pairs, the best of which bounds the best score from below. The terms that together can't reach that
    bound, the common ones of little weight (of equal weights the most common), needn't be expanded: a better pair has
    another term. So pairs come from the other terms; those whose sum and what the rest can add stay under the bound
    leave; the others are scored in full. forbidden: (source_id, ref_id) that can't be taken.
    """
    # of an id that several rows have, one vector
    posted = posted.repartition("ref_id").groupBy("ref_id", "key").agg(F.sum("impact").alias("impact"), F.max("df").alias("df"), F.max("slice").alias("slice"), F.max("slices").alias("slices"))
    posted = stored(posted, "postings")
    tops = posted.groupBy("key").agg(F.max("impact").alias("top"), F.max("df").alias("df"))
    asked = stored(asked.join(tops, "key").withColumn("most", F.col("boost") * F.col("top")), "asked")
    need = F.array(*[F.lit(i) for i in must or []]) if must else None
    terms = asked.groupBy("source_id").agg(F.collect_list(F.struct("key", "clause", "boost")).alias("terms"))
    vectors = posted.groupBy("ref_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "impact"))).alias("vector"))

    def scored(pairs: DataFrame) -> DataFrame:
        if forbidden is not None:
            pairs = pairs.join(forbidden.select("source_id", "ref_id"), ["source_id", "ref_id"], "left_anti")
        both = pairs.join(terms, "source_id").join(vectors, "ref_id")
        hits = F.expr("filter(transform(terms, t -> struct(t.clause as clause, t.boost * vector[t.key] as part)), t -> t.part is not null)")
        both = both.select("source_id", "ref_id", hits.alias("hits"))
        if need is not None:
            both = both.where(F.size(F.array_intersect(F.expr("transform(hits, h -> h.clause)"), need)) == len(must))
        return both.select("source_id", "ref_id", F.expr("aggregate(hits, 0D, (s, h) -> s + h.part)").alias("score"))

    rare = asked.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("df", "key", "clause"))).where(F.col("_n") <= FIRST_TERMS)
    few = posted.where(F.pmod(F.xxhash64("ref_id"), F.ceil(F.col("df") / FIRST_ROWS)) == 0)
    bound = stored(scored(rare.join(few, "key").select("source_id", "ref_id").distinct()).groupBy("source_id").agg(F.max("score").alias("bound")), "bounds")
    upto = Window.partitionBy("source_id").orderBy("most", F.desc("df"), "key", "clause").rowsBetween(Window.unboundedPreceding, 0)
    ranked = asked.join(bound, "source_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)) - EPSILON).withColumn("upto", F.sum("most").over(upto))
    ranked = ranked.withColumn("rest", F.coalesce(F.max(F.when(F.col("upto") < F.col("bound"), F.col("upto"))).over(Window.partitionBy("source_id")), F.lit(0.0)))
    met = _met(ranked.where("upto >= bound").select("source_id", "key", "boost", "bound", "rest"), posted)
    pairs = met.groupBy("source_id", "ref_id").agg(F.sum(F.col("boost") * F.col("impact")).alias("part"), F.max("bound").alias("bound"), F.max("rest").alias("rest"))
    best = scored(pairs.where("part + rest >= bound").select("source_id", "ref_id")).groupBy("source_id").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "ref_id", "score")).alias("t"))
    return best.select("source_id", "t.ref_id", "t.score")


def with_filters(ref: DataFrame, must: dict[str, list[str]] | None = None, must_not: dict[str, list[str]] | None = None) -> DataFrame:
    """Reference rows with all must terms and none of the must_not terms in the named columns."""
    for c, terms in (must or {}).items():
        ref = ref.where(F.size(F.array_except(F.array(*[F.lit(t) for t in terms]), analyze(c, "words"))) == 0)
    for c, terms in (must_not or {}).items():
        ref = ref.where(~F.arrays_overlap(analyze(c, "words"), F.array(*[F.lit(t) for t in terms])))
    return ref


def best_match(scores: DataFrame, thresh: float, exact_pairs: DataFrame | None = None, non_matching: DataFrame | None = None) -> DataFrame:
    """(source_id, __ID_REF, __ES_SCORE, __THRESH, __CONFIDENCE, __IS_MATCH): one row per source row that has a hit.

    exact_pairs and non_matching: (source_id, ref_id). Forbidden pairs leave before the ranking; forced ones win with
    confidence 999. Ties go to the smaller reference id, which may be of any type that has an order.
    """
    if non_matching is not None:
        scores = scores.join(non_matching.select("source_id", "ref_id"), ["source_id", "ref_id"], "left_anti")
    top = scores.groupBy("source_id").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "ref_id", "score")).alias("t"))
    out = top.select("source_id", F.col("t.ref_id").alias("__ID_REF"), F.col("t.score").alias("__ES_SCORE"), F.lit(float(thresh)).alias("__THRESH"), (F.col("t.score") / thresh).alias("__CONFIDENCE"))
    out = out.withColumn("__IS_MATCH", F.col("__CONFIDENCE") >= DECISION)
    return with_forced(out, thresh, exact_pairs) if exact_pairs is not None else out


def with_forced(out: DataFrame, thresh: float, exact_pairs: DataFrame) -> DataFrame:
    forced = exact_pairs.groupBy("source_id").agg(F.min("ref_id").alias("__ID_REF"))
    forced = forced.select("source_id", "__ID_REF", F.lit(None).cast("double").alias("__ES_SCORE"), F.lit(float(thresh)).alias("__THRESH"), F.lit(MANUAL_CONFIDENCE).alias("__CONFIDENCE"), F.lit(True).alias("__IS_MATCH"))
    return out.join(forced.select("source_id"), "source_id", "left_anti").unionByName(forced)


def readings(rows: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(id, reads): all that the rows of an id hold in the columns, in one order. Null ids never match and leave."""
    cells = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(dict.fromkeys(columns))])
    return rows.where(F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("id")).agg(F.array_sort(F.collect_list(cells)).alias("reads"))


def bm25_best(source: DataFrame, source_id: str, ref: DataFrame, ref_id: str, template: list[Clause], thresh: float, exact_pairs: DataFrame | None = None, non_matching: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """best_match by best_scores, with equal ids taken together: a query that many source ids ask is answered once, and
    of reference ids that read alike only the smallest, which wins ties, is a candidate (statistics count all of them).
    Source ids are equal if the same pairs are forbidden to them too; of reference ids that read alike, all that some
    source id is forbidden and the smallest of the others are candidates, so that each finds the smallest left to it.
    The rows of an id are one query, or one vector. index: a stored index_of()."""
    posted = index if index is not None else stored(index_of(ref, ref_id, template), "index")
    n_rows = ref.agg(F.count(F.lit(1)).alias("n_docs"))
    asks, texts, no = readings(source, source_id, [c.source for c in template]), readings(ref, ref_id, [c.ref for c in template]), None
    if non_matching is None:
        first = texts.groupBy("reads").agg(F.min("id").alias("ref_id")).select("ref_id")
    else:
        no = stored(non_matching.select("source_id", "ref_id").distinct(), "forbidden")
        lists = no.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set("ref_id")).alias("no"))
        asks = asks.join(lists, "id", "left").withColumn("no", F.coalesce("no", F.array().cast(lists.schema["no"].dataType)))
        texts = texts.join(no.select(F.col("ref_id").alias("id"), F.lit(True).alias("named")).distinct(), "id", "left")
        least = F.min("id").alias("ref_id")
        first = texts.where("named is null").groupBy("reads").agg(least).select("ref_id").union(texts.where("named").select(F.col("id").alias("ref_id")))
    asks = stored(asks, "asks")
    alike = [c for c in asks.columns if c != "id"]
    same = asks.groupBy(*alike).agg(F.min("id").alias("_q"))
    queries = source.join(same.select(F.col("_q").alias(source_id)), source_id, "left_semi")
    scores = best_scores(asked_terms(queries, source_id, template), weighted(posted, n_rows, first), must_of(template), no)
    best = best_match(scores, thresh).withColumnRenamed("source_id", "_q")
    out = asks.join(same, alike).select(F.col("id").alias("source_id"), "_q").join(best, "_q").drop("_q")
    return with_forced(out, thresh, exact_pairs) if exact_pairs is not None else out


def link(source: DataFrame, source_id: str, ref: DataFrame, ref_id: str, template: list[Clause], thresh: float, must=None, must_not=None, exact_pairs=None, non_matching=None) -> DataFrame:
    """Source rows with the columns of their best reference row (`__REF`) and the link columns; all source rows stay.

    Every cell that the link writes counts as modified: each new column has a `__MODIFIED` flag, true where the row has
    a reference row.
    """
    allowed = with_filters(ref, must, must_not)
    best = bm25_best(source, source_id, allowed, ref_id, template, thresh, exact_pairs, non_matching)
    refs = ref.select(*[F.col(c).alias(f"{c}__REF") for c in ref.columns])
    out = source.join(best.withColumnRenamed("source_id", source_id), source_id, "left").join(refs, F.col("__ID_REF") == F.col(f"{ref_id}__REF"), "left")
    return out.withColumns({f"{c}__MODIFIED": F.col("__ID_REF").isNotNull() for c in refs.columns})


def token_overlap_top1(source: DataFrame, source_id: str, source_col: str, ref: DataFrame, ref_id: str, ref_col: str) -> DataFrame:
    """(source_id, ref_id, overlap): the row with most distinct common tokens, ties to the smaller id.

    Source ids with equal tokens are one query, and of reference ids with equal tokens only the smallest, which wins
    ties, is a candidate. An id of several rows has the tokens of each of them. Pairs that share a rare token are few and
    all made. For the others only common tokens count, so there ids with equal common tokens are taken together; a pair
    that shares a rare token too is put too low by that, but comes with its whole overlap from the first way.
    """

    def words_of(rows: DataFrame, row_id: str, c: str) -> DataFrame:
        words = F.array_sort(F.flatten(F.collect_list(F.array_distinct(tokens(c)))))
        return rows.where(F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("id")).agg(words.alias("words")).where(F.size("words") > 0)

    def each(rows: DataFrame, c: str) -> DataFrame:
        return rows.select(c, F.explode("words").alias("key"))

    asks = stored(words_of(source, source_id, source_col), "asks")
    same = asks.groupBy("words").agg(F.min("id").alias("_q"))
    refs = stored(words_of(ref, ref_id, ref_col).groupBy("words").agg(F.min("id").alias("ref_id")), "refs")
    n_refs = refs.agg(F.count(F.lit(1)).alias("n"))
    is_rare = F.col("df") <= F.least(F.lit(float(RARE_ROWS)), F.col("n") * RARE_SHARE)
    keys = stored(each(refs, "ref_id").groupBy("key").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n_refs)).select("key", is_rare.alias("rare")), "keys")
    rare = keys.where("rare").select("key")

    pairs = each(same, "_q").join(rare, "key", "left_semi").join(each(refs, "ref_id").join(rare, "key", "left_semi"), "key").select("_q", "ref_id").distinct()
    both = pairs.join(same.withColumnRenamed("words", "asked"), "_q").join(refs, "ref_id")
    whole = both.select("_q", "ref_id", F.expr("aggregate(asked, 0L, (n, a) -> n + size(filter(words, w -> w = a)))").alias("overlap"))

    def left_of(rows: DataFrame, c: str) -> DataFrame:
        return each(rows, c).join(rare, "key", "left_anti").groupBy(c).agg(F.array_sort(F.collect_list("key")).alias("words"))

    left = stored(left_of(same, "_q"), "left")
    groups = left.groupBy("words").agg(F.min("_q").alias("source_id"))
    a = each(groups, "source_id").select("source_id", F.lit(0).alias("clause"), "key", F.lit(1.0).alias("boost"))
    b = stored(each(left_of(refs, "ref_id").groupBy("words").agg(F.min("ref_id").alias("ref_id")), "ref_id"), "tokens")
    df = b.groupBy("key").agg(F.count(F.lit(1)).alias("df")).withColumn("slices", F.ceil(F.col("df") / SLICE_ROWS))
    posted = b.join(df, "key").select("key", "ref_id", F.lit(1.0).alias("impact"), "df", F.pmod(F.xxhash64("ref_id"), F.col("slices")).alias("slice"), "slices")
    best = best_scores(a, posted).join(groups, "source_id").join(left, "words").select("_q", "ref_id", F.col("score").cast("long").alias("overlap"))
    top = best.union(whole).groupBy("_q").agg(F.min(F.struct((-F.col("overlap")).alias("s"), "ref_id", "overlap")).alias("t"))
    return asks.join(same, "words").select(F.col("id").alias("source_id"), "_q").join(top, "_q").select("source_id", "t.ref_id", "t.overlap")


def update_labels(linked: DataFrame, labels: DataFrame, source_id: str, refs: DataFrame, ref_id: str, keep_true: bool = False) -> DataFrame:
    """Links after manual labels (source_id, ref_id, is_match, seq); of several for a source row the last by seq counts.

    A match takes over the labelled reference row with confidence 999; a non-match of the linked row empties the link.
    keep_true reproduces a known slip of sequential runs, by which an emptied link still counts as a match.
    """
    last = labels.groupBy("source_id").agg(F.max_by(F.struct("ref_id", "is_match"), "seq").alias("l")).select(F.col("source_id").alias(source_id), F.col("l.ref_id").alias("_lref"), F.col("l.is_match").alias("_lmatch"))
    j = linked.join(last, source_id, "left")
    taken = F.coalesce(F.col("_lmatch"), F.lit(False))
    emptied = F.coalesce(~F.col("_lmatch") & (F.col("_lref") == F.col("__ID_REF")), F.lit(False))
    ref_cols = [c for c in linked.columns if c.endswith("__REF") and c != "__ID_REF"]
    new = refs.select(*[F.col(c.removesuffix("__REF")).alias(f"_r_{c}") for c in ref_cols], F.col(ref_id).alias("_rid"))
    j = j.join(new, F.col("_rid") == F.when(taken, F.col("_lref")), "left")
    out = []
    for c in linked.columns:
        v = F.col(c)
        if c in ref_cols:
            v = F.when(emptied, None).when(taken, F.col(f"_r_{c}")).otherwise(v)
        elif c == "__ID_REF":
            v = F.when(emptied, None).when(taken, F.col("_lref")).otherwise(v)
        elif c == "__CONFIDENCE":
            v = F.when(emptied, None).when(taken, F.lit(MANUAL_CONFIDENCE)).otherwise(v)
        elif c == "__IS_MATCH":
            v = F.when(emptied, F.lit(keep_true)).when(taken, F.lit(True)).otherwise(F.coalesce(v, F.lit(False)))
        elif c in ("__ES_SCORE", "__THRESH"):
            v = F.when(emptied, None).otherwise(v)
        out.append(v.alias(c))
    return j.select(*out)


def null_below(linked: DataFrame, thresh: float = DECISION, ref_cols: bool = True) -> DataFrame:
    """Every column with `__` in its name is nulled where the confidence is not at the threshold; __IS_MATCH: false."""
    ok = F.coalesce(F.col("__CONFIDENCE") >= thresh, F.lit(False))
    out = [F.coalesce(F.when(ok, F.col(c)), F.lit(False)).alias(c) if c == "__IS_MATCH" else F.when(ok, F.col(c)).alias(c) if "__" in c else F.col(c) for c in linked.columns]
    return linked.select(*out)


def metrics(linked: DataFrame, key: str | None = None, key_ref: str | None = None, lower: bool = False, thresholds: tuple[float, ...] = (1.0,)) -> DataFrame:
    """One row: n_rows, num_match, perc_match, num and perc at each threshold, num_verif_samples, precision."""
    conf = F.col("__CONFIDENCE")
    has = conf.isNotNull()
    out = [F.count(F.lit(1)).alias("n_rows"), F.count_if(has).alias("num_match"), F.avg(has.cast("double")).alias("perc_match")]
    for i, t in enumerate(thresholds):
        over = F.coalesce(conf >= t, F.lit(False))
        out += [F.count_if(over).alias(f"num_match_thresh_{i}"), F.avg(over.cast("double")).alias(f"perc_match_thresh_{i}")]
    if key and key_ref:
        a, b = (F.lower(F.col(c)) if lower else F.col(c) for c in (key, key_ref))
        both = F.coalesce(conf >= DECISION, F.lit(False)) & a.isNotNull() & b.isNotNull()
        out += [F.count_if(both).alias("num_verif_samples"), F.avg(F.when(both, (a == b).cast("double"))).alias("precision")]
    return linked.agg(*out)


def merge_metrics(parts: list[dict], weighted_by_match: bool = True) -> dict:
    """Metrics of chunks to one, means weighted by matches (as sequential runs do) or by rows."""
    weight = "num_match" if weighted_by_match else "n_rows"
    total = sum(p[weight] for p in parts)
    out = {}
    for k in parts[0]:
        out[k] = sum(p[k] * p[weight] for p in parts) / total if (k.startswith("perc") or k == "precision") and total else sum(p[k] for p in parts)
    return out


def majority(votes: DataFrame) -> DataFrame:
    """(source_id, ref_id) of several labellers to the most frequent pair of each source row: source_id, ref_id, n."""
    n = votes.groupBy("source_id", "ref_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source_id").orderBy(F.desc("n"), "ref_id")
    return n.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def template_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall of (source_id, ref_id) links against labelled pairs."""
    hit = found.join(truth.select("source_id", F.col("ref_id").alias("_t")), "source_id", "inner").withColumn("ok", (F.col("ref_id") == F.col("_t")).cast("int"))
    n = truth.agg(F.count(F.lit(1)).alias("n_truth"))
    return hit.agg(F.count(F.lit(1)).alias("n_found"), F.coalesce(F.sum("ok"), F.lit(0)).alias("n_right")).crossJoin(n).select(
        "n_found", "n_right", "n_truth", F.when(F.col("n_found") > 0, F.col("n_right") / F.col("n_found")).alias("precision"), (F.col("n_right") / F.col("n_truth")).alias("recall")
    )


@dataclass
class Labeller:
    """Finds the best of several templates against labelled pairs; answers come one at a time."""

    source: DataFrame
    source_id: str
    ref: DataFrame
    ref_id: str
    templates: list[list[Clause]]
    must: dict[str, list[str]] = field(default_factory=dict)
    must_not: dict[str, list[str]] = field(default_factory=dict)
    target_precision: float = 0.9
    target_recall: float = 0.9
    pairs: dict = field(default_factory=dict)
    searches: dict[str, list[str]] = field(default_factory=dict)

    ANSWERS = {"1": True, "y": True, "0": False, "n": False, "u": None, "p": None, "f": None}

    def answer_is_valid(self, answer: str) -> bool:
        return answer in self.ANSWERS

    def update(self, source_id, ref_id, answer: str) -> None:
        if not self.answer_is_valid(answer):
            raise ValueError(f"no answer {answer}")
        if answer == "p":
            self.pairs.popitem()
        elif self.ANSWERS[answer] is not None:
            self.pairs[source_id, ref_id] = self.ANSWERS[answer]

    def update_musts(self, must: dict, must_not: dict) -> None:
        self.must, self.must_not = must, must_not

    def update_targets(self, precision: float, recall: float) -> None:
        if not (0 <= precision <= 1 and 0 <= recall <= 1):
            raise ValueError("targets are between 0 and 1")
        self.target_precision, self.target_recall = precision, recall

    def add_custom_search(self, values: dict[str, list[str]]) -> None:
        if any(len(v) > MAX_SEARCH_VALUES for v in values.values()):
            raise ValueError(f"at most {MAX_SEARCH_VALUES} values for each column")
        self.searches |= values

    def clear_custom_search(self) -> None:
        self.searches = {}

    def searched(self) -> DataFrame:
        """The reference rows that the custom search asks for: in each of its columns one of the values' words."""
        found = self.ref
        for c, values in self.searches.items():
            wanted = F.array_distinct(F.flatten(F.array(*[tokens(F.lit(v)) for v in values])))
            found = found.where(F.arrays_overlap(analyze(c, "words"), wanted))
        return found

    def to_emit(self, template: int | None = None) -> dict | None:
        """The next pair to be asked for: the first source row of the sample without an answer, with the best reference
        row that wasn't refused for it (among those of the custom search, if there is one), and how far things are."""
        done = {s for (s, _), ok in self.pairs.items() if ok}
        sample = self.source.orderBy(self.source_id).limit(SAMPLE_ROWS)
        kinds = [df.schema[i].dataType.simpleString() for df, i in ((self.source, self.source_id), (self.ref, self.ref_id))]
        spark = self.source.sparkSession
        refused = [(s, r) for (s, r), ok in self.pairs.items() if not ok]
        left = sample.where(~F.col(self.source_id).isin(list(done))) if done else sample
        ref = with_filters(self.searched(), self.must, self.must_not)
        no = spark.createDataFrame(refused, f"source_id {kinds[0]}, ref_id {kinds[1]}") if refused else None
        found = bm25_best(left, self.source_id, ref, self.ref_id, self.templates[template or 0], 1.0, None, no).orderBy("source_id").first()
        if found is None:
            return None
        row = self.source.where(F.col(self.source_id) == F.lit(found["source_id"])).first()
        other = self.ref.where(F.col(self.ref_id) == F.lit(found["__ID_REF"])).first()
        return {"source_id": found["source_id"], "ref_id": found["__ID_REF"], "score": found["__ES_SCORE"], "source": row.asDict(), "ref": other.asDict(), "n_matches": len(done), "n_refused": len(refused)}

    def threshold(self, template: int) -> float:
        """The least score at which the template's links reach the target precision on the labelled pairs: the score
        between the last right and the first wrong link that are still within it; 1.0 without labelled matches."""
        right = {s: r for (s, r), ok in self.pairs.items() if ok}
        if not right:
            return 1.0
        mine = self.source.where(F.col(self.source_id).isin(list(right)))
        best = bm25_best(mine, self.source_id, with_filters(self.ref, self.must, self.must_not), self.ref_id, self.templates[template], 1.0)
        found = sorted(((r["__ES_SCORE"], right[r["source_id"]] == r["__ID_REF"]) for r in best.collect()), reverse=True)
        hits, thresh = 0, None
        for n, (score, ok) in enumerate(found, 1):
            hits += ok
            if hits >= self.target_precision * n and (n == len(found) or found[n][0] < score):
                thresh = score if n == len(found) else (score + found[n][0]) / 2
        return float(thresh) if thresh is not None else float(found[0][0]) + EPSILON if found else 1.0

    def auto_label(self, source_key: str, ref_key: str) -> None:
        """Labels pairs of equal non-null keys as matches (the labeller's sample only: 3000 source rows at most)."""
        a = self.source.orderBy(self.source_id).limit(SAMPLE_ROWS).select(F.col(self.source_id).alias("s"), F.col(source_key).alias("k"))
        for s, r in a.join(self.ref.select(F.col(self.ref_id).alias("r"), F.col(ref_key).alias("k")), "k").select("s", "r").collect():
            self.pairs[s, r] = True

    def quality(self) -> list[tuple[float, float, float]]:
        """(precision, recall, score) of each template; the score weighs both by how far they are from their targets."""
        spark = self.source.sparkSession
        right = [(s, r) for (s, r), ok in self.pairs.items() if ok]
        if not right:
            return [(0.0, 0.0, 0.0) for _ in self.templates]
        kinds = [df.schema[i].dataType.simpleString() for df, i in ((self.source, self.source_id), (self.ref, self.ref_id))]
        truth = spark.createDataFrame(right, f"source_id {kinds[0]}, ref_id {kinds[1]}")
        mine = self.source.join(truth.select(F.col("source_id").alias(self.source_id)).distinct(), self.source_id, "left_semi")
        out = []
        for t in self.templates:
            best = bm25_best(mine, self.source_id, with_filters(self.ref, self.must, self.must_not), self.ref_id, t, 1.0)
            q = template_quality(best.select("source_id", F.col("__ID_REF").alias("ref_id")), truth).first()
            p, r = q["precision"] or 0.0, q["recall"] or 0.0
            out.append((p, r, min(p / max(self.target_precision, 1e-9), 1) + min(r / max(self.target_recall, 1e-9), 1)))
        return out

    def export_best_params(self) -> dict:
        quality = self.quality()
        k = max(range(len(quality)), key=lambda i: (quality[i][2], -i))
        return {"query_template": self.templates[k], "must": self.must, "must_not": self.must_not, "thresh": self.threshold(k), "exact_pairs": [p for p, ok in self.pairs.items() if ok], "non_matching_pairs": [p for p, ok in self.pairs.items() if not ok]}

    def to_json(self) -> dict:
        return {"pairs": [[s, r, ok] for (s, r), ok in self.pairs.items()], "must": self.must, "must_not": self.must_not, "targets": [self.target_precision, self.target_recall], "searches": self.searches}

    def load_json(self, state: dict) -> None:
        self.pairs = {(s, r): ok for s, r, ok in state["pairs"]}
        self.must, self.must_not, self.searches = state["must"], state["must_not"], state["searches"]
        self.target_precision, self.target_recall = state["targets"]
