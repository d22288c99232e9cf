"""Joins of text columns: bounded edit distance, token windows, variants, composite keys, zips by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key_of, stripped, token_score

#: Rows of the small side up to which it is broadcast; beyond it the join shuffles by deletion variants or windows.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def deletions(c: Column | str) -> Column:
    """The text and every text with one or two characters taken out."""
    s = F.col(c) if isinstance(c, str) else c

    def without_one(x: Column) -> Column:
        at = F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))

    one = without_one(s)
    return F.array_distinct(F.concat(F.array(s), one, F.flatten(F.transform(one, without_one))))


def edit_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, most: int = 2) -> DataFrame:
    """Pairs of distinct texts at an edit distance of at most two: (left_col, right_col, distance).

    Pairs at that distance share a text with at most two characters taken out. These variants are equi-joined and the
    distance is computed for the pairs that meet; no pair of texts is compared that shares none.
    """
    if most > 2:
        raise ValueError("the deletion index reaches two edits")
    a = left.select(F.col(left_col).alias("_l")).where("_l is not null").distinct().select("_l", F.explode(deletions("_l")).alias("_k"))
    b = right.select(F.col(right_col).alias("_r")).where("_r is not null").distinct().select("_r", F.explode(deletions("_r")).alias("_k"))
    met = a.join(b, "_k").select("_l", "_r").distinct()
    out = met.withColumn("distance", F.levenshtein("_l", "_r", most)).where("distance >= 0")
    return out.select(F.col("_l").alias(left_col), F.col("_r").alias(right_col), "distance")


def windows(words: Column, longest: int) -> Column:
    """All runs of 1 to longest words as (phrase, k, pos)."""
    def of(k: int) -> Column:
        at = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i + 1, k), " ").alias("phrase"), F.lit(k).alias("k"), i.alias("pos")))

    return F.flatten(F.array(*[of(k) for k in range(longest, 0, -1)]))


def phrase_windows(texts: DataFrame, words: Column, phrases: DataFrame, longest: int, first_only: bool = True) -> DataFrame:
    """Rows of texts with the phrase that a window of their words equals: longest window first, then the leftmost.

    phrases: (phrase, type). Adds phrase, type, k, pos. With first_only=False every match is a row.
    """
    cols = texts.columns
    hits = texts.withColumn("_words", words).select(*cols, F.inline(windows(F.col("_words"), longest))).join(phrases, "phrase")
    if not first_only:
        return hits
    w = Window.partitionBy(*cols, "type").orderBy(F.desc("k"), "pos", "phrase")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def phrase_scores(hits: DataFrame, words: Column, text: str) -> DataFrame:
    """Adds score: the share of the reference phrase that is matched if enough of text is."""
    n, chars = F.size(words), F.length(F.array_join(words, " "))
    matched = F.length("phrase")
    return hits.withColumn("score", token_score(n, F.col("k"), chars, matched, matched))


def variants_of(rows: DataFrame, keep: str = "unambiguous") -> DataFrame:
    """(variant, main) from rows of an array `forms` whose first entry is the main form.

    keep='first' takes, of several mains, the one of the first row (by `line`); 'unambiguous' drops such variants.
    Mains that are variants of another row's main are followed one step.
    """
    flat = rows.select("line", F.expr("stripped_forms[0]").alias("main"), F.explode("stripped_forms").alias("variant")) if "stripped_forms" in rows.columns else rows.withColumn("stripped_forms", F.filter(F.transform("forms", lambda x: F.lower(stripped(x))), lambda x: x != "")).where("size(stripped_forms) > 0").select("line", F.expr("stripped_forms[0]").alias("main"), F.explode("stripped_forms").alias("variant"))
    by = flat.groupBy("variant").agg(F.min(F.struct("line", "main")).alias("first"), F.count_distinct("main").alias("n"))
    out = by.where("n = 1") if keep == "unambiguous" else by
    out = out.select("variant", F.col("first.main").alias("main"))
    chain = out.select(F.col("variant").alias("main"), F.col("main").alias("of"))
    return out.join(chain, "main", "left").select("variant", F.coalesce("of", "main").alias("main"))


def expand_variants(texts: DataFrame, words: Column, variants: DataFrame, longest: int) -> DataFrame:
    """Rows of texts with each main form whose variant a window of their words equals, and whether it covers the text."""
    hits = phrase_windows(texts.withColumn("_n_words", F.size(words)), words, variants.select(F.col("variant").alias("phrase"), F.col("main").alias("type")), longest, first_only=False)
    return hits.select(*texts.columns, F.col("phrase").alias("variant"), F.col("type").alias("main"), ((F.col("pos") == 0) & (F.col("k") == F.col("_n_words"))).alias("full")).distinct()


def dictionary_join(cells: DataFrame, key: Column, lexicon: DataFrame) -> DataFrame:
    """Cells whose key equals a label's: adds type and hits (sorted labels). lexicon: (type, key, label)."""
    grouped = lexicon.groupBy("type", "key").agg(F.array_sort(F.collect_set("label")).alias("hits"))
    grouped = F.broadcast(grouped) if small(grouped) else grouped
    return cells.withColumn("key", key).join(grouped, "key").drop("key")


def exact_link(source: DataFrame, ref: DataFrame, pairs: list[tuple[list[str], list[str]]], how: str = "inner", sep: str = " ") -> DataFrame:
    """Equi-join by composite normalized keys, one for each pair of column lists; ref columns get `__REF`.

    A null key never matches. how='left' keeps source rows without a match.
    """
    if not pairs:
        raise ValueError("at least one pair of columns is asked for")
    names = [f"_k{i}" for i in range(len(pairs))]
    a = source.select("*", *[key_of(s, sep).alias(k) for k, (s, _) in zip(names, pairs, strict=True)])
    b = ref.select(*[F.col(c).alias(f"{c}__REF") for c in ref.columns], *[key_of(r, sep).alias(k) for k, (_, r) in zip(names, pairs, strict=True)])
    return a.join(b, names, how).drop(*names)


def zip_rows(original: DataFrame, changed: DataFrame, row_id: str = "row_id", suffix: str = "__NORMALIZED") -> DataFrame:
    """Original columns, each followed by what was made of it, joined by row id (never by position)."""
    own = [c for c in original.columns if c != row_id]
    made = {c: (c if "__" in c else f"{c}{suffix}") for c in changed.columns if c != row_id}
    b = changed.select(F.col(row_id), *[F.col(c).alias(f"_n_{n}") for c, n in made.items()])
    order = [row_id]
    for c in own:
        order += [c, *[n for n in made.values() if n.startswith(f"{c}__")]]
    joined = original.join(b, row_id, "left")
    return joined.select(*[F.col(c) if c in original.columns else F.col(f"_n_{c}").alias(c) for c in order])


def co_occurring(tops: DataFrame) -> DataFrame:
    """Values among the most frequent of two columns or more: (val, n_cols)."""
    return tops.groupBy("val").agg(F.count_distinct("col").alias("n_cols")).where("n_cols >= 2")


def orphans(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows whose key has no row in other."""
    return df.join(other.select(F.col(other_key).alias("_ok")), F.col(key) == F.col("_ok"), "left_anti")
