"""Values to the normal form of their column's type, with a flag for each changed cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import valid_phrase
from .column_types import cells_of, expression_hits, label_hits, lexicon_table, matchers

#: Distinct values of a normalized cell at most.
MAX_VALUES = 3


def normal_values(df: DataFrame, types: dict[str, str], row_id: str = "row_id", lexicon: DataFrame | None = None, keep_numeric: bool = True) -> DataFrame:
    """(row_id, col, value): up to three distinct hits of the column's type, sorted and joined by commas.

    keep_numeric=False leaves out hits without a valid word, so numbers and dates stay as they were.
    """
    cells = cells_of(df, list(types), row_id)
    hits = expression_hits(cells, matchers(2)).where("not negates").select("row_id", "col", "type", "hit")
    if lexicon is not None:
        hits = hits.unionByName(label_hits(cells, lexicon_table(lexicon)).select("row_id", "col", "type", "hit"))
    trusted = F.create_map(*[x for c, t in types.items() for x in (F.lit(c), F.lit(t))])
    hits = hits.where(F.col("type") == trusted[F.col("col")])
    if not keep_numeric:
        hits = hits.where(valid_phrase("hit").isNotNull())
    return hits.groupBy("row_id", "col").agg(F.array_join(F.slice(F.array_sort(F.collect_set("hit")), 1, MAX_VALUES), ", ").alias("value"))


def recode(df: DataFrame, types: dict[str, str], row_id: str = "row_id", lexicon: DataFrame | None = None, keep_numeric: bool = True) -> DataFrame:
    """df with typed columns in normal form and `column__MODIFIED` flags; null stays null and unflagged."""
    values = normal_values(df, types, row_id, lexicon, keep_numeric)
    wide = values.groupBy(F.col("row_id").alias(row_id)).agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(f"_new_{c}") for c in types])
    joined = df.join(wide, row_id, "left")
    out = []
    for c in df.columns:
        if c not in types:
            if c.removesuffix("__MODIFIED") not in types:
                out.append(F.col(c))
            continue
        new = F.when(F.col(c).isNotNull(), F.coalesce(F.col(f"_new_{c}"), F.col(c).cast("string")))
        before = F.coalesce(F.col(f"{c}__MODIFIED"), F.lit(False)) if f"{c}__MODIFIED" in df.columns else F.lit(False)
        out += [new.alias(c), (before | ~new.eqNullSafe(F.col(c).cast("string"))).alias(f"{c}__MODIFIED")]
    return joined.select(*out)


def enrich(df: DataFrame, types: dict[str, str], row_id: str = "row_id", lexicon: DataFrame | None = None) -> DataFrame:
    """df with further columns `++column++` instead of changed ones."""
    values = normal_values(df, types, row_id, lexicon)
    wide = values.groupBy(F.col("row_id").alias(row_id)).agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(f"++{c}++") for c in types])
    return df.join(wide, row_id, "left")
