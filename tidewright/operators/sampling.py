"""Samples, small tables and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values
SAMPLE_ROWS, MINI_ROWS, TYPE_ROWS, LABEL_ROWS = 50, 2999, 30, 3000
# end of fixed values


def sample(df: DataFrame, row_id: str, n: int = SAMPLE_ROWS, random: bool = False, seed: int = 0, distinct: bool = False, first_rows: int | None = None) -> DataFrame:
    """n rows: the first by row id, or those of least seeded hash of the id (the same for any partitioning)."""
    rows = df.where(F.col(row_id) < first_rows) if first_rows is not None else df
    if distinct:
        rows = rows.groupBy(*[c for c in df.columns if c != row_id]).agg(F.min(row_id).alias(row_id)).select(*df.columns)
    order = F.xxhash64(F.col(row_id), F.lit(seed)) if random else F.col(row_id)
    return rows.orderBy(order, row_id).limit(n)


def types_sample(df: DataFrame, row_id: str) -> DataFrame:
    """The rows that are shown beside inferred types: the first TYPE_ROWS."""
    return sample(df, row_id, TYPE_ROWS)


def mini(df: DataFrame, row_id: str, n: int = MINI_ROWS, random: bool = False, seed: int = 0) -> DataFrame | None:
    """A small table to try steps on; None if df isn't larger than it."""
    return sample(df, row_id, n, random, seed) if df.limit(n + 1).count() > n else None


def page_by_id(df: DataFrame, row_id: str, start: int, size: int, descending: bool = False) -> DataFrame:
    """Rows start to start + size by id, or the same places from the end."""
    if descending:
        last = df.agg(F.max(row_id)).first()[0]
        return df.where(F.col(row_id).between(last - start - size + 1, last - start)).orderBy(F.desc(row_id))
    return df.where(F.col(row_id).between(start, start + size - 1)).orderBy(row_id)


def page_sorted(df: DataFrame, by: str, row_id: str, start: int, size: int, descending: bool = False) -> DataFrame:
    """A page in order of a column: nulls first when ascending, last when descending; ties by row id."""
    return df.orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_first(by), row_id).offset(start).limit(size)
