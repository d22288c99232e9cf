"""The queries over the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import missing
from . import q_link, q_missing, q_tables, q_text, q_types

MODULES = (q_link, q_missing, q_tables, q_text, q_types)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top values of two columns of documents with the score that each has as a form of missing."""
    top = missing.top_values(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["lang", "source"])
    return top.join(missing.scored(missing.rules(top)), ["col", "val"], "left")
