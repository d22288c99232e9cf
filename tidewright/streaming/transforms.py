"""Fixed-parameter steps over streams: both are stateless row maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import missing


def replace_stream(stream: DataFrame, params: dict) -> DataFrame:
    return missing.replace(stream, params)


def modified_by_window(stream: DataFrame, time_col: str, flag: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Modified cells of a column for each window of event time; rows later than the watermark are left out."""
    w = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).groupBy(F.window(time_col, window))
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("long")).alias("n_modified")).select("window.start", "n", "n_modified")
