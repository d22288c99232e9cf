"""Exact deduplication: 128-bit content hash, smallest (or largest) stable id, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tune

#: Tasks that share the texts of one hash while its bytes are compared.
SALTS = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256. DataFrame functions only.

    The light pass groups (id, md5) without texts, pre-aggregated before its shuffle. Only texts of hashes that
    occur more than once travel: their least and greatest text must be the same bytes. Hashes for which they are
    not (a collision) are grouped once more by the text itself, so the result never rests on the hash.
    Hot groups: the sums combine on the map side, texts of a hash are compared in SALTS parts, and the joins are split by
    adaptive execution.

    Null text counts as empty. A null id never wins against another id; where all ids of a group are null keep_id
    is null. Of several rows with the kept id one stays. An empty table gives no rows. Other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    tune(docs.sparkSession)
    best = F.min if keep == "min" else F.max
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_h", F.unhex(F.md5("_text")))
    # stored, so that the join at the end is one of two plain shuffles, whose hot keys Spark splits
    groups, _ = stored(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep")), "groups")
    several = groups.where("_n > 1").select("_h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    bytes_in = rows.select("_h", salt.alias("_salt"), "_text").join(several, ["_h", "_salt"], "left_semi")
    for keys in (["_h", "_salt"], ["_h"]):
        low, high = ("_text", "_text") if "_salt" in keys else ("_lo", "_hi")
        bytes_in = bytes_in.groupBy(*keys).agg(F.min(low).alias("_lo"), F.max(high).alias("_hi"))
    collided, _ = stored(bytes_in.where("_lo != _hi").select("_h"), "collided")
    found = rows.select("_id", "_h", F.sha2("_text", 256).alias("text_sha256")).join(groups, "_h")
    if collided.limit(1).count():
        odd = rows.join(collided, "_h", "left_semi")
        odd_groups = odd.groupBy("_text").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep"))
        again = odd.join(odd_groups, "_text").select("_id", "_h", F.sha2("_text", 256).alias("text_sha256"), "_n", "_keep")
        found = found.join(collided, "_h", "left_anti").unionByName(again)
    # of repeated rows with the kept id only one is kept
    winners = found.where(F.col("_id").eqNullSafe(F.col("_keep")))
    others = found.where(~F.col("_id").eqNullSafe(F.col("_keep"))).withColumn("kept", F.lit(False))
    first = F.row_number().over(Window.partitionBy("text_sha256", "_id").orderBy("_h"))
    winners = winners.withColumn("kept", first == 1)
    return winners.unionByName(others).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), "kept", "text_sha256"
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; of repeated rows one stays.

    Where ids are unique and not null, the dropped ids leave by an anti join, which moves texts once; else rows are
    told apart by id and content, and repeated ones are numbered.
    """
    found = exact_dedup(docs, id_col, text_col, keep)
    twice = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where(F.col(id_col).isNull() | (F.col("_n") > 1))
    if not twice.limit(1).count():
        return docs.join(found.where("not kept").select(id_col), id_col, "left_anti").select(*docs.columns)
    kept = found.where("kept").select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_kid"), F.col("text_sha256").alias("_ksha"))
    keyed = docs.withColumn("_kid", F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).withColumn("_ksha", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    joined = keyed.join(kept, ["_kid", "_ksha"], "left_semi")
    first = F.row_number().over(Window.partitionBy("_kid", "_ksha").orderBy(*[F.col(c) for c in docs.columns if c not in (id_col, text_col)] or [F.lit(1)]))
    return joined.withColumn("_nth", first).where("_nth = 1").select(*docs.columns)
