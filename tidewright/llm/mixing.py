"""Mixing sources to target weights: Pfair windows for the blocks of each source, earliest deadline first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, stored, tune

#: Rows of a block; rows of a bucket inside which rows are numbered.
BLOCK_ROWS, BUCKET_ROWS = 64, 4096
#: Slots that are scheduled in one step; slots of a period that may be broadcast.
STEP, BROADCAST_SLOTS = 2000, 200_000
#: Slots of a period are shared out in so many parts.
PARTS = 1000
#: The columns that mix adds.
ADDED = ("mix_source", "mix_block", "mix_rank", "mix_slot")


def schedule(weights: DataFrame) -> DataFrame:
    """(source, weight, integers of 1 or more) to one row per source: source, a, q, slots (of a period of q slots).

    With w = a / q, block k (from 0) of a source is released at slot floor(k / w) and due before ceil((k + 1) / w).
    At each slot the released block of the earliest deadline runs, ties in order of the sources. As the weights add
    up to one, one block is always ready and no deadline is missed: in every prefix each source is less than one
    block away from its share. After q slots all are exactly even, so the period repeats.

    Weights are divided by what they have in common. Each step schedules STEP slots in SQL from the blocks that each
    source has had, and is written to the shared folder, so a period of any length and any number of sources works; a
    step takes the time of its slots times the sources, and one row of the sources' memory.
    """
    spark = weights.sparkSession
    gcd = "aggregate(collect_list(cast(weight as bigint)), 0L, (x, y) -> aggregate(sequence(1, 100), struct(x as a, y as b), (p, i) -> if(p.b = 0, p, struct(p.b as a, p.a % p.b as b)), p -> p.a))"
    both = weights.agg(F.array_sort(F.collect_list(F.struct("source", F.col("weight").cast("bigint").alias("a")))).alias("s"), F.expr(gcd).alias("g"))
    both = both.where("size(s) > 0").select(F.expr("transform(s, x -> struct(x.source as source, x.a div g as a))").alias("s"))
    both = both.select("s", F.expr("aggregate(s, 0L, (t, x) -> t + x.a)").alias("q"), F.expr("transform(s, x -> 0L)").alias("c"), F.lit(0).cast("bigint").alias("t"))
    step = (
        f"aggregate(sequence(t, least(q, t + {STEP}) - 1), struct(c as c, cast(array() as array<int>) as o), (acc, t) ->"
        " element_at(transform(array(array_min(filter(transform(s, (x, i) -> if((acc.c[i] * q) div x.a <= t,"
        " struct(((acc.c[i] + 1L) * q + x.a - 1L) div x.a as d, i as i), null)), y -> y is not null)).i),"
        " k -> struct(transform(acc.c, (n, i) -> if(i = k, n + 1L, n)) as c, array_append(acc.o, k) as o)), 1))"
    )
    now, path = stored(both, "schedule")
    ran: DataFrame | None = None
    while True:
        done, done_path = stored(now.where("t < q").withColumn("ran", F.expr(step)).select("s", "q", F.col("ran.c").alias("c"), "t", F.col("ran.o").alias("o")), "schedule")
        drop(spark, path)
        ran = done if ran is None else ran.unionByName(done)
        if not done.where(f"t + {STEP} < q").limit(1).count():
            break
        now, path = stored(done.select("s", "q", "c", (F.col("t") + STEP).alias("t")), "schedule")
    slots = ran.select("s", "q", "t", F.posexplode("o").alias("nth", "i")).groupBy("i", "q", F.expr("s[i].source").alias("source"), F.expr("s[i].a").alias("a"))
    return slots.agg(F.array_sort(F.collect_list(F.col("t") + F.col("nth"))).alias("slots")).select("source", "a", "q", "slots")


def root_weights(counts: DataFrame) -> DataFrame:
    """(source, n) to (source, weight): weights go with the whole square root of n, in thousandths, 1 at least."""
    rooted = counts.select("source", F.floor(F.sqrt("n")).cast("bigint").alias("r"))
    return rooted.crossJoin(F.broadcast(rooted.agg(F.sum("r").alias("total")))).select("source", F.greatest(F.lit(1), F.expr(f"({PARTS} * r) div total")).cast("bigint").alias("weight"))


def _placed(docs: DataFrame, weights: DataFrame | None, id_col: str, source_col: str, block_rows: int) -> DataFrame:
    """(row, source, block, rank, slot): a row of docs as one value, so that no name of docs meets one of these."""
    tune(docs.sparkSession)
    n_buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = own["row"]
    key = F.conv(F.substring(F.md5(F.coalesce(row[id_col].cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")
    rows = own.withColumn("source", F.coalesce(row[source_col].cast("string"), F.lit(""))).withColumn("key", key).withColumn("bucket", F.col("key") % n_buckets)
    counts, _ = stored(rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n")
    totals = counts.groupBy("source").agg(F.sum("n").alias("n"))
    if weights is None:
        weights = root_weights(totals)
    else:
        given = weights.groupBy("source").agg(F.max(F.col("weight").cast("bigint")).alias("given"))
        weights = totals.join(given, "source", "left").select("source", F.greatest(F.lit(1), F.coalesce("given", F.lit(1))).alias("weight"))
    plan, _ = stored(schedule(weights), "mix-plan")
    n_slots = plan.agg(F.max("q")).first()[0] or 0
    nth = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", row[id_col])) - 1
    out = rows.withColumn("nth", nth).join(before, ["source", "bucket"]).join(F.broadcast(plan) if n_slots <= BROADCAST_SLOTS else plan, "source")
    at = F.col("before") + F.col("nth")
    out = out.withColumn("block", F.expr(f"(before + nth) div {block_rows}")).withColumn("rank", at % block_rows)
    return out.select("row", "source", "block", "rank", F.expr("(block div a) * q + slots[cast(block % a as int)]").alias("slot"))


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds mix_source, mix_block, mix_rank and mix_slot to each row; in the order of (mix_slot, mix_rank) the table is mixed.

    weights: (source, weight); sources without an entry get weight 1; by default root_weights. A source's rows are
    dealt to buckets by the hash of their id and numbered inside those, so a source of any size is numbered in many
    tasks; the buckets' counts give the rest. block_rows rows in that order are a block. When a source has no blocks
    left its slots stay empty and the others go on in their proportions. No row is dropped.

    Null ids and null sources are values of their own (source ''). Repeated rows are rows of their own; texts are not
    read. Columns of docs may have any names; those that mix adds replace columns of the same name. An empty table
    gives no rows. DataFrame functions only. The schedule is broadcast up to BROADCAST_SLOTS slots, joined beyond.
    """
    placed = _placed(docs, weights, id_col, source_col, block_rows)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ADDED]
    return placed.select(*kept, *[F.col(c.removeprefix("mix_")).alias(c) for c in ADDED])


def in_order(docs: DataFrame, n_parts: int, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of docs, all columns as they are, in the order of the mix: over n_parts ranges of slots, sorted inside."""
    placed = _placed(docs, weights, id_col, source_col, block_rows)
    return placed.repartitionByRange(n_parts, "slot", "rank").sortWithinPartitions("slot", "rank").select("row.*")
