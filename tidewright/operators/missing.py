"""Missing values: candidates from the most frequent values of each column, and their replacement.

One unpivot and one aggregation serve all columns; the rules run over at most top_n values of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinct_chars, is_numeric, is_punctuation

# fixed values
USUAL_FORMS = ("nan", "none", "na", "n/a", "\\n", " ", "non renseigne", "nr", "no value", "null", "missing value")
ALWAYS = ("",)
# end of fixed values
THRESHOLD, TOP_VALUES, LENGTH_RATIO, ALWAYS_SCORE = 0.6, 10, 2.9, 1000.0
ALL = "all"


def unpivot(df: DataFrame, columns: list[str], name: str = "col", value: str = "val", ids: list[str] | None = None) -> DataFrame:
    """(ids, column name, value as text)."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in columns])
    return df.select(*(ids or []), F.inline(cells))


def top_values(df: DataFrame, columns: list[str], top_n: int = TOP_VALUES) -> DataFrame:
    return top_of(unpivot(df, columns), top_n)


def top_of(cells: DataFrame, top_n: int = TOP_VALUES) -> DataFrame:
    """(col, val, n, share, rank): the top_n values of each column of (col, val), nulls aside, ties by value."""
    counted = cells.where("val is not null").groupBy("col", "val").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "val")))
    total = counted.groupBy("col").agg(F.sum("n").alias("total"))
    return ranked.where(F.col("rank") <= top_n).join(F.broadcast(total), "col").select("col", "val", "n", (F.col("n") / F.col("total")).alias("share"), "rank")


def rules(top: DataFrame, usual: tuple[str, ...] = (), always: tuple[str, ...] = ()) -> DataFrame:
    """(col, val, score, origin) of each rule that a top value meets; columns of one single value are left out."""
    w = Window.partitionBy("col")
    length, chars = F.length("val"), distinct_chars("val")
    t = (
        top.withColumn("len", length).withColumn("chars", chars).withColumn("digits", is_numeric("val")).withColumn("punct", is_punctuation("val"))
        .withColumn("n_vals", F.count(F.lit(1)).over(w)).withColumn("top_share", F.max("share").over(w)).where("top_share < 1")
        .withColumn("same_len", F.count(F.lit(1)).over(Window.partitionBy("col", "len")))
        .withColumn("n_lens", F.size(F.collect_set("len").over(w)))
        .withColumn("least_same", F.min("same_len").over(w))
        .withColumn("by_len", F.row_number().over(w.orderBy("len", "val"))).withColumn("next_len", F.lead("len").over(w.orderBy("len", "val")))
        .withColumn("by_chars", F.row_number().over(w.orderBy("chars", "val"))).withColumn("next_chars", F.lead("chars").over(w.orderBy("chars", "val")))
        .withColumn("n_words", F.sum((~F.col("digits")).cast("int")).over(w)).withColumn("n_punct", F.sum(F.col("punct").cast("int")).over(w))
    )

    def rule(when: Column, score: Column | float, origin: str) -> Column:
        return F.when(when, F.struct((score if isinstance(score, Column) else F.lit(score)).cast("double").alias("score"), F.lit(origin).alias("origin")))

    met = F.array(
        rule((F.col("n_vals") >= 4) & (F.col("n_lens") == 2) & (F.col("least_same") == 1) & (F.col("same_len") == 1), 0.3, "diff"),
        rule((F.col("n_vals") >= 4) & (F.col("by_len") == 1) & (LENGTH_RATIO * F.col("len") < F.col("next_len")), 0.2, "len_ratio"),
        rule((F.col("n_vals") >= 3) & (F.col("n_words") == 1) & ~F.col("digits") & F.col("val").rlike(r"^\p{L}+$"), F.when(F.col("n_vals") >= 4, 1.0).otherwise(0.5), "not_digit"),
        rule((F.col("n_punct") == 1) & F.col("punct"), 1.0, "punctuation"),
        rule(F.lower("val").isin(*USUAL_FORMS, *(x.lower() for x in usual)), 0.5, "usual"),
        rule(F.col("val").isin(*ALWAYS, *always), ALWAYS_SCORE, "usual"),
        rule((F.col("n_vals") >= 3) & (F.col("by_chars") == 1) & (F.col("len") > 1) & (F.col("chars") == 1) & (F.col("next_chars") >= 2), 0.7, "letter_repeted"),
    )
    return t.select("col", "val", F.explode(F.array_compact(met)).alias("m")).select("col", "val", "m.score", "m.origin")


def scored(found: DataFrame) -> DataFrame:
    """(col, val, score, origin): scores of a value added up, its rules sorted and joined by commas."""
    return found.groupBy("col", "val").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_list("origin")), ",").alias("origin"))


def infer(df: DataFrame, columns: list[str] | None = None, top_n: int = TOP_VALUES, usual: tuple[str, ...] = (), always: tuple[str, ...] = ()) -> DataFrame:
    columns = [c for c in columns or df.columns if "__MODIFIED" not in c]
    return scored(rules(top_values(df, columns, top_n), usual, always))


def common(candidates: DataFrame) -> DataFrame:
    """Candidates of two columns or more: values to replace everywhere, score 1."""
    return candidates.groupBy("val").agg(F.count_distinct("col").alias("n_cols")).where("n_cols >= 2").select("val", F.lit(1.0).alias("score"), "n_cols")


def params(candidates: DataFrame, threshold: float = THRESHOLD) -> dict:
    """What replace takes, out of at most top_n candidates of each column."""
    columns: dict[str, list[dict]] = {}
    for r in candidates.orderBy("col", F.desc("score"), "val").collect():
        columns.setdefault(r["col"], []).append({"val": r["val"], "score": r["score"], "origin": r["origin"].split(",")})
    everywhere = [{"val": r["val"], "score": r["score"]} for r in common(candidates).orderBy("val").collect()]
    return {"mvs_dict": {"all": everywhere, "columns": columns}, "thresh": threshold}


def _values(found: list[dict], threshold: float) -> list[str]:
    return [v["val"] for v in found if v["score"] >= threshold]


def replace(df: DataFrame, p: dict) -> DataFrame:
    """Null for each value of the parameters that reaches the threshold, and `column__MODIFIED` flags beside.

    A row map with fixed parameters: it works on streams too. Flags that the table has are or-ed.
    """
    threshold, mvs = p["thresh"], p["mvs_dict"]
    named = [c for c in df.columns if "__" not in c]
    out = []
    for c in df.columns:
        if c not in named:
            if c.removesuffix("__MODIFIED") not in named:
                out.append(F.col(c))
            continue
        values = sorted({*_values(mvs.get(ALL, []), threshold), *_values(mvs.get("columns", {}).get(c, []), threshold)})
        hit = F.coalesce(F.col(c).cast("string").isin(*values), F.lit(False)) if values else F.lit(False)
        before = F.coalesce(F.col(f"{c}__MODIFIED"), F.lit(False)) if f"{c}__MODIFIED" in df.columns else F.lit(False)
        out += [F.when(~hit, F.col(c)).alias(c) if values else F.col(c), (hit | before).alias(f"{c}__MODIFIED")]
    return df.select(*out)


def run_sample(df: DataFrame, candidates: dict[str, list[str]], row_id: str, per_value: int = 4, chunk: int = 100_000) -> DataFrame:
    """(col, val, row_id): up to per_value rows at which a run of a candidate begins (the first row counts).

    Runs go in order of the row ids. Rows are compared with the one before inside chunks of ids; only the last row of
    each chunk travels further, so no task sorts the table.
    """
    pairs = [(c, v) for c, found in candidates.items() for v in found]
    flags = [F.coalesce(F.col(c).cast("string") == v, F.lit(False)).alias(f"f{i}") for i, (c, v) in enumerate(pairs)]
    rows = df.select(F.col(row_id).alias("row_id"), F.floor(F.col(row_id) / chunk).alias("chunk"), F.array(*flags).alias("is"))
    inside = Window.partitionBy("chunk").orderBy("row_id")
    last = rows.groupBy("chunk").agg(F.max_by("is", "row_id").alias("is"))
    before = last.select("chunk", F.lag("is").over(Window.orderBy("chunk")).alias("before"))
    rows = rows.withColumn("was", F.lag("is").over(inside)).join(before, "chunk")
    was = F.coalesce("was", "before")
    begins = F.zip_with("is", F.coalesce(was, F.transform("is", lambda x: F.lit(False))), lambda x, y: x & ~y)
    named = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(v).alias("val")) for c, v in pairs])
    found = rows.select("row_id", F.inline(F.transform(F.filter(F.arrays_zip(named.alias("pair"), begins.alias("begins")), lambda x: x["begins"]), lambda x: x["pair"])))
    nth = F.row_number().over(Window.partitionBy("col", "val").orderBy("row_id"))
    return found.withColumn("n", nth).where(F.col("n") <= per_value).select("col", "val", "row_id")


def modified_counts(df: DataFrame) -> DataFrame:
    """(col, n_modified) of each flag column."""
    flags = [c for c in df.columns if c.endswith("__MODIFIED")]
    sums = df.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in flags])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c.removesuffix("__MODIFIED")).alias("col"), F.coalesce(F.col(c), F.lit(0)).alias("n_modified")) for c in flags])))
