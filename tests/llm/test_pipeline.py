"""The pipeline's stages in a row, and over rows that are easy to get wrong."""

import corpus_pipeline
import pytest

from pyspark.sql import functions as F

from tidewright.llm import mixing, queries
from tidewright.llm.common import stored

from .test_operators import ODD, odd_rows


def test_stages_follow_each_other(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, data)
        assert out.columns == docs.columns, name
        assert out.join(seen, "doc_id", "left_anti").count() == 0 and out.count() <= seen.count()
        seen = spark.createDataFrame(out.collect(), docs.schema)
    bins = corpus_pipeline.run(spark, data)
    assert {r[0] for r in bins.select("doc_id").distinct().collect()} == {r["doc_id"] for r in seen.collect()}


def test_bins_follow_the_mix_over_several_files(spark, data):
    n = F.col("id")
    source = F.when(n % 10 < 7, "hot").when(n % 10 < 9, "b").otherwise("c")
    docs = spark.range(3000).select(n.alias("doc_id"), F.repeat(F.lit("some words "), (n * 37 % 50 + 1).cast("int")).alias("text"), source.alias("source"))
    at = {r["doc_id"]: (r["mix_slot"], r["mix_rank"]) for r in mixing.mix(docs).collect()}
    rows, _ = stored(corpus_pipeline.mixed(spark, docs, data), "test-mix")
    assert len(rows.inputFiles()) > 1
    bins = {}
    for r in corpus_pipeline.packed(spark, rows, data).collect():
        bins.setdefault(r["bin_id"], []).append(at[r["doc_id"]])
    first = [min(bins[k]) for k in sorted(bins)]
    assert first == sorted(first) and sum(map(len, bins.values())) == 3000
    tasks = {}
    for k, found in bins.items():
        tasks.setdefault(k >> 40, []).extend(found)
    spans = [(min(tasks[k]), max(tasks[k])) for k in sorted(tasks)]
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_odd_rows(spark, data, name):
    stage, rows = dict(corpus_pipeline.STAGES)[name], odd_rows(spark)
    out = stage(spark, rows, data)
    if name in ("toxicity", "source_mixing"):
        assert out.count() == len(ODD)
    else:
        assert out.count() > 0
    assert stage(spark, rows.limit(0), data).count() == 0
    assert stage(spark, odd_rows(spark, [None, None, 4, 4, 4, 4, 4, 8, 8, 9, 9]), data).count() > 0


def test_all_queries_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
