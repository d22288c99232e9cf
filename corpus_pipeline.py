"""Training corpus out of the documents table: five stages, each over all that its predecessor kept.

All stages take any rows: null ids, texts, sources and labels, empty and very long texts, repeated rows and ids, empty
tables (no rows out), and further columns of any name, which all but the last stage pass on unchanged. What a stage does
with such rows is said in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import exact_dedup, jaccard, mixing, packing, tokens, toxicity
from tidewright.llm.common import parts, stored, table

#: The stages learn, compare and optimise; SQL has no words for the first, the third and the last.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the toxicity model scores a half or more go. Null and empty texts have nothing toxic and stay; repeated
    rows are judged alike; long texts are read whole. Without labels of both kinds nothing goes."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of the smallest id stays, a null id only where no other has the text. Null counts as the
    empty text; of repeated rows one stays."""
    return exact_dedup.kept_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of near duplicates the text of the smallest id stays. Rows without an id stay, and so do null and
    empty texts and those without words, which are near to nothing; of an id with several texts all rows stay if one of
    them does. Ties can't be: ids decide."""
    found = jaccard.near_duplicates(docs).groupBy("doc_id").agg(F.bool_and(F.col("component_id") != F.col("doc_id")).alias("gone"))
    return docs.join(found.where("gone").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in mixing order: ranges of slots, sorted inside. No row goes; null sources are a source, null ids come in
    an order of their own, repeated rows stay as often as they are."""
    return mixing.in_order(docs, parts(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences in bins, packed and numbered along the order of the mix. Files don't keep that order
    (readers take them by size), so it is made again: slots depend on the rows alone. Null and empty texts are one token,
    long ones many pieces, repeated rows packed each."""
    return packing.pack(mixed(spark, docs, sf_dir), tokens.tokenizer_path())


STAGES = [("toxicity", without_toxic), ("exact_dedup", without_copies), ("ngram_jaccard", without_near_copies), ("source_mixing", mixed), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
