"""From documents to packed training sequences, in five stages, each written as Parquet in the shared folder and read again.

quality: documents that the rules reject go. toxicity: so do those with a score of 0.7 or more. near_dedup: of each class of near-duplicates the document
with the smallest id stays. substring_dedup: passages of 13 words that an earlier document has are cut out; every document stays.
packing: the last stage, one row per piece of a document in a sequence.

All stages but the last keep all columns, whatever their names. Null and empty texts have under 50 words, so the quality stage drops them; a null doc_id stays null, is above all others, and
rows without ids are told apart by their texts. Very long texts are handled whole. Of rows that are alike one stays in near_dedup. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import base, neardup, packing, passages, quality, toxicity
from tarn.llm.queries import table, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on the labelled documents that are left."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = passages.without_passages(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(packing.VOCABULARY))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("packing", packing_stage),
]
#: SQL can't express the stages; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_on(spark, table(spark, sf_dir, "documents"), sf_dir)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over some documents. What a stage wrote goes once the next one has been written; the last table goes when the application ends."""
    scratch = base.Scratch(spark, "pipeline")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
