"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm import mixing, packing, quality_rules, simhash, substring_dedup
from pluvia.llm.common import materialize


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` whose n_chars, if there is such a column, follows the text; null for null."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or cross-document line frequency reject go, and so do the common lines of the others.

    Null and empty texts are rejected; rows without a doc_id and repeated rows are judged like others. No rows give none.
    """
    return _measured(quality_rules.quality_rules(docs, whole=True).where("kept").select("row.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; rows without a doc_id stay, of repeated doc_ids one."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that earlier documents hold go; all rows stay, those without a doc_id unchanged."""
    return _measured(substring_dedup.without_repeats(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, none to three times; a null source is one like others."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in the sequences; a null text is its end mark alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("best_fit_packing", sequences),
]

#: Fingerprints, systematic sampling and tokens can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
