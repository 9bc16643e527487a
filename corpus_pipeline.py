"""From raw documents to token ids: five operators in a row, each stage a table of its own.

All stages but the last return the columns of documents, whatever further ones there are and however
they are named. A null text is treated as an empty one, an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweft.llm import bm25_wand, bpe_tree, minhash_join, pii_semicrf, pu_quality
from skyweft.session import discard, materialize, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.

    A null or empty text is judged like any other. Repeated rows are judged alike, so all stay or go, and
    so do texts of equal scores. Without positive labels every score is 0.5, below the cut, and all go.
    """
    ship_package(spark)
    return pu_quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id, of equal ids and texts one row.

    Rows are judged by their texts, so rows that share an id but not the text do not stand for each other.
    Null and empty texts, and rows with a null doc_id, are no copies and stay.
    """
    ship_package(spark)
    return minhash_join.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts and items match nothing. Repeated rows are judged alike. Without items all stay.
    """
    ship_package(spark)
    return bm25_wand.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; every row stays, n_chars follows the new text; a null text stays null, with a null n_chars."""
    ship_package(spark)
    return pii_semicrf.mask_personal_data(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the bytes decoded from them.

    A null or empty text has no ids and the digests of no bytes; further columns are not returned.
    """
    ship_package(spark)
    return bpe_tree.encode_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("encode", encode)]

#: Learning, retrieval and encoding have no SQL form; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # what the next stage wrote is all that is needed
    return STAGES[-1][1](spark, docs, sf_dir)
