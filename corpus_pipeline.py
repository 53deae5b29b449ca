"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir). ``run`` writes what a stage returns as Parquet to the shared
folder and gives the next stage that table. All stages but the last return the columns of documents,
whatever else the table has.

Null texts count as empty and null ids as ids below all others (in ``near_copies`` as the last
choice). Rows that repeat an id are documents of their own unless their texts are copies too. An
empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm import common, exact_packing, extendible_dedup, pii_boost, subword_classifier, tensor_minhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return subword_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return extendible_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words and a similarity of 0.8 the least id stays."""
    return tensor_minhash.drop_near_copies(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; ``n_chars`` follows the new text."""
    done = pii_boost.redact_rows(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    import public_tokenizers

    return exact_packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", packing)]

#: SQL can't express the classifier or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
