"""A cleaning pipeline over ``documents``: five stages, each by one operator of ``graphloom.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import line_dedup, minhash, mixture, pieces, quality
from graphloom.sources.scratch import materialize
from graphloom.sources.session import prepare


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.7 or more)."""
    prepare(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line, short lines by exact copies only; those left without any text go."""
    prepare(spark)
    return line_dedup.without_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked at a similarity of 0.8; that of the smallest id.

    With 38 bands of 5 a pair at 0.8 is missed with a probability of 3e-7.
    """
    prepare(spark)
    return minhash.without_near_duplicates(docs, num=80, bands=38, rows=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at equal weights in as many documents as there are, in a random order."""
    prepare(spark)
    return mixture.mix_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each document."""
    prepare(spark)
    return pieces.encode_documents(docs)


STAGES = [("quality", accept_quality), ("lines", dedup_lines), ("near_duplicates", dedup_documents), ("mixture", mix), ("encode", encode)]

#: Hashed features and piece models have no SQL; tests hold each stage's rows, and run(), against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
