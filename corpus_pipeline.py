"""The corpus pipeline: language, exact and near duplicates, source mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import language, mixing, pieces, polyhash, simhash
from sluice.llm.common import fresh


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned; ``lang`` is the one their text is in, ``und`` ones go."""
    return language.identified(docs, label="lang")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest doc_id."""
    return polyhash.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts alike by 0.8 and more over five-word shingles, the one with the smallest doc_id."""
    return simhash.distinct(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of the sources takes it."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row, with its source and language."""
    found = pieces.encoded(docs, keep=("source", "lang"))
    return found.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_pieces"), "n_chars", "lossless")


STAGES = [
    ("language", language_stage),
    ("exact-dedup", exact_stage),
    ("near-dedup", near_stage),
    ("mix", mix_stage),
    ("pieces", token_stage),
]

#: language model, fingerprints and pieces have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
