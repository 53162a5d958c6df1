"""Documents to mixed, encoded training data: the stages in order, each over all its predecessor kept.

Quality classifier, near-duplicates by SimHash and by sets of shingles, benchmark decontamination, source mixing, token files. Every stage
but the last returns the columns of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorebook.llm import decontam, mixing, neardup, quality, tokens
from scorebook.llm.common import staged


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: SimHash fingerprints within two bits, or shingles alike."""
    return neardup.representatives(docs, fingerprints=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix takes, repeats as rows of their own."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the token files."""
    return tokens.round_trip(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("source mixing", mixed_sources),
    ("token output", token_files),
]
#: Learned scores, groups of near-duplicates and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
