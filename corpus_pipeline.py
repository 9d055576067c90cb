"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``gridtempo.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of
documents. ``run`` applies them in order. Their results aren't expressible in SQL (fingerprints, forests, hash seeds), so there is no
oracle; tests hold small runs against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridtempo.llm import decontamination, jaccard, mixing, quality, sharding
from gridtempo.llm._shared import checkpoint


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles of Jaccard similarity 0.8 or more."""
    return jaccard.dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.remix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return sharding.sharded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
