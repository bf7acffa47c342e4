"""Training corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, mix, quality, shard, simhash
from quarry.llm.common import arrow_rows, checkpoint_dir, materialize
from quarry.session import table

N_SHARDS = 40
#: Rows of an Arrow batch between Spark and its Python workers. A session's own limit counts no bytes, and with thousands of
#: whole texts in a batch executors hold several copies of all of them at once.
BATCH = 500


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. The limit of a batch holds for jobs inside, so the rows are written here."""
    with arrow_rows(spark, BATCH):
        return materialize(quality.good_only(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    with arrow_rows(spark, BATCH):
        return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go; written here, as those of the classifier are."""
    with arrow_rows(spark, BATCH):
        return materialize(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, size, shard and slot."""
    return shard.shard(docs, N_SHARDS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: Fitted, hashed and iterative stages have no SQL form; tests/llm/test_queries.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written in the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    top = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
