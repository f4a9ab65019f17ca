"""The corpus pipeline: documents to a mixed and sharded corpus, in five stages.

Each stage is written as Parquet and read again as the next one's documents. All but the last return the columns of documents.
A stage takes any number of rows, none included, and keeps extra columns; how it treats nulls, ties and repeated rows is told by
its operator. Quality labels come from ``labels`` beside the documents: those whose crc32(doc_id) modulo 5 is not 0, as in op10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontamination, mixing, quality, sharding, simhash
from lodestar.llm.common import materialize
from lodestar.llm.labelled import remainder


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 5) != 0)
    return quality.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target takes them."""
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a shard from 0 to 15 and a slot in it."""
    return sharding.sharded(docs, 16)


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

#: SQL can't express the trained classifier, nor XXH64; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
