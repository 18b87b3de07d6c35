"""From raw documents to encoded training data, in stages that each work on what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clicktide.llm import bpe, jaccard_join, mixing, quality_gam, quality_rules
from clicktide.llm.queries import BYTE_BPE
from clicktide.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules.keep_good(docs)


def good_score(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled documents of the table."""
    everything = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_gam.train(everything, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gam.keep_good(docs, model)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document's text."""
    return bpe.encode(docs, BYTE_BPE)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_rules),
    ("quality classifier", good_score),
    ("n-gram Jaccard join", different),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]

# The stages in Python can't be written in SQL; a test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
