"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing. Counted as part of graphloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import fresh_path, table
from graphloom.llm.exact_dedup import exact_dedup_filter
from graphloom.llm.mixing import mixing_resample
from graphloom.llm.near_copies import near_filter
from graphloom.llm.packing import pack
from graphloom.llm.registry import tokenizer_path
from graphloom.llm.toxicity import toxicity_filter


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below one half stay."""
    return toxicity_filter(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup_filter(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard similarity from 0.8) stays.

    The SimHash operator's covering joins the closest; bands find those that no fingerprint can.
    """
    return near_filter(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped by their fitted rates."""
    return mixing_resample(docs, table(spark, sf_dir, "labels"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the fitted models of the stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None
