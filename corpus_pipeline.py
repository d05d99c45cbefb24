"""The corpus pipeline: documents to packed training sequences in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickforge.llm import cutting_stock, host_quality, line_spread, oph_dedup, secret_scan
from tickforge.llm.common import staged, table
from tickforge.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their host's verdict keep."""
    ship_package(spark)
    return host_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of many sources removed; no document goes."""
    ship_package(spark)
    return line_spread.remove(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    ship_package(spark)
    return oph_dedup.keep_first(docs)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced in the texts; no document goes."""
    ship_package(spark)
    return secret_scan.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    ship_package(spark)
    return cutting_stock.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("secret scan", secret_removal),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokens and near-duplicate components are beyond SQL.
ORACLE_SQL = None
