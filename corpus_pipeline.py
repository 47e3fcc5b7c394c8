"""From raw documents to packed sequences: quality rules, one of each near copy, secrets masked, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet in the shared
folder and reads it back for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise.llm import jaccard, linequality, packing, secrets
from kerbwise.llm.queries import repository, ship
from kerbwise.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their lines above the limit."""
    return linequality.clean(docs, F.col("source"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links reach."""
    ship(spark)
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    ship(spark)
    return secrets.redact(docs, F.col("source"), repository())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("quality rules", quality_rules), ("near copies", near_copies), ("secret scan", secret_scan), ("packing", pack)]

#: SQL cannot tokenise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
