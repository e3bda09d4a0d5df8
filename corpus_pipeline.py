"""A corpus pipeline of the operators in ``sitegrade.llm``, one stage after the other.

Every stage works on all that its predecessor kept and returns the columns of ``documents``, but for
the last, which returns packed pieces. Each result is written as Parquet into the shared folder and
read back, so a lost executor repeats at most part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegrade.llm import decontaminate, exact_dedup, language, packing, simhash
from sitegrade.llm.shared import cut


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language stays undetermined."""
    return language.keep_accepted(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space keep the longest, then the one of smallest id."""
    return exact_dedup.keep_one(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the document of smallest id."""
    return simhash.keep_one(docs, shingle=3, radius=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a twentieth or more of benchmark passages."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences: one row per piece of a document."""
    return packing.pack_documents(docs)


STAGES = [
    ("language id", language_stage),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

# Fingerprints, language models and packing can't be expressed in SQL; tests hold every stage and
# the whole against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage_{i}")
    return docs
