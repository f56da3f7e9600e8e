"""A corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the
columns of `documents`; the last returns one row for each document that was written to token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import ans, decontam, langid, mixing, simhash
from shardloom.llm._common import materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return langid.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.stage(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontam.stage(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources reach their target shares."""
    return mixing.stage(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written and read back."""
    return ans.stage(docs)


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("decontamination", decontaminate), ("source_mixing", mix), ("token_files", token_files)]

#: SQL can express neither a trained network nor the coder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
