"""Corpus pipeline over ``documents``: five stages, each an operator of ``cohort.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its
result is written as Parquet under the shared checkpoint folder and read again as the next
stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohort.llm import decontaminate, lines, mixing, neardup, quality
from cohort.llm.common import Scratch, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, quality.trusted_ids(spark, sf_dir))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut; a document of which no word is left goes."""
    return lines.without_repeats(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with the words taken of each."""
    return mixing.mixed_documents(docs)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: The hashed importance ratio of the first stage cannot be said in portable SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables are deleted once the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(last)
        last = docs
    return docs
