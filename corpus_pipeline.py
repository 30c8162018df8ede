"""From raw documents to a training mix: each stage is one of the numbered operators.

Every stage works on all rows that the one before it kept and returns the columns of
documents; the last one adds how often the mix takes each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmetrics.llm import decontaminate, mixing, near_duplicates, personal_data, quality
from docmetrics.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (at 0.8) stays, the one with the smallest id."""
    return near_duplicates.one_of_each_group(docs, num=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), docs.columns)


def personal_data_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; n_chars follows the new text."""
    return personal_data.redact(docs, docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, with copies: how often."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data_removal),
    ("mixing", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: No stage with a learned or sampled decision can be stated in SQL.
ORACLE_SQL = None
