"""A corpus pipeline over ``documents`` in stages, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.contamination import decontamination_stage
from riskloom.llm.frames import table, written
from riskloom.llm.language import language_stage
from riskloom.llm.lines import line_stage
from riskloom.llm.mixing import mix_stage
from riskloom.llm.near import near_stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the model can't tell, or that have no letters."""
    return language_stage(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the boilerplate lines of each source."""
    return line_stage(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return near_stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a passage of the benchmark occurs."""
    return decontamination_stage(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that every source meets its target; adds ``copy`` and ``words``."""
    return mix_stage(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

# Language identification and near-duplicate groups can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
