"""Top-k selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_overall(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first ``k`` rows in the given order; each task keeps ``k`` rows."""
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, group: str, order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group with their rank; each task sends at most ``k`` rows per group."""
    ranked = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(ranked)).where(F.col(rank) <= k)
