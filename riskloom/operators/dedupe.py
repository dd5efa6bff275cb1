"""Removing duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_rows(df: DataFrame) -> DataFrame:
    """One of each group of equal rows."""
    return df.dropDuplicates()


def one_per_key(df: DataFrame, keys: list[str], newest_first: list | None = None) -> DataFrame:
    """One row per key: the newest, and among equally new ones the smallest by its other columns, so a rerun agrees."""
    others = [F.asc_nulls_last(F.col(f"`{name}`")) for name in df.columns if name not in keys]
    order = [*(newest_first or []), *others]
    return latest_per_key(df, keys, order) if order else df.dropDuplicates(keys)


def latest_per_key(df: DataFrame, keys: list[str], newest_first: list) -> DataFrame:
    """The first row per key in the given order.

    Spark cuts each task's input to one row per key before the shuffle (window group limit), so a key that holds
    a large part of the table sends one row per task and not its whole group.
    """
    ranked = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")
