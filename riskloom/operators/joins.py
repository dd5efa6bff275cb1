"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.sizing import fits
from riskloom.session import staged

# Rows of a hot key that one task takes.
SPLIT_ROWS = 1_000_000


def _hot(rows: DataFrame, key: str, split_rows: int) -> DataFrame:
    """``(_hash, _parts)``: the keys with more than ``split_rows`` rows, by hash, and into how many parts they go.

    There is at most one for every ``split_rows`` rows, and each takes 16 bytes: 16 MB for 10**12 rows. That bound is
    what allows the broadcast. Keys are counted before the shuffle.
    """
    counts = rows.groupBy(F.xxhash64(key).alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / split_rows).cast("int")
    return F.broadcast(counts.where(F.col("_n") > split_rows).select("_hash", parts.alias("_parts")))


def join_split(
    rows: DataFrame, other: DataFrame, key: str, by: str | list[str], split_rows: int = SPLIT_ROWS, how: str = "inner"
) -> DataFrame:
    """Join two sides that may both repeat a key, with the rows of each hot key of ``rows`` spread over many tasks.

    A hot key's rows are split by a hash of ``by``, which stays the same when a task is run again, into as many parts
    as it has ``split_rows`` rows; the other side repeats its rows of that key once per part. All other keys have one
    part. ``how`` is inner or left; a null key has no partner, but its rows are spread like any other's.
    """
    hot = _hot(rows, key, split_rows)
    parts = F.coalesce("_parts", F.lit(1))
    columns = [by] if isinstance(by, str) else by
    left = rows.withColumn("_hash", F.xxhash64(key)).join(hot, "_hash", "left")
    left = left.withColumn("_part", F.pmod(F.xxhash64(*columns), parts).cast("int")).drop("_parts", "_hash")
    right = other.withColumn("_hash", F.xxhash64(key)).join(hot, "_hash", "left")
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts", "_hash")
    return left.join(right, [key, "_part"], how).drop("_part")


def join_lookup(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Join ``rows`` to ``lookup``, which has at most one row per key; ``how`` is inner or left.

    AQE splits a hot partition only where both sides come straight from a shuffle, which an aggregated lookup does not,
    so the rows of a hot key are spread by a hash of the whole row.
    """
    return join_split(rows, lookup, key, rows.columns, split_rows, how)


def join_measured(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows``, one row per key, and ``found``, which is broadcast where it is measured to be small.

    ``found`` is written first, so that it is computed once, and what is measured is what is broadcast. A larger one
    is joined by shuffle, with its hot keys split.
    """
    found = staged(found, "found")
    return rows.join(F.broadcast(found), key) if fits(found) else join_lookup(found, rows, key)
