"""Data contracts over raw, all-text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import is_blank
from riskloom.operators.joins import join_lookup
from riskloom.schemas import Contract

# Fixed value: how many errors a report lists.
REPORTED_ERRORS = 50

REQUIRED, NOT_NULL, UNIQUE = "required", "not_null", "unique"


def missing_columns(df: DataFrame, contract: Contract) -> list[str]:
    """Required columns the table lacks, in contract order."""
    return [name for name in contract.required if name not in df.columns]


def _blank(df: DataFrame, column: str) -> Column:
    """A column the table lacks counts as blank on every row."""
    return is_blank(F.col(column)) if column in df.columns else F.lit(True)


def _raw(column: str) -> Column:
    """The untrimmed value; the reader's null is an empty field of the file."""
    return F.coalesce(F.col(column), F.lit(""))


def required_columns(df: DataFrame, contract: Contract) -> DataFrame:
    """One row per required column: is it there, and how many rows does the table have."""
    present = [
        F.struct(F.lit(name).alias("column_name"), F.lit(name in df.columns).alias("present"))
        for name in contract.required
    ]
    rows = df.agg(F.count(F.lit(1)).alias("rows_checked"))
    return rows.select(
        F.lit(contract.name).alias("contract"), F.explode(F.array(*present)).alias("c"), "rows_checked"
    ).select("contract", "c.column_name", "c.present", "rows_checked")


def not_null_counts(df: DataFrame, contract: Contract) -> DataFrame:
    """Blank values per not-null column, from one pass over the table."""
    counted = df.agg(
        *[F.count_if(_blank(df, name)).alias(f"n{i}") for i, name in enumerate(contract.not_null)]
    )
    pairs = [
        F.struct(F.lit(name).alias("column_name"), F.col(f"n{i}").alias("failures"))
        for i, name in enumerate(contract.not_null)
    ]
    return counted.select(F.lit(contract.name).alias("contract"), F.explode(F.array(*pairs)).alias("c")).select(
        "contract", "c.column_name", "c.failures"
    )


def duplicate_rows(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """Every row after the first that repeats a value, first being the smallest ``row_id``.

    The first row per value is a map-side combined minimum, and the join back splits hot values, so a value held by a
    large part of the rows never meets in one task.
    """
    rows = df.select(F.col(row_id).alias("row_id"), _raw(column).alias("value"))
    counted = rows.groupBy("value").agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("n"))
    repeated = counted.where("n > 1").select("value", "first_row_id")
    joined = join_lookup(rows, repeated, "value")
    return joined.where("row_id > first_row_id").select("row_id", "value")


def violations(df: DataFrame, contract: Contract, row_id: str) -> DataFrame:
    """All violations as rows; a missing column has row id null. ``step`` orders violations within a row."""
    name = F.lit(contract.name).alias("contract")
    parts = []
    if contract.not_null:
        found = [
            F.when(_blank(df, column), F.struct(F.lit(i).alias("step"), F.lit(column).alias("column_name")))
            for i, column in enumerate(contract.not_null)
        ]
        parts.append(
            df.select(F.col(row_id).alias("row_id"), F.explode(F.array_compact(F.array(*found))).alias("v")).select(
                name, "row_id", "v.step", F.lit(NOT_NULL).alias("rule"), "v.column_name",
                F.lit(None).cast("string").alias("value"),
            )
        )
    for i, column in enumerate(contract.unique):
        if column in df.columns:
            parts.append(
                duplicate_rows(df, column, row_id).select(
                    name, "row_id", F.lit(len(contract.not_null) + i).alias("step"), F.lit(UNIQUE).alias("rule"),
                    F.lit(column).alias("column_name"), "value",
                )
            )
    absent = missing_columns(df, contract)
    if absent:
        entries = F.array(*[
            F.struct(F.lit(i).alias("step"), F.lit(column).alias("column_name")) for i, column in enumerate(absent)
        ])
        parts.append(
            df.sparkSession.range(1).select(F.explode(entries).alias("v")).select(
                name, F.lit(None).cast("bigint").alias("row_id"), "v.step", F.lit(REQUIRED).alias("rule"),
                "v.column_name", F.lit(None).cast("string").alias("value"),
            )
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def message() -> Column:
    """The error text of a violation row. The three formats are fixed values."""
    return (
        F.when(F.col("rule") == REQUIRED, F.concat(F.lit("Missing required column: "), F.col("column_name")))
        .when(
            F.col("rule") == NOT_NULL,
            F.format_string("Row %d: null/empty value in '%s'", F.col("row_id"), F.col("column_name")),
        )
        .otherwise(
            F.format_string(
                "Row %d: duplicate value '%s' in '%s'", F.col("row_id"), F.col("value"), F.col("column_name")
            )
        )
    )


def first_errors(df: DataFrame, contract: Contract, row_id: str, limit: int = REPORTED_ERRORS) -> DataFrame:
    """The errors a report lists: missing columns, then rows in order. ``row_id`` is the caller's row number."""
    found = violations(df, contract, row_id)
    order = [F.asc_nulls_first("row_id"), F.asc("step")]
    return found.orderBy(*order).limit(limit).select("contract", "row_id", "step", message().alias("error"))


def summary(df: DataFrame, contract: Contract) -> DataFrame:
    """One row: rows checked, error total, pass or fail.

    Repeated values are counted as rows minus distinct values, so no violation row is built.
    """
    present = [column for column in contract.unique if column in df.columns]
    blanks = [F.count_if(_blank(df, column)) for column in contract.not_null]
    repeats = [F.count(F.lit(1)) - F.count_distinct(_raw(column)) for column in present]
    total = F.lit(len(missing_columns(df, contract))).cast("bigint")
    for part in blanks + repeats:
        total = total + part
    counted = df.agg(F.count(F.lit(1)).alias("rows_checked"), total.alias("error_count"))
    return counted.select(
        F.lit(contract.name).alias("contract"), "rows_checked", "error_count",
        (F.col("error_count") == 0).alias("passed"),
    )
