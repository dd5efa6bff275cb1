"""Staging: typed, ordered columns on top of the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.schemas import TABLES, columns_of


def typed(raw: DataFrame, table: str) -> DataFrame:
    """The table's declared columns, in order, under their declared types.

    A column that already has its type, or a key that is not text in the caller's data, passes through.
    """
    kinds = dict(raw.dtypes)
    return raw.selectExpr(*[
        name if kind == "string" or kinds[name] == kind else f"CAST({name} AS {kind}) AS {name}"
        for name, kind in columns_of(TABLES[table])
    ])


def stg_customers(raw: DataFrame) -> DataFrame:
    return typed(raw, "customers")


def stg_accounts(raw: DataFrame) -> DataFrame:
    return typed(raw, "accounts")


def stg_transactions(raw: DataFrame) -> DataFrame:
    return typed(raw, "transactions")


def stg_loans(raw: DataFrame) -> DataFrame:
    return typed(raw, "loans")


def stg_macro_indicators(raw: DataFrame) -> DataFrame:
    return typed(raw, "macro_indicators")


def stg_ai_copilot_audit(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.to_timestamp("timestamp").alias("audit_timestamp"), "status", "question", "citations", "guarded_sql",
        "response",
    )
