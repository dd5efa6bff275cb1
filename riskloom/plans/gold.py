"""Gold outputs: from Silver tables (``gold_*``) and straight from Bronze (``local_*``).

The two differ on purpose: the local ones see duplicates, drop null keys and leave out the average delay and the
status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.rules import SNAPSHOT_BANDS, is_flagged, portfolio_status
from riskloom.plans.marts import money


def _distinct_ids(column: str, unique_ids: bool):
    """Number of distinct ids; where the id is the table's key a plain count says the same without a shuffle by id."""
    return F.count(column) if unique_ids else F.count_distinct(column)


def _snapshot(customers: DataFrame, loans: DataFrame, with_average: bool, unique_ids: bool) -> DataFrame:
    measures = [
        _distinct_ids("loan_id", unique_ids).alias("loan_count"),
        money("principal_amount").alias("total_principal_amount"),
        money("outstanding_balance").alias("total_outstanding_balance"),
        F.max("days_past_due").alias("max_days_past_due"),
    ]
    if with_average:
        measures.append(F.avg("days_past_due").alias("avg_days_past_due"))
    totals = loans.groupBy("customer_id").agg(*measures)
    kinds = dict(totals.dtypes)
    filled = {
        name: F.coalesce(F.col(name), F.lit(0).cast(kinds[name])) for name in totals.columns if name != "customer_id"
    }
    return customers.join(totals, "customer_id", "left").withColumns(filled)


def gold_customer_credit_snapshot(customers: DataFrame, loans: DataFrame, unique_ids: bool = False) -> DataFrame:
    """All customer columns, loan totals, and the status under the snapshot's own bands.

    ``unique_ids`` says that loans have one row per loan, as in Silver.
    """
    return _snapshot(customers, loans, True, unique_ids).withColumn(
        "portfolio_status", portfolio_status(F.col("max_days_past_due"), SNAPSHOT_BANDS)
    )


def local_customer_credit_snapshot(customers: DataFrame, loans: DataFrame) -> DataFrame:
    """All customer columns and loan totals."""
    return _snapshot(customers, loans.where(F.col("customer_id").isNotNull()), False, False)


def _monitoring(transactions: DataFrame, unique_ids: bool) -> DataFrame:
    return (
        transactions.groupBy("transaction_date", "channel")
        .agg(
            _distinct_ids("transaction_id", unique_ids).alias("transaction_count"),
            money("amount").alias("total_amount"),
            F.count_if(is_flagged(F.col("is_suspicious"))).alias("suspicious_count"),
        )
        .orderBy("transaction_date", "channel")
    )


def gold_daily_transaction_monitoring(transactions: DataFrame, unique_ids: bool = False) -> DataFrame:
    """Distinct transactions, volume and suspicious count per day and channel, in order.

    ``unique_ids`` says that there is one row per transaction, as in Silver.
    """
    return _monitoring(transactions, unique_ids)


def local_daily_transaction_monitoring(transactions: DataFrame) -> DataFrame:
    """The same from raw rows, without the rows that lack a day or channel."""
    return _monitoring(transactions.where("transaction_date IS NOT NULL AND channel IS NOT NULL"), False)


def for_gold(raw: DataFrame) -> DataFrame:
    """Raw text rows with just the numbers that the Gold aggregates need."""
    casts = {
        "principal_amount": "decimal(18,2)",
        "outstanding_balance": "decimal(18,2)",
        "days_past_due": "int",
        "amount": "decimal(18,2)",
    }
    return raw.withColumns({name: F.col(name).cast(kind) for name, kind in casts.items() if name in raw.columns})
