"""Marts from mergeable states: one partial aggregate per Bronze batch, replaced when its batch is.

A state holds what its mart can be put together from: counts, exact sums and extremes per group, and the ids themselves
where distinct ones are counted. A run reads only batches that are new or were written again; the mart then reads states,
which have a row per group and batch, and no Bronze rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.rules import MART_BANDS, is_flagged, portfolio_status
from riskloom.plans.gold import for_gold
from riskloom.plans.marts import MONEY, money
from riskloom.plans.silver import CLEANERS, standard_names
from riskloom.sources.files import batch_marks, scan_layer
from riskloom.sources.snapshots import commit, new_part, read_snapshot, snapshot, vacuum

BATCH = "batch_id"


@dataclass(frozen=True)
class State:
    """The Bronze table that a state is of, the rows it takes, its groups and its measures."""

    table: str
    rows: Callable[[DataFrame], DataFrame]
    groups: tuple[str, ...]
    measures: Callable[[], list]


def _transaction_sums() -> list:
    return [F.count(F.lit(1)).alias("transaction_count"), money("amount").alias("total_amount"),
            F.count("amount").alias("amounts"), F.count_if("is_suspicious").alias("suspicious_count")]


def _monitoring_sums() -> list:
    return [money("amount").alias("total_amount"), F.count_if(is_flagged(F.col("is_suspicious"))).alias("suspicious_count")]


def _loan_sums() -> list:
    return [
        F.count("loan_id").alias("loan_count"), money("principal_amount").alias("total_principal_amount"),
        money("outstanding_balance").alias("total_outstanding_balance"),
        F.max("days_past_due").alias("max_days_past_due"), F.sum("days_past_due").alias("days"),
        F.count("days_past_due").alias("delays"),
    ]


def _dated(rows: DataFrame) -> DataFrame:
    return for_gold(rows).where("transaction_date IS NOT NULL AND channel IS NOT NULL")


STATES = {
    "daily_transactions": State(
        "transactions", CLEANERS["transactions"], ("transaction_date", "channel", "transaction_type"),
        _transaction_sums),
    "daily_monitoring": State(
        "transactions", _dated, ("transaction_date", "channel", "transaction_id"), _monitoring_sums),
    "customer_loans": State("loans", CLEANERS["loans"], ("customer_id",), _loan_sums),
}


def update_states(spark: SparkSession, lake_dir: str, name: str) -> list[str]:
    """Bring the states of a mart up to date with the Bronze batches; returns the batches that were read."""
    state, path = STATES[name], f"{lake_dir}/states/{name}"
    before, marks = snapshot(spark, path), batch_marks(spark, f"{lake_dir}/bronze/{state.table}")
    done = before.notes["batches"] if before else {}
    new = sorted(batch for batch, mark in marks.items() if done.get(batch) != mark)
    if before and not new and done == marks:
        return []
    parts = {part: known for part, known in (before.parts if before else {}).items()
             if known["batch"] in marks and known["batch"] not in new}
    bronze = scan_layer(spark, lake_dir, "bronze", state.table)
    rows = standard_names(bronze.where(F.col(BATCH).isin(new)).withColumn(BATCH, F.col(BATCH).cast("string")))
    sums = state.rows(rows).groupBy(BATCH, *state.groups).agg(*state.measures())
    if new:
        folder = new_part()
        sums.write.partitionBy(BATCH).parquet(f"{path}/{folder}")
        parts |= {f"{folder}/{BATCH}={batch}": {"batch": batch} for batch in batch_marks(spark, f"{path}/{folder}")}
    commit(spark, path, before, parts, {"batches": marks, "schema": sums.drop(BATCH).schema.toDDL()})
    vacuum(spark, path)
    return new


def read_states(spark: SparkSession, lake_dir: str, name: str) -> DataFrame:
    """The states of all batches."""
    path = f"{lake_dir}/states/{name}"
    found = snapshot(spark, path)
    if found is None:
        raise FileNotFoundError(f"{path} has no states yet")
    return read_snapshot(spark, path, found.notes["schema"])


def daily_transactions(states: DataFrame) -> DataFrame:
    """``mart_daily_transactions`` of all batches."""
    merged = states.groupBy("transaction_date", "channel", "transaction_type").agg(
        F.sum("transaction_count").alias("transaction_count"), money("total_amount").alias("total_amount"),
        F.sum("amounts").alias("_amounts"), F.sum("suspicious_count").alias("suspicious_count"))
    average = F.round(F.try_divide(F.col("total_amount").cast("double"), F.col("_amounts")), 6)
    return merged.select("transaction_date", "channel", "transaction_type", "transaction_count", "total_amount",
                         average.alias("avg_amount"), "suspicious_count")


def daily_monitoring(states: DataFrame) -> DataFrame:
    """``local_daily_transaction_monitoring`` of all batches; an id that several batches hold counts once."""
    ids = states.groupBy("transaction_date", "channel", "transaction_id").agg(
        F.sum("total_amount").alias("total_amount"), F.sum("suspicious_count").alias("suspicious_count"))
    return ids.groupBy("transaction_date", "channel").agg(
        F.count("transaction_id").alias("transaction_count"), money("total_amount").alias("total_amount"),
        F.sum("suspicious_count").alias("suspicious_count"))


def customer_exposure(customers: DataFrame, states: DataFrame) -> DataFrame:
    """``mart_customer_exposure`` of the customers and the loans of all batches."""
    totals = states.groupBy("customer_id").agg(
        F.sum("loan_count").alias("loan_count"), money("total_principal_amount").alias("total_principal_amount"),
        money("total_outstanding_balance").alias("total_outstanding_balance"),
        F.max("max_days_past_due").alias("max_days_past_due"),
        F.try_divide(F.sum("days").cast("double"), F.sum("delays")).alias("avg_days_past_due"))
    kinds = {"loan_count": "bigint", "total_principal_amount": MONEY, "total_outstanding_balance": MONEY,
             "max_days_past_due": "int", "avg_days_past_due": "double"}
    filled = [F.coalesce(F.col(name), F.lit(0).cast(kind)).alias(name) for name, kind in kinds.items()]
    people = customers.select("customer_id", "segment", "state", "internal_score").join(totals, "customer_id", "left")
    profile = people.select("customer_id", "segment", "state", "internal_score", *filled)
    return profile.withColumn("portfolio_status", portfolio_status(F.col("max_days_past_due"), MART_BANDS))
