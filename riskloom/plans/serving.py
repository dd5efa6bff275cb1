"""Aggregates behind the risk dashboard, over the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.rules import (
    AUDIT_LABELS, BLOCKED_HEALTH, CRITICAL_STATUSES, HEALTH_LABELS, STATUS_LABELS, label_for, share_pct,
)
from riskloom.operators.topk import top_overall
from riskloom.plans.marts import money


def _everything():
    """Frame over all rows; used only on results with one row per status or per calendar day."""
    return Window.partitionBy()


def kpi_exposure(exposure: DataFrame) -> DataFrame:
    """Customers, balance, critical customers and their share, mean of the customers' average delays."""
    # Grouping by customer first keeps the mart's own partitioning and needs no distinct aggregate.
    per_customer = exposure.groupBy("customer_id").agg(
        money("total_outstanding_balance").alias("balance"),
        F.bool_or(F.col("portfolio_status").isin(*CRITICAL_STATUSES)).alias("critical"),
        F.sum("avg_days_past_due").alias("delay_sum"),
        F.count("avg_days_past_due").alias("delays"),
    )
    known = F.col("customer_id").isNotNull()
    return per_customer.agg(
        F.count_if(known).alias("total_customers"),
        money("balance").alias("total_balance"),
        F.count_if(known & F.col("critical")).alias("critical_customers"),
        F.round(F.try_divide(F.sum("delay_sum"), F.sum("delays")), 6).alias("avg_days_past_due"),
    ).withColumn("critical_pct", share_pct(F.col("critical_customers"), F.col("total_customers"), 6))


def exposure_by_segment_status(exposure: DataFrame) -> DataFrame:
    """Balance per segment and status label."""
    return (
        exposure.groupBy("segment", "portfolio_status")
        .agg(money("total_outstanding_balance").alias("total_outstanding_balance"))
        .select(
            "segment", label_for(F.col("portfolio_status"), STATUS_LABELS).alias("risk_status"),
            "total_outstanding_balance",
        )
    )


def exposure_share_by_status(exposure: DataFrame) -> DataFrame:
    """Balance per status and its share of the whole."""
    balance = F.col("total_outstanding_balance")
    return (
        exposure.groupBy(label_for(F.col("portfolio_status"), STATUS_LABELS).alias("risk_status"))
        .agg(money("total_outstanding_balance").alias("total_outstanding_balance"))
        .withColumn("share_pct", share_pct(balance, F.sum(balance).over(_everything()), 6))
    )


def daily_totals(daily: DataFrame) -> DataFrame:
    """Volume and suspicious count per day."""
    return daily.groupBy("transaction_date").agg(
        money("total_amount").alias("total_amount"), F.sum("suspicious_count").alias("suspicious_count")
    )


def daily_suspicious_scaled(daily: DataFrame) -> DataFrame:
    """Suspicious counts scaled so that their peak meets the peak of the volume."""
    peak_amount = F.max("total_amount").over(_everything()).cast("double")
    peak_count = F.max("suspicious_count").over(_everything())
    factor = F.when(peak_count > 0, peak_amount / peak_count).otherwise(F.lit(1.0))
    return daily_totals(daily).select(
        "transaction_date", "total_amount", "suspicious_count",
        F.round(F.col("suspicious_count") * factor, 6).alias("suspicious_scaled"),
    )


def streaming_alert_kpis(summary: DataFrame) -> DataFrame:
    """Customers under alert and the flagged volume."""
    return summary.agg(
        F.count(F.lit(1)).alias("customers_under_alert"),
        money("total_suspicious_amount").alias("flagged_volume"),
    )


def top_flagged_customers(summary: DataFrame, k: int = 5) -> DataFrame:
    """The customers with most alerts; equal counts go by id."""
    return top_overall(summary, [F.desc("suspicious_count"), F.asc("customer_id")], k)


def kpi_account_health(health: DataFrame) -> DataFrame:
    """Customers, mean active ratio, blocked customers and their share, accounts."""
    return health.agg(
        F.count_distinct("customer_id").alias("total_customers"),
        F.round(F.avg("active_ratio_pct"), 6).alias("avg_active_ratio"),
        F.count_if(F.col("account_health_status").isin(*BLOCKED_HEALTH)).alias("blocked_customers"),
        F.sum("total_accounts").alias("total_accounts"),
    ).withColumn(
        "blocked_pct", F.coalesce(share_pct(F.col("blocked_customers"), F.col("total_customers"), 6), F.lit(0.0))
    )


def health_by_segment(health: DataFrame) -> DataFrame:
    """Customers per segment and health label."""
    return (
        health.groupBy("segment", "account_health_status")
        .agg(F.count("customer_id").alias("customer_count"))
        .select(
            "segment", label_for(F.col("account_health_status"), HEALTH_LABELS).alias("health_status"),
            "customer_count",
        )
    )


def health_share(health: DataFrame) -> DataFrame:
    """Customers per health status and their share of the whole."""
    count = F.col("customer_count")
    return (
        health.groupBy(label_for(F.col("account_health_status"), HEALTH_LABELS).alias("health_status"))
        .agg(F.count(F.lit(1)).alias("customer_count"))
        .withColumn("share_pct", share_pct(count, F.sum(count).over(_everything()), 6))
    )


def active_ratio_by_state(health: DataFrame) -> DataFrame:
    """Five-number summary of the active ratio per state, quartiles by linear interpolation.

    The ratio has one decimal, so the exact percentile keeps at most 1,001 distinct values per state.
    """
    ratio = "active_ratio_pct"
    return health.groupBy("state").agg(
        F.min(ratio).alias("min_ratio"),
        F.round(F.percentile(ratio, 0.25), 6).alias("q1_ratio"),
        F.round(F.percentile(ratio, 0.5), 6).alias("median_ratio"),
        F.round(F.percentile(ratio, 0.75), 6).alias("q3_ratio"),
        F.max(ratio).alias("max_ratio"),
    )


def audit_kpis(audit: DataFrame) -> DataFrame:
    """Questions, refusals and the refusal rate."""
    return audit.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(F.col("status") == "rejected").alias("rejected_queries"),
    ).withColumn(
        "rejection_rate", F.coalesce(share_pct(F.col("rejected_queries"), F.col("total_queries"), 6), F.lit(0.0))
    )


def audit_by_status(audit: DataFrame) -> DataFrame:
    """Questions per outcome label."""
    return (
        audit.groupBy("status")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(label_for(F.col("status"), AUDIT_LABELS).alias("status_label"), "count")
    )


def audit_recent(audit: DataFrame) -> DataFrame:
    """The audit trail, newest first."""
    return audit.orderBy(F.desc("audit_timestamp"))
