"""Intermediate models and marts.

Customers are unique by ``customer_id`` (their contract checks it), so loans and accounts are aggregated before they
meet the customers: a hot customer's rows are combined map-side and the join sees one row per customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.rules import MART_BANDS, account_health, portfolio_status, share_pct

MONEY = "decimal(38,2)"


def money(column: str):
    """Exact sum of a money column."""
    return F.sum(column).cast(MONEY)


def _zero_if_null(column: str, kind: str):
    return F.coalesce(F.col(column), F.lit(0).cast(kind)).alias(column)


def int_customer_credit_profile(customers: DataFrame, loans: DataFrame) -> DataFrame:
    """One row per customer with loan totals; ratings compare as text."""
    totals = loans.groupBy("customer_id").agg(
        F.count("loan_id").alias("loan_count"),
        money("principal_amount").alias("total_principal_amount"),
        money("outstanding_balance").alias("total_outstanding_balance"),
        F.max("days_past_due").alias("max_days_past_due"),
        F.avg("days_past_due").alias("avg_days_past_due"),
        F.min("risk_rating").alias("best_risk_rating"),
        F.max("risk_rating").alias("worst_risk_rating"),
    )
    return (
        customers.select("customer_id", "segment", "state", "internal_score")
        .join(totals, "customer_id", "left")
        .select(
            "customer_id", "segment", "state", "internal_score",
            _zero_if_null("loan_count", "bigint"),
            _zero_if_null("total_principal_amount", MONEY),
            _zero_if_null("total_outstanding_balance", MONEY),
            _zero_if_null("max_days_past_due", "int"),
            _zero_if_null("avg_days_past_due", "double"),
            "best_risk_rating", "worst_risk_rating",
        )
    )


def mart_customer_exposure(customers: DataFrame, loans: DataFrame) -> DataFrame:
    """Exposure per customer and the status that follows from the worst delay."""
    profile = int_customer_credit_profile(customers, loans)
    return profile.drop("best_risk_rating", "worst_risk_rating").withColumn(
        "portfolio_status", portfolio_status(F.col("max_days_past_due"), MART_BANDS)
    )


def mart_daily_transactions(transactions: DataFrame) -> DataFrame:
    """Totals per day, channel and type."""
    return (
        transactions.groupBy("transaction_date", "channel", "transaction_type")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            money("amount").alias("total_amount"),
            F.count("amount").alias("_amounts"),
            F.count_if("is_suspicious").alias("suspicious_count"),
        )
        .select(
            "transaction_date", "channel", "transaction_type", "transaction_count", "total_amount",
            F.round(F.try_divide(F.col("total_amount").cast("double"), F.col("_amounts")), 6).alias("avg_amount"),
            "suspicious_count",
        )
    )


def mart_account_health(accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """Account counts per known customer, health status and active ratio."""

    def having(status: str):
        return F.count_if(F.col("status") == status)

    counted = accounts.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_accounts"),
        having("ACTIVE").alias("active_accounts"),
        having("BLOCKED").alias("blocked_accounts"),
        having("CLOSED").alias("closed_accounts"),
        F.min("opened_at").alias("earliest_account_opened"),
        F.max("opened_at").alias("latest_account_opened"),
    )
    health = account_health(*[F.col(f"{kind}_accounts") for kind in ("total", "active", "blocked", "closed")])
    return (
        counted.join(customers.select("customer_id", "segment", "state"), "customer_id")
        .withColumn("account_health_status", health)
        .withColumn("active_ratio_pct", share_pct(F.col("active_accounts"), F.col("total_accounts"), 1))
        .select(
            "customer_id", "segment", "state", "total_accounts", "active_accounts", "blocked_accounts",
            "closed_accounts", "earliest_account_opened", "latest_account_opened", "account_health_status",
            "active_ratio_pct",
        )
    )


def int_credit_macro_context(macro: DataFrame) -> DataFrame:
    """Long to wide: one row per date with a column per indicator."""

    def indicator(name: str):
        return F.max(F.when(F.col("indicator_name") == name, F.col("value")))

    return macro.groupBy("observation_date").agg(
        indicator("selic").alias("selic_rate"), indicator("credit_free_total").alias("credit_free_total")
    )


def macro_latest(macro: DataFrame) -> DataFrame:
    """The wide row of the latest date; an indicator without a value that day is null.

    The latest date comes from a scalar subquery over one column, so only that date's rows are widened.
    """
    latest = macro.agg(F.max("observation_date")).scalar()
    return int_credit_macro_context(macro.where(F.col("observation_date") == latest))


def mart_credit_macro_context(macro: DataFrame, exposure: DataFrame) -> DataFrame:
    """Portfolio totals per status beside the latest macro row; empty when there is no macro row.

    The macro row is a scalar subquery, so the few status rows need no join.
    """
    row = macro_latest(macro).select(
        F.struct(F.col("observation_date").alias("macro_observation_date"), "selic_rate", "credit_free_total")
    ).scalar()
    portfolio = exposure.groupBy("portfolio_status").agg(
        F.count(F.lit(1)).alias("customer_count"),
        money("total_outstanding_balance").alias("total_outstanding_balance"),
    )
    return (
        portfolio.withColumn("macro", row)
        .where(F.col("macro").isNotNull())
        .select("macro.*", "portfolio_status", "customer_count", "total_outstanding_balance")
    )


def mart_ai_copilot_audit(audit: DataFrame) -> DataFrame:
    """The staged audit trail."""
    return audit.select("audit_timestamp", "status", "question", "citations", "guarded_sql", "response")
