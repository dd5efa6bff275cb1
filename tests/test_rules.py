"""Business rules at their edges, and the empty and null paths of the marts."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskloom.functions import rules
from riskloom.plans import gold, marts, serving


def _map(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_portfolio_status_bands(spark):
    days = [0, 1, 5, 6, 29, 30, 31, 89, 90, 91, None]
    mart = _map(spark, days, "int", rules.portfolio_status)
    assert mart == ["PERFORMING"] + ["WATCHLIST"] * 4 + ["HIGH_RISK"] * 3 + ["DEFAULT_RISK"] * 2 + ["PERFORMING"]
    snapshot = _map(spark, days, "int", lambda c: rules.portfolio_status(c, rules.SNAPSHOT_BANDS))
    assert snapshot == (
        ["PERFORMING"] * 3 + ["WATCHLIST"] * 3 + ["HIGH_RISK"] * 3 + ["DEFAULT_RISK"] + ["PERFORMING"]
    )


def test_flag_tokens(spark):
    values = ["True", "1", "t", "YES", "false", "0", "", "y", None]
    assert _map(spark, values, "string", rules.is_flagged) == [True] * 4 + [False] * 5
    assert _map(spark, [True, False, None], "boolean", rules.is_flagged) == [True, False, False]


@pytest.mark.parametrize(
    ("days", "score", "rating"),
    [(0, 750, "AA"), (0, 749, "A"), (0, 679, "B"), (5, 680, "A"), (6, 900, "B"), (15, 1, "B"), (16, 1, "C"),
     (30, 1, "C"), (31, 1, "D"), (90, 1, "D"), (91, 900, "E"), (0, None, "B")],
)
def test_risk_rating(spark, days, score, rating):
    df = spark.createDataFrame([(days, score)], "d int, s int")
    assert df.select(rules.risk_rating(F.col("d"), F.col("s"))).first()[0] == rating


def test_labels_fall_back_to_the_code(spark):
    assert _map(spark, ["HIGH_RISK", "odd", None], "string",
                lambda c: rules.label_for(c, rules.STATUS_LABELS)) == ["High Risk", "odd", None]


def test_account_health(spark):
    df = spark.createDataFrame(
        [(1, 2, 0, 2, 0), (2, 3, 1, 1, 1), (3, 2, 0, 0, 2), (4, 2, 1, 0, 1)], "i int, t int, a int, b int, c int"
    )
    status = rules.account_health(*[F.col(c) for c in "tabc"])
    assert [r[0] for r in df.orderBy("i").select(status).collect()] == [
        "FULLY_BLOCKED", "PARTIALLY_BLOCKED", "ALL_CLOSED", "HEALTHY",
    ]


def _macro(spark, rows):
    return spark.createDataFrame(rows, "observation_date string, indicator_name string, series_id int, value int") \
        .selectExpr("cast(observation_date as date) observation_date", "indicator_name", "series_id",
                    "cast(value as decimal(18,4)) value")


def _exposure(spark):
    return spark.createDataFrame(
        [("a", "HIGH_RISK", Decimal(10)), ("b", "HIGH_RISK", Decimal(5))],
        "customer_id string, portfolio_status string, total_outstanding_balance decimal(38,2)",
    )


def test_macro_context_takes_the_latest_date_without_fallback(spark):
    macro = _macro(spark, [
        ("2024-01-01", "selic", 11, 1), ("2024-02-01", "credit_free_total", 2, 7), (None, "selic", 11, 9),
    ])
    row = marts.mart_credit_macro_context(macro, _exposure(spark)).collect()
    assert len(row) == 1
    assert (str(row[0]["macro_observation_date"]), row[0]["selic_rate"], float(row[0]["credit_free_total"])) == (
        "2024-02-01", None, 7.0,
    )
    assert (row[0]["customer_count"], float(row[0]["total_outstanding_balance"])) == (2, 15.0)


def test_macro_context_is_empty_without_macro_rows(spark):
    macro = _macro(spark, [("2024-01-01", "selic", 11, 1)]).where("false")
    assert marts.mart_credit_macro_context(macro, _exposure(spark)).count() == 0


def test_rating_order_is_by_text(spark):
    customers = spark.createDataFrame([("c", "s", "x", 1)],
                                      "customer_id string, segment string, state string, internal_score int")
    loans = spark.createDataFrame(
        [(i, c, Decimal(1), Decimal(1), 0, r)
         for i, c, r in (("l1", "c", "AA"), ("l2", "c", "A"), ("l3", "orphan", "E"))],
        "loan_id string, customer_id string, principal_amount decimal(18,2), outstanding_balance decimal(18,2), "
        "days_past_due int, risk_rating string",
    )
    row = marts.int_customer_credit_profile(customers, loans).collect()
    assert [(r["best_risk_rating"], r["worst_risk_rating"], r["loan_count"]) for r in row] == [("A", "AA", 2)]


def test_kpis_of_an_empty_mart(spark):
    health = spark.createDataFrame(
        [], "customer_id string, account_health_status string, total_accounts bigint, active_ratio_pct double"
    )
    row = serving.kpi_account_health(health).first()
    assert (row["total_customers"], row["blocked_customers"], row["blocked_pct"]) == (0, 0, 0.0)


def test_scaled_series_without_suspicious_rows(spark):
    daily = spark.createDataFrame(
        [("2024-01-01", Decimal(5), 0)], "transaction_date string, total_amount decimal(38,2), suspicious_count bigint"
    )
    assert serving.daily_suspicious_scaled(daily).first()["suspicious_scaled"] == 0.0


def test_gold_counts_distinct_ids_unless_they_are_known_to_be_unique(spark):
    rows = spark.createDataFrame(
        [("t1", "2024-01-01", "PIX", Decimal(1), True), ("t1", "2024-01-01", "PIX", Decimal(1), True),
         ("t2", "2024-01-01", "PIX", Decimal(2), None), (None, "2024-01-01", "PIX", Decimal(4), False)],
        "transaction_id string, transaction_date string, channel string, amount decimal(18,2), is_suspicious boolean",
    )
    row = gold.gold_daily_transaction_monitoring(rows).first()
    assert (row["transaction_count"], float(row["total_amount"]), row["suspicious_count"]) == (2, 8.0, 2)
    unique = gold.gold_daily_transaction_monitoring(rows.where("transaction_id = 't2'"), unique_ids=True).first()
    assert unique["transaction_count"] == 1


def test_local_gold_drops_rows_without_a_key(spark):
    rows = spark.createDataFrame(
        [("t1", None, "PIX", Decimal(1), "yes"), ("t2", "2024-01-01", None, Decimal(1), "yes"),
         ("t3", "2024-01-01", "PIX", Decimal(1), "yes")],
        "transaction_id string, transaction_date string, channel string, amount decimal(18,2), is_suspicious string",
    )
    assert gold.local_daily_transaction_monitoring(rows).count() == 1
    assert gold.gold_daily_transaction_monitoring(rows).count() == 3
