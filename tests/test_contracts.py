"""Contracts and data tests on seeded faults, with hot values."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from riskloom.operators import checks, contracts
from riskloom.operators.dedupe import latest_per_key
from riskloom.schemas import CONTRACTS, Contract, ModelTests

TINY = Contract("tiny", required=("id", "name", "extra"), not_null=("id", "name", "extra"), unique=("id",))


def _frame(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, id string, name string")


def test_report_lists_errors_in_file_order(spark):
    df = _frame(spark, [(1, "a", "x"), (2, "a", " \t"), (3, None, "y"), (4, "", "z"), (5, " a", "w")])
    errors = [r["error"] for r in contracts.first_errors(df, TINY, "row_id").collect()]
    assert errors == [
        "Missing required column: extra",
        "Row 1: null/empty value in 'extra'",
        "Row 2: null/empty value in 'name'",
        "Row 2: null/empty value in 'extra'",
        "Row 2: duplicate value 'a' in 'id'",
        "Row 3: null/empty value in 'id'",
        "Row 3: null/empty value in 'extra'",
        "Row 4: null/empty value in 'id'",
        "Row 4: null/empty value in 'extra'",
        "Row 4: duplicate value '' in 'id'",
        "Row 5: null/empty value in 'extra'",
    ]
    report = contracts.summary(df, TINY).first()
    assert (report["rows_checked"], report["error_count"], report["passed"]) == (5, 11, False)


def test_report_is_capped_but_the_total_is_not(spark):
    df = spark.range(200).select(F.col("id").alias("row_id"), F.lit("same").alias("id"), F.lit("n").alias("name"))
    contract = Contract("t", ("id",), (), ("id",))
    assert contracts.first_errors(df, contract, "row_id").count() == 50
    assert contracts.summary(df, contract).first()["error_count"] == 199


def test_clean_table_passes(spark):
    df = spark.createDataFrame([(1, "a1", "c1", "X", "2020-01-01", "ACTIVE")],
                               "row_id bigint, account_id string, customer_id string, account_type string, "
                               "opened_at string, status string")
    assert contracts.summary(df, CONTRACTS["accounts"]).first()["passed"]
    assert contracts.first_errors(df, CONTRACTS["accounts"], "row_id").count() == 0


def test_absent_unique_column_is_skipped(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x")], "row_id bigint, name string")
    report = contracts.summary(df, Contract("t", (), (), ("id",))).first()
    assert report["passed"]


def test_duplicates_match_brute_force_with_a_hot_value(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < 0.4 else f"v{rng.randrange(300)}", "n") for i in range(3000)]
    seen, expected = set(), []
    for i, value, _ in rows:
        if value in seen:
            expected.append((i, value))
        seen.add(value)
    shuffled = _frame(spark, rng.sample(rows, len(rows))).repartition(7)
    found = contracts.duplicate_rows(shuffled, "id", "row_id")
    assert sorted(map(tuple, found.collect())) == expected


def test_latest_per_key_with_a_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    kept = latest_per_key(df, ["k"], [F.desc("id")])
    assert kept.where("k = 0").first()["id"] == 1998
    assert kept.count() == df.select("k").distinct().count()


def test_model_tests_count_failures(spark):
    df = spark.createDataFrame(
        [("a", "ok", 1), ("a", "bad", -1), (None, None, 2), (None, "ok", 3), ("b", "ok", None)],
        "id string, status string, n int",
    )
    tests = ModelTests("m", "id", ("id", "n"), {"status": ("ok",)}, {"n_positive": "n < 0"})
    found = {r["test_name"]: (r["failures"], r["passed"]) for r in checks.run_model_tests(df, tests).collect()}
    assert found == {
        "not_null_m_id": (2, False), "not_null_m_n": (1, False), "accepted_values_m_status": (1, False),
        "assert_n_positive": (1, False), "unique_m_id": (1, False),
    }
    empty = checks.run_model_tests(df.where("false"), tests).collect()
    assert len(empty) == 5 and all(r["passed"] for r in empty)


def test_orphans_count_child_rows(spark):
    children = spark.createDataFrame([("p1",), ("x",), ("x",), (None,)], "pid string")
    parents = spark.createDataFrame([("p1",)], "pid string")
    assert [tuple(r) for r in checks.orphans(children, parents, "pid").collect()] == [("x", 2)]


def test_future_rows_default_to_today(spark):
    df = spark.sql("SELECT current_date() + 1 AS d UNION ALL SELECT current_date()")
    assert checks.no_future_rows(df, "d").count() == 1
