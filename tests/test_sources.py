"""CSV files as others write them, guarded statements by their relations, and the folding of the running summary."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.plans import copilot
from riskloom.plans.layers import bronze_to_silver
from riskloom.sources import files, sinks
from riskloom.sources.snapshots import snapshot, vacuum
from riskloom.streaming import suspicious

MART = "analytics_marts.mart_customer_exposure"


def test_csv_with_quotes_breaks_and_backslashes(spark, tmp_path):
    (tmp_path / "x.csv").write_text(
        'id,name,state\n1,"Silva ""Z"" Ltda, SP",SP\n2,"two\nlines",RJ\n3,"C:\\dir\\",MG\n4,a\\b,""\n')
    rows = files.scan_csv(spark, str(tmp_path / "x.csv"), multi_line=True).orderBy("id").collect()
    assert [r["name"] for r in rows] == ['Silva "Z" Ltda, SP', "two\nlines", "C:\\dir\\", "a\\b"]
    sinks.write_csv(spark.createDataFrame(rows, "id string, name string, state string"), str(tmp_path / "back"))
    back = files.scan_csv(spark, str(tmp_path / "back"), multi_line=True).orderBy("id").collect()
    assert [r["name"] for r in back] == [r["name"] for r in rows]


def test_quoted_fields_without_line_breaks_need_no_option(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,name\n1,"Silva ""Z"" Ltda, SP"\n2,"C:\\dir\\"\n')
    rows = files.scan_csv(spark, str(tmp_path / "x.csv")).orderBy("id").collect()
    assert [r["name"] for r in rows] == ['Silva "Z" Ltda, SP', "C:\\dir\\"]


@pytest.mark.parametrize("sql", [
    f"select s.x from {MART} m, secret s", f"select * from {MART} m join `raw`.`customers` c on true",
    f"select * from {MART} where 1 in (select x from secret)", f"select * from {MART}, parquet.`/tmp/x`",
    f"with a as (select * from secret) select * from a join {MART} on true", f"select * from {MART}, range(3)",
    f"select (select max(x) from secret) from {MART}",
])
def test_guarded_statement_reads_allowed_tables_only(spark, sql):
    spark.range(2).withColumnRenamed("id", "x").createOrReplaceTempView("secret")
    mart = spark.createDataFrame([("a", 1)], "segment string, n int")
    with pytest.raises(ValueError, match="not allowlisted"):
        copilot.run_guarded(spark, sql, marts={"mart_customer_exposure": mart})
    spark.catalog.dropTempView("secret")


def test_guarded_statement_keeps_literals_and_leaves_no_view(spark):
    mart = spark.createDataFrame([("a", 1), ("b", 2)], "segment string, n int")
    sql = (f"with big as (select * from {MART} m where n > 1) "
           f"select segment, '{MART}' as note from big where exists (select 1 from {MART.upper()})")
    rows = copilot.run_guarded(spark, sql, marts={"mart_customer_exposure": mart}).collect()
    assert [tuple(r) for r in rows] == [("b", MART)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("guarded_")]


def test_malformed_messages_are_errors(spark):
    good = '{"event_type": "e", "customer_id": "c", "amount": 1.5}'
    messages = spark.createDataFrame([(good.encode(),)], "value binary")
    assert suspicious.parsed_messages(messages).first()["customer_id"] == "c"
    bad = spark.createDataFrame([(b"{bad",)], "value binary")
    with pytest.raises(Exception, match="MALFORMED"):
        suspicious.parsed_messages(bad).collect()


def test_summary_folds_and_stays_right(spark, tmp_path):
    events, path, checkpoint = tmp_path / "events", str(tmp_path / "summary"), str(tmp_path / "checkpoint")
    for k in range(8):
        rows = spark.range(3).select(
            F.lit("e").alias("event_type"), F.lit(f"t{k}").alias("timestamp"), F.lit("x").alias("transaction_id"),
            F.concat(F.lit("c"), F.when(F.col("id") == 2, F.lit(str(k))).otherwise(F.col("id").cast("string"))).alias("customer_id"),
            F.lit("a").alias("account_id"), F.lit("d").alias("transaction_date"), F.lit("PIX").alias("channel"),
            F.lit(1.0).alias("amount"))
        rows.coalesce(1).write.mode("append").json(str(events))
        stream = suspicious.events_from_files(spark, str(events), 1)
        suspicious.maintain_summary(stream, path, checkpoint, fold_every=3).awaitTermination()
    found = {r["customer_id"]: r["suspicious_count"] for r in suspicious.read_summary(spark, path).collect()}
    assert found == {"c0": 9, "c1": 9, **{f"c{k}": 1 for k in range(2, 8)}}
    parts = snapshot(spark, path).parts
    assert sorted(known["epoch"] for known in parts.values()) == [6, 7]
    assert set(parts) < {p.name for p in (tmp_path / "summary").iterdir()}  # the older ones stay for their readers
    assert vacuum(spark, path, keep_versions=1, keep_hours=0)
    assert {p.name for p in (tmp_path / "summary").iterdir() if p.name.startswith("part-")} == set(parts)
    again = {r["customer_id"]: r["suspicious_count"] for r in suspicious.read_summary(spark, path).collect()}
    assert again == found


def test_silver_keeps_the_newest_version_on_every_run(spark, tmp_path):
    lake = str(tmp_path)
    columns = "account_id string, customer_id string, account_type string, opened_at string, status string"
    old = spark.createDataFrame([("1", "c", "SAVINGS", "2020-01-01", "CLOSED"), ("2", "c", "X", None, "ACTIVE")], columns)
    new = spark.createDataFrame([("1", "c", "SAVINGS", "2020-01-01", "ACTIVE"), ("1", "c", "SAVINGS", None, "BLOCKED")],
                                columns)
    sinks.write_batch(new, lake, "bronze", "accounts", "2026-02-01T00-00-00Z")
    sinks.write_batch(old, lake, "bronze", "accounts", "2026-01-01T00-00-00Z")
    for _ in range(2):
        bronze_to_silver(spark, lake, "accounts")
        rows = files.scan_layer(spark, lake, "silver_typed", "accounts").collect()
        assert {(r["account_id"], r["status"]) for r in rows} == {("1", "ACTIVE"), ("2", "ACTIVE")}
        assert "batch_id" not in rows[0].asDict()
