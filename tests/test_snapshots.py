"""Snapshot tables: reads beside writes, failed writes, and what is kept."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.plans.layers import bronze_to_silver
from riskloom.sources import files, sinks, snapshots
from riskloom.streaming import suspicious

COLUMNS = "account_id string, customer_id string, account_type string, opened_at string, status string"


def test_a_reader_ends_beside_an_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_layer(spark.range(5), path)
    reader = files.read_layer_table(spark, path)
    sinks.overwrite_layer(spark.range(3).select(F.col("id").cast("string").alias("name")), path)
    assert reader.count() == 5 and sorted(r["id"] for r in reader.collect()) == list(range(5))
    assert files.read_layer_table(spark, path).columns == ["name"]
    assert snapshots.read_snapshot(spark, path, version=0).count() == 5


def test_a_failed_overwrite_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_layer(spark.range(5), path)
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        sinks.overwrite_layer(broken, path)
    assert files.read_layer_table(spark, path).count() == 5
    assert snapshots.snapshot(spark, path).version == 0


def test_two_writers_do_not_lose_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    first = snapshots.replace_table(spark.range(1), path)
    snapshots.commit(spark, path, first, first.parts)
    with pytest.raises(RuntimeError, match="another writer"):
        snapshots.commit(spark, path, first, {})
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, str(tmp_path / "none"))


def test_vacuum_keeps_what_is_young_or_named(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(1, 5):
        sinks.overwrite_layer(spark.range(n), path)
    spark.range(9).write.parquet(f"{path}/{snapshots.new_part()}")  # of a write that has not ended
    assert snapshots.vacuum(spark, path, keep_versions=2) == []
    removed = snapshots.vacuum(spark, path, keep_versions=2, keep_hours=0)
    assert sorted(r for r in removed if r.endswith(".json")) == ["0.json", "1.json"] and len(removed) == 5
    assert snapshots.read_snapshot(spark, path).count() == 4
    assert snapshots.read_snapshot(spark, path, version=2).count() == 3


def _events(spark, k: int):
    return spark.range(3).select(
        F.lit("e").alias("event_type"), F.lit(f"t{k}").alias("timestamp"),
        F.concat(F.lit(f"{k}-"), F.col("id").cast("string")).alias("transaction_id"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("customer_id"), F.lit("a").alias("account_id"),
        F.lit("d").alias("transaction_date"), F.lit("PIX").alias("channel"), F.lit(1.0).alias("amount"))


def test_a_reader_ends_beside_a_fold(spark, tmp_path):
    events, path, checkpoint = str(tmp_path / "events"), str(tmp_path / "summary"), str(tmp_path / "checkpoint")
    assert suspicious.read_summary(spark, path).count() == 0
    readers = []
    for k in range(5):
        _events(spark, k).coalesce(1).write.mode("append").json(events)
        stream = suspicious.events_from_files(spark, events, 1)
        suspicious.maintain_summary(stream, path, checkpoint, fold_every=2).awaitTermination()
        readers.append(suspicious.read_summary(spark, path))
    for k, reader in enumerate(readers):
        assert {r["customer_id"]: r["suspicious_count"] for r in reader.collect()} == {f"c{i}": k + 1 for i in range(3)}
    assert len(snapshots.snapshot(spark, path).parts) <= 3


def _silver(spark, lake: str) -> set:
    rows = files.scan_layer(spark, lake, "silver_typed", "accounts").drop("ingestion_processed_at").collect()
    assert len(set(rows)) == len(rows)
    return set(rows)


def _rebuilt(spark, lake: str, other: str) -> set:
    """The Silver rows of a rebuild in another folder."""
    for batch in ("1", "2", "3", "4"):
        try:
            bronze = spark.read.parquet(f"{lake}/bronze/accounts/batch_id={batch}")
        except Exception:
            continue
        sinks.write_batch(bronze, other, "bronze", "accounts", batch)
    bronze_to_silver(spark, other, "accounts", rebuild=True)
    return _silver(spark, other)


def _accounts(spark, ids, status: str, more: str = ""):
    rows = [(f"a{k}", f"c{k % 3}", "SAVINGS", f"2020-01-{k % 28 + 1:02}", status) for k in ids] + [(None, "c", "X", None, status)]
    df = spark.createDataFrame(rows, COLUMNS)
    return df.withColumn(more, F.lit(1)) if more else df


def test_silver_reads_new_batches_only_and_equals_a_rebuild(spark, tmp_path):
    lake = str(tmp_path / "lake")
    write = lambda df, batch: sinks.write_batch(df, lake, "bronze", "accounts", batch)
    step = lambda **more: bronze_to_silver(spark, lake, "accounts", part_rows=10, **more)
    write(_accounts(spark, range(60), "ACTIVE"), "2")
    assert step() == ["2"] and step() == []
    first = snapshots.snapshot(spark, f"{lake}/silver_typed/accounts")
    assert len(first.parts) > 3
    # A late older batch adds its own keys only; a newer one wins, and parts without its keys stay as they are.
    write(_accounts(spark, range(50, 70), "CLOSED"), "1")
    assert step() == ["1"]
    write(_accounts(spark, [7], "BLOCKED"), "3")
    before = snapshots.snapshot(spark, f"{lake}/silver_typed/accounts")
    assert step() == ["3"]
    after = snapshots.snapshot(spark, f"{lake}/silver_typed/accounts")
    assert 0 < len(after.parts.keys() - before.parts.keys()) <= 2
    found = {r["account_id"]: r["status"] for r in _silver(spark, lake)}
    assert (found["a7"], found["a55"], found["a65"], found[None]) == ("BLOCKED", "ACTIVE", "CLOSED", "BLOCKED")
    assert _silver(spark, lake) == _rebuilt(spark, lake, str(tmp_path / "one"))
    # A batch with one more column, and one that is corrected.
    write(_accounts(spark, range(65, 72), "ACTIVE", "branch"), "4")
    assert step() == ["4"]
    assert _silver(spark, lake) == _rebuilt(spark, lake, str(tmp_path / "two"))
    write(_accounts(spark, [8], "BLOCKED"), "3")
    assert step() == ["1", "2", "3", "4"]
    assert {r["account_id"]: r["status"] for r in _silver(spark, lake)}["a7"] == "ACTIVE"
    assert _silver(spark, lake) == _rebuilt(spark, lake, str(tmp_path / "three"))


def test_parts_that_grew_are_dealt_anew(spark, tmp_path):
    lake = str(tmp_path / "lake")
    sinks.write_batch(_accounts(spark, range(10), "ACTIVE"), lake, "bronze", "accounts", "1")
    bronze_to_silver(spark, lake, "accounts", part_rows=10)
    sinks.write_batch(_accounts(spark, range(200), "CLOSED"), lake, "bronze", "accounts", "2")
    assert bronze_to_silver(spark, lake, "accounts", part_rows=10) == ["2"]
    assert len(snapshots.snapshot(spark, f"{lake}/silver_typed/accounts").parts) > 10
    assert len(_silver(spark, lake)) == 201
