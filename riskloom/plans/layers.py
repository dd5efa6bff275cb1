"""Layer jobs: raw CSV to Bronze, Silver and Gold batches."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.gold import (
    for_gold, gold_customer_credit_snapshot, gold_daily_transaction_monitoring, local_customer_credit_snapshot,
    local_daily_transaction_monitoring,
)
from riskloom.plans.marts import mart_account_health
from riskloom.plans.silver import CLEANERS, standardize, to_silver
from riskloom.schemas import PRIMARY_KEYS
from riskloom.sources.files import batch_marks, scan_layer, scan_raw
from riskloom.sources.keyed import PART_ROWS, merge_rows
from riskloom.sources.sinks import layer_manifest, new_batch_id, overwrite_layer, write_batch, write_manifest
from riskloom.sources.snapshots import snapshot


@dataclass(frozen=True)
class LayerBuild:
    """What a layer build wrote."""

    batch_id: str
    tables: dict[str, int]
    silver: dict[str, int]
    gold: dict[str, int]
    manifest: DataFrame
    manifest_path: str


def gold_outputs(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The Gold outputs that the given raw tables allow."""
    outputs = {}
    if {"customers", "loans"} <= tables.keys():
        outputs["customer_credit_snapshot"] = local_customer_credit_snapshot(
            tables["customers"], for_gold(tables["loans"])
        )
    needed = {"transaction_date", "channel", "amount", "is_suspicious"}
    if "transactions" in tables and needed <= set(tables["transactions"].columns):
        outputs["daily_transaction_monitoring"] = local_daily_transaction_monitoring(for_gold(tables["transactions"]))
    return outputs


def build_layers(
    spark: SparkSession,
    raw_dir: str,
    lake_dir: str,
    batch_id: str | None = None,
    processed_at: datetime | None = None,
    multi_line: bool = False,
) -> LayerBuild:
    """Write one batch of every layer from a raw directory.

    Silver and Gold read the Bronze batch that was just written, so the CSV files are parsed once.
    """
    batch = batch_id or new_batch_id()
    stamped = processed_at or datetime.now(UTC)
    raw = scan_raw(spark, raw_dir, multi_line)
    counts = {name: write_batch(df, lake_dir, "bronze", name, batch) for name, df in raw.items()}
    bronze = {
        name: scan_layer(spark, lake_dir, "bronze", name).where(F.col("batch_id") == batch).drop("batch_id")
        for name in raw
    }
    silver = {
        name: write_batch(standardize(df, stamped), lake_dir, "silver", name, batch) for name, df in bronze.items()
    }
    gold = {
        name: write_batch(df, lake_dir, "gold", name, batch) for name, df in gold_outputs(bronze).items()
    }
    manifest = layer_manifest(
        spark, lake_dir, batch, {"bronze": list(counts), "silver": list(silver), "gold": list(gold)}
    )
    return LayerBuild(batch, counts, silver, gold, manifest, write_manifest(manifest, lake_dir, batch))


def bronze_to_silver(spark: SparkSession, lake_dir: str, table: str, fmt: str = "parquet", rebuild: bool = False,
                     part_rows: int = PART_ROWS) -> list[str]:
    """Bring one Silver table up to date with its Bronze batches; of a key's versions the newest batch's stays.

    Returns the batches that were read. Silver's log names the batches that are in it: only those that are not are read,
    and only the parts that hold their keys are written anew. A batch that was replaced or is gone leads to a rebuild from
    every batch, which has the same rows. Batch ids compare as text. Delta tables are rebuilt each time.
    """
    path, keys = f"{lake_dir}/silver_typed/{table}", list(PRIMARY_KEYS[table])
    bronze = scan_layer(spark, lake_dir, "bronze", table, fmt)
    if fmt != "parquet":
        overwrite_layer(to_silver(bronze, keys, CLEANERS[table], newest_by="batch_id"), path, fmt)
        return []
    before, batches = snapshot(spark, path), batch_marks(spark, f"{lake_dir}/bronze/{table}")
    done = before.notes.get("batches", {}) if before else {}
    if rebuild or any(batches.get(name) != known for name, known in done.items()):
        done = {}
    new = sorted(batches.keys() - done.keys())
    if new:
        fresh = bronze.where(F.col("batch_id").isin(new)).withColumn("batch_id", F.col("batch_id").cast("string"))
        fresh = to_silver(fresh, keys, CLEANERS[table], newest_by="batch_id", keep=True)
        merge_rows(path, fresh, keys, [F.desc("batch_id")], {"batches": batches, "hidden": ["batch_id"]},
                   replace=not done, part_rows=part_rows)
    return new


def silver_to_gold(spark: SparkSession, lake_dir: str, fmt: str = "parquet") -> None:
    """Rebuild the Gold tables from the typed Silver tables, which have one row per key."""
    customers, accounts, loans, transactions = (
        scan_layer(spark, lake_dir, "silver_typed", name, fmt).drop("ingestion_processed_at")
        for name in ("customers", "accounts", "loans", "transactions")
    )
    outputs = {
        "customer_credit_snapshot": gold_customer_credit_snapshot(customers, loans, unique_ids=True),
        "daily_transaction_monitoring": gold_daily_transaction_monitoring(transactions, unique_ids=True),
        "mart_account_health": mart_account_health(accounts, customers),
    }
    for name, df in outputs.items():
        overwrite_layer(df, f"{lake_dir}/gold_typed/{name}", fmt)
