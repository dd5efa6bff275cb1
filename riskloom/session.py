"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Runtime SQL settings the plans rely on. Forcing the skew-join rule lets AQE split a hot join key even when
# the aggregate above the join would otherwise reuse the join's partitioning. The running totals of a stream live in
# RocksDB, so their size is bound by disk and not by the executor's heap. Rows that hold a block of an index travel to
# Python in batches of bounded bytes.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller owns. They stay set, the time zone and skew rule included."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A runtime setting for the length of a block; the caller's value comes back after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def local_session(app: str = "riskloom", cores: str = "8", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; on a cluster the submitter builds the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="riskloom-warehouse-"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="riskloom-")


def staged(df: DataFrame, label: str, options: dict | None = None) -> DataFrame:
    """``df`` as a table in the shared scratch folder, so that it is computed once and its size is known."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_with(df: DataFrame, label: str, *measures: Column) -> tuple[DataFrame, dict]:
    """``staged`` with named aggregates over the rows, which the write itself takes."""
    seen = Observation()
    return staged(df.observe(seen, *measures), label), seen.get


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's shared checkpoint folder; a machine-local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
