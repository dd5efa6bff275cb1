"""Scratch space and session settings."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from riskloom.operators.sizing import fits, spread
from riskloom.session import RUNTIME_CONF, scratch_path, tune


def test_scratch_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(shared + "/x-") and first != second


def test_a_cluster_without_a_shared_folder_is_an_error():
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077")
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(session, "x")
    session.sparkContext.master = "local[2]"
    assert "/x-" in scratch_path(session, "x")


def test_tune_sets_the_runtime_settings(spark):
    tune(spark)
    assert all(spark.conf.get(key) == value for key, value in RUNTIME_CONF.items())


def test_fits_measures_rows_and_bytes(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 100) AS t")
    assert fits(df, 100, 100_000)
    assert not fits(df, 99, 100_000)
    assert not fits(df, 100, 5_000)
    assert fits(df.where("false"), 0, 0)


def test_spread_leaves_large_scans_alone(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 100, 1, 2).write.parquet(str(tmp_path / "few"))
    few = spread(spark.read.parquet(str(tmp_path / "few")), "id")
    assert few.rdd.getNumPartitions() == cores and few.count() == 100
    many = spark.range(0, 100, 1, cores + 1)
    assert spread(many, "id") is many
