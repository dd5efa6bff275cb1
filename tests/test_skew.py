"""A key that holds a third of all rows must not end up in one task."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from riskloom.operators import contracts
from riskloom.operators.joins import join_lookup, join_split
from riskloom.operators.retrieval import keyword_topk, vector_topk
from riskloom.plans import copilot, marts

SMALL_TASKS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
}


@contextmanager
def small_tasks(spark):
    for key, value in SMALL_TASKS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in SMALL_TASKS:
            spark.conf.unset(key)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def hot_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40_000))
    spark.range(0, 200_000, 1, 16).select("id", key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad")) \
        .write.parquet(path)
    return spark.read.parquet(path)


def test_duplicate_rows_split_the_hot_value(spark, hot_rows):
    with small_tasks(spark):
        found = contracts.duplicate_rows(hot_rows, "k", "id")
        assert "FileScan" in final_plan(found) and final_plan(found).count("FileScan") <= 6
        total = found.count()
        hot = found.where("value = 'hot'").count()
    assert hot == 66_666
    assert total == hot_rows.count() - hot_rows.select("k").distinct().count()


def test_join_lookup_matches_a_plain_join(spark, hot_rows):
    lookup = hot_rows.where("k <> 'k7'").groupBy("k").agg(F.max("id").alias("top"))
    missing_hot = lookup.where("k <> 'hot'")
    for how in ("inner", "left"):
        for side in (lookup, missing_hot):
            plain = hot_rows.join(side, "k", how)
            apart = join_lookup(hot_rows, side, "k", how, split_rows=1000)
            assert apart.count() == plain.count()
            assert apart.exceptAll(plain.select(apart.columns)).count() == 0


def test_join_split_matches_a_plain_join(spark, hot_rows):
    other = spark.createDataFrame([("hot", i) for i in range(5)] + [("k7", 1), ("k7", 2), ("none", 1)],
                                  "k string, m int")
    rows = hot_rows.select("k", "id")
    plain = rows.join(other, "k")
    split = join_split(rows, other, "k", "id", split_rows=1000)
    assert split.count() == plain.count() and split.exceptAll(plain.select(split.columns)).count() == 0


def test_join_below_an_aggregate_splits_the_hot_key(spark, hot_rows, tmp_path):
    """The forced skew rule also covers a join whose partitioning the next aggregate could reuse."""
    path = str(tmp_path / "parents")
    hot_rows.select("k").distinct().withColumn("score", F.length("k")).write.parquet(path)
    parents = spark.read.parquet(path)
    with small_tasks(spark):
        joined = hot_rows.join(parents, "k").groupBy("k").agg(F.sum("score").alias("s"), F.max("pad").alias("p"))
        assert "skew=true" in final_plan(joined)


def test_hot_customer_is_combined_before_the_shuffle(spark, tmp_path):
    loans = spark.range(0, 100_000, 1, 16).select(
        F.col("id").alias("loan_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("customer_id"),
        F.lit(1).cast("decimal(18,2)").alias("principal_amount"),
        F.lit(1).cast("decimal(18,2)").alias("outstanding_balance"), F.lit(3).alias("days_past_due"),
        F.lit("A").alias("risk_rating"),
    )
    customers = spark.range(500).select(
        F.col("id").alias("customer_id"), F.lit("s").alias("segment"), F.lit("x").alias("state"),
        F.lit(1).alias("internal_score"),
    )
    mart = marts.mart_customer_exposure(customers, loans)
    hot = mart.where("customer_id = 0").first()
    assert hot["loan_count"] == 33334 + len([i for i in range(100_000) if i % 3 and i % 500 == 0])
    assert mart.agg(F.sum("loan_count")).first()[0] == 100_000


def test_null_keys_are_kept_and_spread_in_a_left_join(spark, hot_rows):
    rows = hot_rows.select(F.when(F.col("k") != "hot", F.col("k")).alias("k"), "id")
    lookup = rows.where("k is not null").groupBy("k").agg(F.max("id").alias("top"))
    apart = join_lookup(rows, lookup, "k", "left", split_rows=1000)
    assert apart.count() == 200_000 and apart.where("top is null").count() == 66_667


def test_hot_question_is_retrieved_once_and_not_shuffled(spark, monkeypatch):
    questions = spark.range(0, 20_000, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, "show exposure by segment").otherwise(
            F.concat(F.lit("question "), F.col("id") % 50)).alias("question")
    )
    corpus = spark.createDataFrame([("a.md", "exposure by segment"), ("b.md", "question 7 7 7")],
                                   "source string, text string")
    answers = copilot.answer_batch(questions, corpus)
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [question" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(copilot, "fits", lambda df: False)
    apart = copilot.answer_batch(questions, corpus)
    assert apart.exceptAll(answers.select(apart.columns)).count() == 0 and apart.count() == 20_000
    counted = {tuple(r["citations"]): r["count"] for r in answers.groupBy("citations").count().collect()}
    assert counted[("a.md",)] == 6667
    assert answers.count() == 20_000


def test_copies_of_a_document_and_of_a_vector_keep_the_order(spark):
    corpus = spark.range(0, 3000, 1, 6).select(
        F.format_string("d%05d", "id").alias("source"),
        F.when(F.col("id") % 3 == 0, "same same").otherwise("other").alias("text"),
    )
    asked = spark.createDataFrame([("same",)], "question string")
    hits = keyword_topk(asked, corpus, 3).orderBy("rank").collect()
    assert [r["source"] for r in hits] == ["d00000", "d00003", "d00006"]
    vectors = spark.range(0, 3000, 1, 6).select(
        F.format_string("v%05d", "id").alias("vec_id"),
        F.when(F.col("id") % 3 == 1, F.array(F.lit(0.1), F.lit(0.7))).otherwise(
            F.array(F.rand(3), -F.rand(4))).alias("vector"),
    )
    query = spark.createDataFrame([("q", [0.1, 0.7])], "query_id string, vector array<double>")
    near = vector_topk(query, vectors, 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in near] == ["v00001", "v00004", "v00007"]
