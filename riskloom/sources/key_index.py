"""Uniqueness over many batches: an index of value digests that only new rows probe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import staged
from riskloom.sources.keyed import PART_ROWS, current_rows, merge_rows
from riskloom.sources.snapshots import read_snapshot, snapshot

KEYS = ["digest", "batch_id"]


def check_batch(rows: DataFrame, column: str, batch_id: str, path: str, nulls: bool = False,
                part_rows: int = PART_ROWS) -> DataFrame:
    """The values of a batch that are not unique, and the batch added to the index at ``path``.

    Returns ``(value, rows, earlier_batch, duplicates)``: ``earlier_batch`` is the least other batch that holds the value,
    null if none does, and ``duplicates`` counts the rows beyond the value's first occurrence. Values are taken as they
    are, empty ones included; null ones count as a value only with ``nulls``. The index has a digest per value and batch,
    so earlier batches' rows are not read, and of the index only the parts that may hold the new values. A batch that is
    checked again takes the place of its former rows.
    """
    spark = rows.sparkSession
    values = rows.select(F.col(column).cast("string").alias("value"))
    if not nulls:
        values = values.where("value is not null")
    digest = F.sha2(F.concat(F.when(F.col("value").isNull(), "0").otherwise("1"), F.coalesce("value", F.lit(""))), 256)
    counted = values.groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    counted = staged(counted.withColumn("digest", digest), "batch-values")
    known = current_rows(spark, path, KEYS[:1], counted)
    if known is None:
        known = spark.createDataFrame([], "digest string, batch_id string")
    others = known.where(F.col("batch_id") != batch_id).groupBy("digest").agg(F.min("batch_id").alias("earlier_batch"))
    met = counted.join(others, "digest", "left")
    extra = F.when(F.col("earlier_batch").isNull(), F.col("rows") - 1).otherwise(F.col("rows"))
    report = staged(met.select("value", "rows", "earlier_batch", extra.alias("duplicates")).where("duplicates > 0"),
                    "batch-duplicates")

    before = snapshot(spark, path)
    batches = before.notes["batches"] if before else []
    gone = None
    if batch_id in batches:
        gone = read_snapshot(spark, path).where(F.col("batch_id") == batch_id).select(*KEYS)
    fresh = counted.select("digest", F.lit(batch_id).alias("batch_id"))
    merge_rows(path, fresh, KEYS, [F.asc("batch_id")], {"batches": sorted({*batches, batch_id})}, gone,
               part_rows=part_rows, part_by=KEYS[:1])
    return report
