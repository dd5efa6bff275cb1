"""An index of a changing corpus: only new and changed documents get a vector, and removed ones go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import staged
from riskloom.sources.keyed import PART_ROWS, merge_rows
from riskloom.sources.snapshots import read_snapshot, snapshot

KEY = ["vec_id"]


def corpus_changes(texts: DataFrame, path: str) -> DataFrame:
    """``(vec_id, digest, change)``: documents that are new, changed or removed since the index at ``path`` was written.

    ``texts(vec_id, source, text)`` is the whole corpus, one row per id; ids and digests are all that is shuffled.
    """
    spark = texts.sparkSession
    parts = [F.coalesce(F.concat(F.lit("1"), F.col(c)), F.lit("0")) for c in ("source", "text")]
    sums = [F.sha2(part, 256) for part in parts]
    now = texts.select("vec_id", F.sha2(F.concat(*sums), 256).alias("digest"))
    before = snapshot(spark, path)
    if before is None:
        return now.withColumn("change", F.lit("new"))
    was = read_snapshot(spark, path).select(F.col("vec_id").alias("was_id"), F.col("digest").alias("was_digest"))
    met = now.join(was, now["vec_id"] == was["was_id"], "full")
    change = (F.when(F.col("was_id").isNull(), "new").when(F.col("vec_id").isNull(), "removed")
              .when(F.col("digest") != F.col("was_digest"), "changed"))
    return met.select(F.coalesce("vec_id", "was_id").alias("vec_id"), "digest", change.alias("change")).where(
        "change is not null")


def update_index(texts: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame],
                 part_rows: int = PART_ROWS) -> dict[str, int]:
    """Bring the index ``(vec_id, vector, source, text, digest)`` up to date; returns the number of changes by kind.

    ``embed`` adds ``vector`` to the rows it is given, which are the new and changed documents only. Nothing is written
    where nothing changed, and only the parts that hold changed ids are written anew.
    """
    changes = staged(corpus_changes(texts, path), "corpus-changes")
    counts = {row["change"]: row["count"] for row in changes.groupBy("change").count().collect()}
    if counts:
        wanted = texts.select("vec_id", "source", "text").join(changes.where("change <> 'removed'"), "vec_id")
        rows = embed(wanted.drop("change")).select("vec_id", "vector", "source", "text", "digest")
        merge_rows(path, rows, KEY, [F.asc("digest")], gone=changes, part_rows=part_rows)
    return counts


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(vec_id, vector, source, text)`` of the index."""
    return read_snapshot(spark, path).drop("digest")
