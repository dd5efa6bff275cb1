"""Snapshot tables with one row per key, brought up to date by rewriting only the parts that hold changed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.dedupe import latest_per_key
from riskloom.session import staged, staged_with
from riskloom.sources.snapshots import Snapshot, commit, folders, new_part, read_parts, snapshot, vacuum

# Rows and bytes of a part, on average when the parts are dealt, and the folder column that names the part. A part is
# written by one task, so rows with long texts make more parts. Parts are dealt anew when they hold so many times as much.
PART_ROWS = 1_000_000
PART_BYTES = 64 * 1024 * 1024
PART = "key_part"
GROWN = 4


def _dealt(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    return rows.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: its texts, its lists, and eight for any other value."""
    plain = {"string": F.octet_length, "binary": F.octet_length}
    sizes = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in plain:
            size = plain[kind](column)
        elif kind.startswith(("array<string", "array<array", "array<struct", "array<binary", "array<map", "struct", "map")):
            size = F.octet_length(F.to_json(F.struct(column)))
        elif kind.startswith("array"):
            size = 8 * F.greatest(F.size(column), F.lit(0))
        else:
            size = F.lit(8)
        sizes.append(F.coalesce(size, F.lit(0)).cast("bigint"))
    return sum(sizes[1:], sizes[0])


def current_rows(spark: SparkSession, path: str, keys: list[str], wanted: DataFrame) -> DataFrame | None:
    """The table's rows in those parts that may hold keys of ``wanted``, by what its parts are dealt by; None if none do."""
    found = snapshot(spark, path)
    if found is None or not found.parts:
        return None
    touched = {row[0] for row in _dealt(wanted.select(*keys), keys, found.notes["parts"]).select(PART).distinct().collect()}
    names = [name for name, known in found.parts.items() if known["part"] in touched]
    return read_parts(spark, path, names) if names else None


def merge_rows(path: str, rows: DataFrame, keys: list[str], newest_first: list, notes: dict | None = None,
               gone: DataFrame | None = None, replace: bool = False, part_rows: int = PART_ROWS,
               part_by: list[str] | None = None) -> Snapshot:
    """Add ``rows`` to a table, of which the first in the given order stays per key, and take out the keys of ``gone``.

    Rows lie in parts by a hash of their key, or of some of its columns (``part_by``). Only parts that hold a key of ``rows`` or ``gone`` are read and written
    anew, unless ``replace`` makes ``rows`` the whole table or the parts have grown and all are dealt anew. The new
    version appears in one step.
    """
    spark, by = rows.sparkSession, part_by or keys
    fresh, sizes = staged_with(rows, "merge-rows", F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(rows)).alias("bytes"))
    taken = staged(gone.select(*keys).distinct(), "merge-gone") if gone is not None else None
    before = snapshot(spark, path)
    old = before.parts if before and not replace else {}
    n_rows = sizes["rows"] + sum(known["rows"] for known in old.values())
    n_bytes = (sizes["bytes"] or 0) + sum(known.get("bytes", 0) for known in old.values())
    parts = before.notes["parts"] if old else 0
    if not parts or n_rows > GROWN * part_rows * parts or n_bytes > GROWN * PART_BYTES * parts:
        parts = max(1, -(-n_rows // part_rows), -(-n_bytes // PART_BYTES))
        touched = set(range(parts))
        read = list(old)
    else:
        wanted = fresh.select(*keys) if taken is None else fresh.select(*keys).unionByName(taken)
        touched = {row[0] for row in _dealt(wanted, by, parts).select(PART).distinct().collect()}
        read = [name for name, known in old.items() if known["part"] in touched]
    kept = {name: known for name, known in old.items() if name not in read}
    merged = fresh
    if read:
        stay = read_parts(spark, path, read)
        if taken is not None:
            same = [stay[key].eqNullSafe(taken[key]) for key in keys]
            stay = stay.join(taken, same, "left_anti")
        merged = stay.unionByName(fresh, allowMissingColumns=True)
    merged = _dealt(latest_per_key(merged, keys, newest_first), by, parts)
    folder = new_part()
    # Every part is the whole of one task.
    merged.repartitionById(parts, PART).write.partitionBy(PART).parquet(f"{path}/{folder}")
    written, schema = {}, merged.drop(PART).schema.toDDL()
    if any(status.getPath().getName().startswith(f"{PART}=") for status in folders(spark, f"{path}/{folder}")):
        rows_of = spark.read.parquet(f"{path}/{folder}")
        sums = rows_of.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(rows_of.drop(PART))).alias("bytes"))
        for row in sums.collect():
            written[f"{folder}/{PART}={row[PART]}"] = {"part": row[PART], "rows": row["rows"], "bytes": row["bytes"]}
    done = commit(spark, path, before, {**kept, **written}, {**(notes or {}), "parts": parts, "schema": schema})
    vacuum(spark, path)
    return done
