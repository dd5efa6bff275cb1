"""Tables as snapshots: a log of versions, each of which names the folders that hold the table's rows.

A write makes new folders and then a new version, which appears in one step. Readers take the newest version and read its
folders, which no later write touches; a write that fails leaves the table as it was. Versions and folders that are no
longer current stay for a while, so readers that began earlier can end, and ``vacuum`` removes them afterwards. One
writer at a time: a version that is there already is an error. Files are reached through Hadoop's file system, so a table
may lie wherever Spark reads.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

LOG = "_versions"  # Spark's readers skip names with an underscore
KEEP_VERSIONS = 10
KEEP_HOURS = 24.0


@dataclass(frozen=True)
class Snapshot:
    """A version of a table: its folders, relative to the table, with what is known of each, and notes on the whole."""

    version: int
    parts: dict[str, dict]
    notes: dict = field(default_factory=dict)


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str) -> Iterator:
    """File statuses of what lies in a folder; none if it is not there."""
    system, place = _place(spark, path)
    return iter(system.listStatus(place)) if system.exists(place) else iter(())


def _versions(spark: SparkSession, path: str) -> dict[int, object]:
    named = ((re.fullmatch(r"(\d+)\.json", status.getPath().getName()), status) for status in
             folders(spark, f"{path}/{LOG}"))
    return {int(match[1]): status for match, status in named if match}


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The newest version of a table or a given one; None if it has none."""
    found = _versions(spark, path)
    if version is None:
        version = max(found, default=None)
    if version not in found:
        return None
    system, place = _place(spark, f"{path}/{LOG}/{version}.json")
    with closing(system.open(place)) as stream:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    return Snapshot(version, **json.loads(text))


def new_part() -> str:
    """A folder name for rows to come."""
    return f"part-{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, before: Snapshot | None, parts: dict[str, dict],
           notes: dict | None = None) -> Snapshot:
    """Make ``parts`` the table's rows, if ``before`` is still its newest version."""
    after = Snapshot(before.version + 1 if before else 0, parts, notes or {})
    system, place = _place(spark, f"{path}/{LOG}/{after.version}.json")
    _, draft = _place(spark, f"{path}/{LOG}/.{uuid.uuid4().hex}")
    with closing(system.create(draft, True)) as stream:
        stream.write(bytearray(json.dumps({"parts": after.parts, "notes": after.notes}).encode()))
    if system.exists(place) or not system.rename(draft, place):
        system.delete(draft, False)
        raise RuntimeError(f"{path} has another writer: version {after.version} is there already")
    return after


def read_parts(spark: SparkSession, path: str, parts: list[str], schema: str | None = None) -> DataFrame:
    """The rows of some folders of a table, under a given schema or all their columns."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    return reader.parquet(*[f"{path}/{part}" for part in parts])


def read_snapshot(spark: SparkSession, path: str, schema: str | None = None, version: int | None = None) -> DataFrame:
    """The rows of a table as of its newest version or a given one, without the columns that its notes hide."""
    found = snapshot(spark, path, version)
    schema = schema or (found.notes.get("schema") if found and not found.parts else None)
    if found is None or not (found.parts or schema):
        raise FileNotFoundError(f"{path} has no version {'' if version is None else version}".rstrip())
    rows = read_parts(spark, path, list(found.parts), schema) if found.parts else spark.createDataFrame([], schema)
    return rows.drop(*found.notes.get("hidden", []))


def replace_table(df: DataFrame, path: str, notes: dict | None = None, options: dict | None = None) -> Snapshot:
    """Replace a table, schema included; readers see the old rows until all new ones are there."""
    spark, part = df.sparkSession, new_part()
    df.write.options(**(options or {})).parquet(f"{path}/{part}")
    done = commit(spark, path, snapshot(spark, path), {part: {}}, notes)
    vacuum(spark, path)
    return done


def vacuum(spark: SparkSession, path: str, keep_versions: int = KEEP_VERSIONS, keep_hours: float = KEEP_HOURS) -> list[str]:
    """Remove versions before the newest ``keep_versions`` and folders that no version names any more.

    Nothing younger than ``keep_hours`` goes, so that neither a reader nor an unfinished write loses its files. Returns
    the names removed.
    """
    system, _ = _place(spark, path)
    oldest, removed = (time.time() - keep_hours * 3600) * 1000, []
    versions = _versions(spark, path)
    for version in sorted(versions)[:-keep_versions]:
        if versions[version].getModificationTime() <= oldest:
            system.delete(versions[version].getPath(), False)
            removed.append(f"{version}.json")
    named = {part.split("/")[0] for version in _versions(spark, path) for part in snapshot(spark, path, version).parts}
    for status in folders(spark, path):
        name = status.getPath().getName()
        if name.startswith("part-") and name not in named and status.getModificationTime() <= oldest:
            system.delete(status.getPath(), True)
            removed.append(name)
    return removed
