"""Readers of raw files and layer tables."""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.functions.text import strip
from riskloom.operators.retrieval import corpus_documents
from riskloom.operators.sizing import fits
from riskloom.schemas import AUDIT_LINE, CORE_TABLES, OPTIONAL_TABLES
from riskloom.sources.csv_records import QUOTE, csv_records, numbered_records, parsed_records
from riskloom.sources.snapshots import folders, read_snapshot, snapshot

# File kinds of the document corpus, the fund register's columns and the macro series ids.
CORPUS_EXTENSIONS = ("md", "sql", "yml", "yaml", "json")
REGISTER_COLUMNS = {
    "CNPJ_FUNDO": "cnpj",
    "DENOM_SOCIAL": "fund_name",
    "TP_FUNDO": "fund_type",
    "SITUACAO": "status",
    "CLASSE": "class_type",
    "VL_PATRIM_LIQ": "net_worth",
}
SERIES_IDS = {"selic": 11, "credit_free_total": 20542}


def raw_tables(spark: SparkSession, raw_dir: str) -> list[str]:
    """Names of the tables in a raw directory: each ``<table>.csv`` is one file or a folder of part files."""
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(raw_dir).select("path")
    except AnalysisException as error:
        raise FileNotFoundError(f"Raw directory not found: {raw_dir}") from error
    name = F.regexp_extract("path", r"/([^/]+)\.csv(?:/[^/]+)?$", 1)
    names = [row[0] for row in listed.select(name.alias("name")).where("name <> ''").distinct().collect()]
    if not names:
        raise FileNotFoundError(f"No CSV files found in {raw_dir}")
    return sorted(names)


def _header(spark: SparkSession, path: str, multi_line: bool) -> StructType:
    """The columns that the header of a CSV names, all text."""
    return spark.read.options(header=True, escape=QUOTE, multiLine=multi_line).csv(path).schema


def scan_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A raw CSV with every column as text, under the names its header gives; a ragged row is an error.

    Quotes inside a field are doubled and a backslash is a plain character. Fields with line breaks need
    ``multi_line``, which finds the records of a file in parallel first; without it such a row is ragged.
    """
    if multi_line:
        return _records(spark, path)
    return (
        spark.read.schema(_header(spark, path, False))
        .options(header=True, escape=QUOTE, mode="FAILFAST", enforceSchema=False)
        .csv(path)
    )


def scan_csv_numbered(spark: SparkSession, path: str, multi_line: bool = False, name: str = "row_id") -> DataFrame:
    """``scan_csv`` with each row's place in the files, from 1, files in path order."""
    if not multi_line:
        return with_row_numbers(scan_csv(spark, path), name)
    return _records(spark, path, name)


def _records(spark: SparkSession, path: str, number: str | None = None) -> DataFrame:
    """The rows of a CSV with line breaks in fields, every file's header checked; with their ``number`` if it is named."""
    names = _header(spark, path, True).names
    records, plain = csv_records(spark, path), {"escape": QUOTE}
    first = [f"c{k}" for k in range(len(names))]
    heads = parsed_records(records.where("header"), first, plain)
    if heads.select(*[F.lower(c) for c in first]).distinct().limit(2).count() > 1:
        raise ValueError(f"The files of {path} have different headers")
    if number:
        return parsed_records(numbered_records(records, number), names, plain, number)
    return parsed_records(records.where("not header"), names, plain)


def with_row_numbers(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows of a file scan with their place in the files, from 1, files in path order.

    Spark reads each file split in order, so a row's number is the rows of the splits before its own plus its place
    there. Only the splits are put in one order; the rows are neither sorted nor shuffled.
    """
    split = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    placed = df.select("*", *split, F.monotonically_increasing_id().alias("_id"))
    splits = placed.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    in_order = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(in_order), F.lit(0))).drop("_rows")
    if fits(offsets):
        offsets = F.broadcast(offsets)
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return placed.join(offsets, ["_file", "_start"]).select(number.alias(name), *df.columns)


def scan_raw(spark: SparkSession, raw_dir: str, multi_line: bool = False) -> dict[str, DataFrame]:
    """Every CSV of a raw directory."""
    return {name: scan_csv(spark, f"{raw_dir}/{name}.csv", multi_line) for name in raw_tables(spark, raw_dir)}


def scan_core(spark: SparkSession, raw_dir: str, multi_line: bool = False) -> dict[str, DataFrame]:
    """The core tables, which must all be there, and those optional ones that are."""
    found = raw_tables(spark, raw_dir)
    for name in CORE_TABLES:
        if name not in found:
            raise FileNotFoundError(f"Missing CSV file: {raw_dir}/{name}.csv")
    wanted = [name for name in (*CORE_TABLES, *OPTIONAL_TABLES) if name in found]
    return {name: scan_csv(spark, f"{raw_dir}/{name}.csv", multi_line) for name in wanted}


def read_layer_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table of any layer: its newest snapshot, or the plain files of batches."""
    if fmt == "parquet" and snapshot(spark, path):
        return read_snapshot(spark, path)
    return spark.read.format(fmt).load(path)


def scan_layer(spark: SparkSession, lake_dir: str, layer: str, table: str, fmt: str = "parquet") -> DataFrame:
    """A layer table; of batches ``batch_id`` is a partition column, so a filter on it prunes directories."""
    return read_layer_table(spark, f"{lake_dir}/{layer}/{table}", fmt)


def batch_marks(spark: SparkSession, path: str) -> dict[str, str]:
    """The batches of a layer table by id, each with a mark that changes when it is written again."""
    found = {}
    for status in folders(spark, path):
        name = status.getPath().getName()
        if name.startswith("batch_id="):
            files = sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}"
                           for f in folders(spark, status.getPath().toString()))
            batch = unquote(name.removeprefix("batch_id="))
            found[batch] = hashlib.md5("\n".join(files).encode()).hexdigest()
    return found


def scan_jsonl(spark: SparkSession, path: str, schema: str = AUDIT_LINE) -> DataFrame:
    """JSON lines under a fixed schema; blank lines are skipped and a malformed one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_register(spark: SparkSession, path: str) -> DataFrame:
    """The fund register as landed: semicolons, Latin-1."""
    return spark.read.options(sep=";", header=True, encoding="ISO-8859-1", escape=QUOTE).csv(path)


def scan_series(spark: SparkSession, path: str) -> DataFrame:
    """A macro series as landed: JSON arrays, or single objects, of text pairs."""
    return spark.read.schema("data string, valor string").option("multiLine", True).json(path)


def scan_corpus(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(source, text)`` of the documents under some paths, one row per file; a local file by its plain path."""
    path = F.regexp_replace(F.url_decode("_metadata.file_path"), "^file:(?://)?", "")
    files = (
        spark.read.text(paths, wholetext=True, recursiveFileLookup=True)
        .select(path.alias("path"), F.col("value").alias("text"))
    )
    return corpus_documents(files, CORPUS_EXTENSIONS)


def normalize_register(frame: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Register rows under the contract's names; a missing column is null. ``max_rows`` keeps the first by key."""
    named = frame.withColumnsRenamed({old: new for old, new in REGISTER_COLUMNS.items() if old in frame.columns})
    kept = named.select(
        *[F.col(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in REGISTER_COLUMNS.values()]
    )
    return kept if max_rows is None else kept.orderBy(*REGISTER_COLUMNS.values()).limit(max_rows)


def normalize_series(frame: DataFrame, indicator_name: str, series_id: int | None = None) -> DataFrame:
    """Series rows with an ISO date and a number; a value that is not a number becomes null."""
    return frame.select(
        F.to_date("data", "d/M/yyyy").alias("observation_date"),
        F.lit(indicator_name).alias("indicator_name"),
        F.lit(SERIES_IDS[indicator_name] if series_id is None else series_id).alias("series_id"),
        strip(F.col("valor")).try_cast("decimal(18,4)").alias("value"),
    )


def union_series(frames: dict[str, DataFrame]) -> DataFrame:
    """All series, normalised, in one table; the key of each frame is its indicator name."""
    parts = [normalize_series(frame, name) for name, frame in frames.items()]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def audit_rows(lines: DataFrame) -> DataFrame:
    """Audit lines as table rows: the citation list joined to one text."""
    return lines.withColumn("citations", F.array_join("citations", ", "))
