"""Writers: layer batches, warehouse tables, manifests, event and audit files."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riskloom.schemas import AUDIT_LINE, COMMENTS, MART_SCHEMA, MARTS, RAW_SCHEMA, SCHEMA_COMMENTS, TABLES
from riskloom.sources.files import audit_rows, scan_core, scan_jsonl
from riskloom.sources.snapshots import replace_table

# Fixed value: rows per insert of a JDBC load.
JDBC_BATCH_ROWS = 1000
FILE_BYTES = 64 * 1024 * 1024


def new_batch_id() -> str:
    """Default batch id: the UTC time, fit for a directory name."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H-%M-%SZ")


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    """Write a CSV folder with a header; quotes inside fields are doubled."""
    df.write.options(header=True, sep=sep, encoding=encoding, quote='"', escape='"').csv(path)


def write_csv_in_order(df: DataFrame, key: Column, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write a CSV folder whose files, in path order, hold the rows in the order of ``key``.

    A file is written by one task, so there are as many files as the texts have ``file_bytes``.
    """
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in df.dtypes if kind == "string"]
    n_bytes = df.agg(F.sum(sum(texts, F.lit(0)).cast("bigint"))).first()[0] or 0
    n_files = max(1, -(-n_bytes // file_bytes))
    write_csv(df.repartitionByRange(n_files, key).sortWithinPartitions(key), path)


def write_batch(df: DataFrame, lake_dir: str, layer: str, table: str, batch_id: str, fmt: str = "parquet") -> int:
    """Write one batch of a layer table and return its row count, measured by the write itself.

    Only the batch's own partition is replaced, so a rerun of a failed job is safe. The partition directory is written
    as such, which spares the sort by partition value that a partitioned write makes.
    """
    counter = Observation()
    counted = df.observe(counter, F.count(F.lit(1)).alias("rows"))
    path = f"{lake_dir}/{layer}/{table}"
    if fmt == "delta":
        writer = counted.withColumn("batch_id", F.lit(batch_id)).write.partitionBy("batch_id")
        writer.format(fmt).mode("overwrite").option("replaceWhere", f"batch_id = '{batch_id}'").save(path)
    else:
        counted.write.format(fmt).mode("overwrite").save(f"{path}/batch_id={batch_id}")
    return counter.get["rows"]


def overwrite_layer(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a layer table, schema included, in one step: a failed write leaves it, and earlier readers end undisturbed.

    A Parquet table is kept as snapshots and read with ``read_layer_table``; Delta has its own log.
    """
    if fmt == "delta":
        df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true").save(path)
    else:
        replace_table(df, path)


def publish_bronze(tables: dict[str, DataFrame], lake_dir: str, batch_id: str | None = None) -> dict[str, int]:
    """Write each raw table unchanged as a Bronze batch; returns row counts."""
    batch = batch_id or new_batch_id()
    return {name: write_batch(df, lake_dir, "bronze", name, batch) for name, df in tables.items()}


def layer_manifest(spark: SparkSession, lake_dir: str, batch_id: str, tables: dict[str, list[str]]) -> DataFrame:
    """``(batch_id, layer, table_name, file, row_count)`` of a batch; ``tables`` lists the tables per layer.

    Parquet answers the counts from file footers, and the file list stays a DataFrame.
    """
    parts = [
        spark.read.parquet(f"{lake_dir}/{layer}/{table}")
        .where(F.col("batch_id") == batch_id)
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(batch_id).alias("batch_id"), F.lit(layer).alias("layer"), F.lit(table).alias("table_name"),
                "file", "row_count")
        for layer, names in tables.items()
        for table in names
    ]
    manifest = parts[0]
    for part in parts[1:]:
        manifest = manifest.unionByName(part)
    return manifest


def write_manifest(manifest: DataFrame, lake_dir: str, batch_id: str) -> str:
    """Write a batch manifest as JSON lines."""
    path = f"{lake_dir}/manifest/{batch_id}"
    manifest.write.mode("overwrite").json(path)
    return path


def declare_tables(spark: SparkSession) -> None:
    """Create the raw and mart schemas and their empty tables, with comments."""
    for schema, tables in ((RAW_SCHEMA, TABLES), (MART_SCHEMA, MARTS)):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema} COMMENT '{SCHEMA_COMMENTS[schema]}'")
        for name, columns in tables.items():
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {schema}.{name} ({columns}) USING parquet COMMENT '{COMMENTS[name]}'"
            )


def load_table(df: DataFrame, name: str, schema: str = RAW_SCHEMA) -> None:
    """Replace a warehouse table in full."""
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(f"{schema}.{name}")
    if name in COMMENTS:
        spark.sql(f"COMMENT ON TABLE {schema}.{name} IS '{COMMENTS[name]}'")


def load_warehouse(spark: SparkSession, raw_dir: str, multi_line: bool = False) -> DataFrame:
    """Load the raw tables into the warehouse; returns ``(table_name, row_count)``."""
    tables = scan_core(spark, raw_dir, multi_line)
    for name, df in tables.items():
        load_table(df, name)
    return row_counts({name: spark.table(f"{RAW_SCHEMA}.{name}") for name in tables})


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)`` of each table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part)
    return counted


def load_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Replace a table of an outside database; needs its driver jar."""
    df.write.mode("overwrite").options(batchsize=JDBC_BATCH_ROWS, **options).jdbc(url, table)


def append_audit(records: DataFrame, path: str) -> None:
    """Append audit records (citations as a list) as JSON lines; null fields are kept."""
    records.write.mode("append").option("ignoreNullFields", False).json(path)


def load_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit lines as table rows; no file gives an empty table."""
    try:
        lines = scan_jsonl(spark, path)
    except AnalysisException:
        lines = spark.createDataFrame([], AUDIT_LINE)
    return audit_rows(lines)


def index_corpus(documents: DataFrame, path: str, force: bool = False) -> bool:
    """Write ``(vec_id, vector, source, text)`` once; a filled index is kept unless forced. Returns whether written."""
    spark = documents.sparkSession
    if not force:
        try:
            if not spark.read.parquet(path).isEmpty():
                return False
        except AnalysisException:
            pass
    documents.select("vec_id", "vector", "source", "text").write.mode("overwrite").parquet(path)
    return True
