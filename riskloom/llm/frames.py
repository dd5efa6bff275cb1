"""Shared pieces of the operators: table reads, written intermediate results, native word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riskloom.session import scratch_path, setting

# White space that separates words, and words as the dealt contracts define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

BATCH_BYTES = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(spark: SparkSession) -> None:
    """Bounds the batches that rows with whole texts travel to Python in, for the rest of the session.

    Batches are made when a plan runs, so the setting has to outlast the call that builds the plan.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, label: str, options: dict | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder, which cuts its lineage and outlives lost executors.

    The shuffle files of the job that writes it are removed when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes ``written`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def counted(df: DataFrame, label: str, condition: str = "true") -> tuple[DataFrame, int]:
    """``df`` written, and how many of its rows meet a condition, which the write itself counts."""
    seen = Observation()
    rows = written(df.observe(seen, F.count_if(F.expr(condition)).alias("rows")), label)
    return rows, seen.get["rows"]


def n_words(text: str) -> Column:
    """Words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: str) -> Column:
    """Whether a document is kept from training: the checksum of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
