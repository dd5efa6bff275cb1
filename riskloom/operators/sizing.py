"""Size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast by hint only within both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is within the bounds, measured; stops reading one row beyond."""
    measured = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")
    ).first()
    return measured["rows"] <= max_rows and (measured["bytes"] or 0) <= max_bytes


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Rows of a file scan over all cores, for work that costs far more than moving the rows.

    A scan with fewer tasks than cores (few or coarse files) is shuffled by ``key``, which should be unique; a larger
    scan, as on a cluster's full data, is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan
