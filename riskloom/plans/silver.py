"""Silver: standard names, one row per key, typed columns, a processing stamp."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.dedupe import distinct_rows, one_per_key
from riskloom.schemas import TABLES, columns_of


def standard_names(df: DataFrame) -> DataFrame:
    """Column names stripped and in lower case."""
    return df.toDF(*[name.strip().lower() for name in df.columns])


def stamp(df: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Add when the rows were processed (now, unless given)."""
    return df.withColumn("ingestion_processed_at", F.current_timestamp() if processed_at is None else processed_at)


def standardize(df: DataFrame, processed_at: datetime | str) -> DataFrame:
    """Standard names, whole-row dedupe and an ISO text stamp."""
    text = processed_at if isinstance(processed_at, str) else processed_at.isoformat()
    return stamp(distinct_rows(standard_names(df)), F.lit(text))


def _clean(table: str) -> Callable[[DataFrame], DataFrame]:
    """Cast the columns of a table that are not text; other columns pass through. Series ids keep their type."""
    casts = {name: kind for name, kind in columns_of(TABLES[table]) if kind != "string" and name != "series_id"}

    def clean(df: DataFrame) -> DataFrame:
        return df.withColumns({name: F.col(name).cast(kind) for name, kind in casts.items() if name in df.columns})

    return clean


clean_transactions = _clean("transactions")
clean_customers = _clean("customers")
clean_loans = _clean("loans")
clean_accounts = _clean("accounts")
clean_macro = _clean("macro_indicators")

CLEANERS = {
    "customers": clean_customers,
    "accounts": clean_accounts,
    "loans": clean_loans,
    "transactions": clean_transactions,
    "macro_indicators": clean_macro,
}


def to_silver(
    bronze: DataFrame,
    primary_keys: list[str],
    cleaning: Callable[[DataFrame], DataFrame] | None = None,
    processed_at: Column | None = None,
    newest_by: str | None = None,
    keep: bool = False,
) -> DataFrame:
    """Bronze rows with standard names, one per key, cleaned and stamped.

    ``newest_by`` names a column that says which version of a key is newest; it is left out unless ``keep`` is set.
    """
    newest = [F.desc_nulls_last(newest_by)] if newest_by else None
    keyed = one_per_key(standard_names(bronze), primary_keys, newest)
    if newest_by and not keep:
        keyed = keyed.drop(newest_by)
    cleaned = keyed.transform(cleaning) if cleaning else keyed
    return stamp(cleaned, processed_at)
