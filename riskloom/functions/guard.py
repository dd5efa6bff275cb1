"""SQL guardrails as column expressions over a table of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import squeeze

# Blocked words, the relation pattern, limits and refusal texts.
BLOCKED_WORDS = (
    "alter", "call", "copy", "create", "delete", "drop", "execute", "grant", "insert", "merge", "revoke",
    "truncate", "update", "vacuum",
)
SCHEMA_QUALIFIED = r"(?U)\b(?:from|join)\s+([a-z_][\w]*)\.([a-z_][\w]*)\b"
TRAILING_LIMIT = r"(?i)\blimit\s+([0-9]+)\s*$"
DEFAULT_LIMIT = 500
EMPTY = "SQL statement is empty."
NOT_SELECT = "Only SELECT statements are allowed."
BLOCKED = "Blocked SQL keyword: "
SEVERAL = "Only one SQL statement is allowed."
NO_RELATION = "Query must reference an allowlisted schema-qualified table."
OUT_OF_SCOPE = "Schema is not allowlisted: "


def without_literals(sql: Column) -> Column:
    """Empty every quoted text. A doubled quote reads as two adjacent texts, which leaves the same words outside."""
    return F.regexp_replace(sql, "'[^']*'", "''")


def enforce_limit(query: Column, limit: int = DEFAULT_LIMIT) -> Column:
    """Append the row limit, keep a smaller one, cap a larger one; for a query without trailing white space."""
    # Only a query that ends in a digit is searched for a limit.
    ends_in_digit = F.substring(query, -1, 1).between("0", "9")
    asked = F.regexp_extract(query, TRAILING_LIMIT, 1)
    # A number too long for the decimal is larger than any limit.
    within = F.coalesce(asked.try_cast("decimal(38,0)") <= limit, F.lit(False))
    return (
        F.when(~ends_in_digit | (asked == ""), F.concat(query, F.lit(f" limit {limit}")))
        .when(within, query)
        .otherwise(F.regexp_replace(query, TRAILING_LIMIT, f"limit {limit}"))
    )


def guard(
    statements: DataFrame, sql: str, allowed_schemas: tuple[str, ...], default_limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Add ``guarded_sql`` and ``reason``: exactly one of them is set on every row.

    The checks run in a fixed order and the first that fails gives the reason. Each step is a column of its own, so
    Spark evaluates the regular expressions once per row.
    """
    blocked = F.regexp_extract_all("_probe", F.lit(rf"(?U)\b({'|'.join(BLOCKED_WORDS)})\b"), F.lit(1))
    allowed = F.array(*[F.lit(name.lower()) for name in allowed_schemas])
    flat, probe = F.col("_flat"), F.col("_probe")
    reason = (
        F.when(flat == "", EMPTY)
        .when(~(probe.startswith("select ") | probe.startswith("with ")), NOT_SELECT)
        .when(F.col("_word").isNotNull(), F.concat(F.lit(BLOCKED), F.col("_word")))
        .when(probe.contains(";"), SEVERAL)
        .when(F.size("_schemas") == 0, NO_RELATION)
        .when(F.col("_foreign").isNotNull(), F.concat(F.lit(OUT_OF_SCOPE), F.col("_foreign")))
    )
    return (
        statements.withColumn("_flat", squeeze(F.coalesce(F.col(sql), F.lit(""))))
        .withColumn("_query", F.when(flat.endswith(";"), F.trim(F.regexp_replace(flat, ";$", ""))).otherwise(flat))
        .withColumn("_probe", F.lower(without_literals(F.col("_query"))))
        .withColumns({
            "_word": F.array_min(blocked),
            "_schemas": F.regexp_extract_all("_probe", F.lit(SCHEMA_QUALIFIED), F.lit(1)),
        })
        .withColumn("_foreign", F.array_min(F.array_except("_schemas", allowed)))
        .withColumn("reason", reason)
        .withColumn("guarded_sql", F.when(F.col("reason").isNull(), enforce_limit(F.col("_query"), default_limit)))
        .drop("_flat", "_query", "_probe", "_word", "_schemas", "_foreign")
    )
