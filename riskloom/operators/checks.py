"""Data tests on staged models and marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.schemas import ModelTests


def _row_tests(tests: ModelTests) -> dict[str, str]:
    """Predicate of a failing row by test name; a null passes the accepted-values tests."""
    listed = {f"not_null_{tests.model}_{name}": f"{name} IS NULL" for name in tests.not_null}
    for name, values in tests.accepted.items():
        known = ", ".join(f"'{value}'" for value in values)
        listed[f"accepted_values_{tests.model}_{name}"] = f"{name} NOT IN ({known})"
    return listed | {f"assert_{name}": predicate for name, predicate in tests.rules.items()}


def run_model_tests(df: DataFrame, tests: ModelTests) -> DataFrame:
    """One row per test of a model, all from a single pass.

    Row tests fail by row; the uniqueness test fails by repeated value, nulls aside. With a uniqueness test the
    pass groups by the key and sums the row failures of each key on the way, so a repeated key is combined map-side.
    """
    row_tests = _row_tests(tests)
    counts = [F.expr(f"count_if({predicate}) AS n{i}") for i, predicate in enumerate(row_tests.values())]
    names = list(row_tests)
    if tests.unique:
        totals = [F.expr(f"coalesce(sum(n{i}), 0) AS n{i}") for i in range(len(names))]
        repeated = F.expr(f"count_if({tests.unique} IS NOT NULL AND _rows > 1) AS n{len(names)}")
        per_key = df.groupBy(tests.unique).agg(F.expr("count(*) AS _rows"), *counts)
        counted = per_key.agg(*totals, repeated)
        names.append(f"unique_{tests.model}_{tests.unique}")
    else:
        counted = df.agg(*counts)
    results = ", ".join(f"'{name}', n{i}, n{i} = 0" for i, name in enumerate(names))
    return counted.selectExpr(
        f"'{tests.model}' AS model", f"stack({len(names)}, {results}) AS (test_name, failures, passed)"
    )


def run_suite(models: dict[str, DataFrame], suite: dict[str, ModelTests]) -> DataFrame:
    """Results of every test whose model is given."""
    return reduce(
        DataFrame.unionByName, [run_model_tests(models[name], suite[name]) for name in suite if name in models]
    )


def no_future_rows(df: DataFrame, date_column: str, as_of: Column | None = None) -> DataFrame:
    """Rows dated after ``as_of`` (today unless given)."""
    return df.where(F.col(date_column) > (F.current_date() if as_of is None else as_of))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child keys without a parent, with the number of child rows.

    Child rows are counted per key before the anti-join, so a hot key crosses the shuffle as one row per task.
    """
    per_key = children.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("child_rows"))
    return per_key.join(parents.select(key), key, "left_anti")
