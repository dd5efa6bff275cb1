"""Warehouse jobs: contracts on raw files, marts as tables, the test suite over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import checks, contracts
from riskloom.plans import marts, staging
from riskloom.schemas import MART_SCHEMA, MODEL_TESTS, RAW_SCHEMA, Contract
from riskloom.session import staged
from riskloom.sources.files import scan_csv_numbered
from riskloom.sources.sinks import declare_tables, load_table


def validate_csv(
    spark: SparkSession, path: str, contract: Contract, multi_line: bool = False
) -> tuple[bool, list[str]]:
    """Check a raw CSV; returns whether it passed and the lines of its report."""
    # Numbered once: the report and its errors read the numbered copy, not the file.
    numbered = staged(scan_csv_numbered(spark, path, multi_line), "validate")
    raw = numbered.drop("row_id")
    report = contracts.summary(raw, contract).first()
    # The report's texts.
    if report["passed"]:
        return True, [f"Validation passed for '{contract.name}'. Rows checked: {report['rows_checked']}"]
    listed = contracts.first_errors(numbered, contract, "row_id").orderBy("row_id", "step").collect()
    lines = [f"Validation failed for '{contract.name}'. Errors: {report['error_count']}"]
    lines += [f"- {row['error']}" for row in listed]
    if report["error_count"] > len(listed):
        lines.append(f"... and {report['error_count'] - len(listed)} more errors")
    return False, lines


def staged_models(spark: SparkSession) -> dict[str, DataFrame]:
    """The staging models over the raw warehouse tables."""
    stages = {
        "customers": staging.stg_customers, "accounts": staging.stg_accounts, "loans": staging.stg_loans,
        "transactions": staging.stg_transactions, "macro_indicators": staging.stg_macro_indicators,
        "ai_copilot_audit": staging.stg_ai_copilot_audit,
    }
    return {f"stg_{name}": stage(spark.table(f"{RAW_SCHEMA}.{name}")) for name, stage in stages.items()}


def build_marts(spark: SparkSession) -> dict[str, DataFrame]:
    """Rebuild every mart table; the macro mart reads the exposure mart that was just written."""
    declare_tables(spark)
    staged = staged_models(spark)

    def save(name: str, df: DataFrame) -> DataFrame:
        load_table(df, name, MART_SCHEMA)
        return spark.table(f"{MART_SCHEMA}.{name}")

    built = {
        "mart_customer_exposure": save(
            "mart_customer_exposure", marts.mart_customer_exposure(staged["stg_customers"], staged["stg_loans"])
        ),
        "mart_daily_transactions": save(
            "mart_daily_transactions", marts.mart_daily_transactions(staged["stg_transactions"])
        ),
        "mart_account_health": save(
            "mart_account_health", marts.mart_account_health(staged["stg_accounts"], staged["stg_customers"])
        ),
        "mart_ai_copilot_audit": save(
            "mart_ai_copilot_audit", marts.mart_ai_copilot_audit(staged["stg_ai_copilot_audit"])
        ),
    }
    built["mart_credit_macro_context"] = save(
        "mart_credit_macro_context",
        marts.mart_credit_macro_context(staged["stg_macro_indicators"], built["mart_customer_exposure"]),
    )
    return built


def run_tests(spark: SparkSession) -> DataFrame:
    """Results of the whole test suite over the warehouse."""
    models = staged_models(spark)
    models |= {name: spark.table(f"{MART_SCHEMA}.{name}") for name in MODEL_TESTS if name.startswith("mart_")}
    return checks.run_suite(models, MODEL_TESTS)
