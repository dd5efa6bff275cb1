"""Table schemas, keys and data contracts.

The column names, types, keys and accepted values below are fixed values: callers' files and tables use them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from riskloom.functions.rules import MART_BANDS

# Typed schemas, in column order.
TABLES: dict[str, str] = {
    "customers": (
        "customer_id string, customer_name string, document_type string, segment string, state string, "
        "created_at date, internal_score int"
    ),
    "accounts": "account_id string, customer_id string, account_type string, opened_at date, status string",
    "transactions": (
        "transaction_id string, customer_id string, account_id string, transaction_date date, channel string, "
        "transaction_type string, amount decimal(18,2), is_suspicious boolean"
    ),
    "loans": (
        "loan_id string, customer_id string, product_type string, origination_date date, maturity_date date, "
        "principal_amount decimal(18,2), outstanding_balance decimal(18,2), interest_rate decimal(10,4), "
        "days_past_due int, risk_rating string"
    ),
    "macro_indicators": (
        "observation_date date, indicator_name string, series_id int, value decimal(18,4)"
    ),
    "cvm_funds": (
        "cnpj string, fund_name string, fund_type string, status string, class_type string, net_worth double"
    ),
    "ai_copilot_audit": (
        "timestamp string, status string, question string, citations string, guarded_sql string, response string"
    ),
    "streaming_suspicious_summary": (
        "customer_id string, suspicious_count bigint, total_suspicious_amount decimal(38,2), "
        "last_suspicious_timestamp string"
    ),
}

# Mart schemas, declared ahead of the first build.
MARTS: dict[str, str] = {
    "mart_customer_exposure": (
        "customer_id string, segment string, state string, internal_score int, loan_count bigint, "
        "total_principal_amount decimal(38,2), total_outstanding_balance decimal(38,2), max_days_past_due int, "
        "avg_days_past_due double, portfolio_status string"
    ),
    "mart_account_health": (
        "customer_id string, segment string, state string, total_accounts bigint, active_accounts bigint, "
        "blocked_accounts bigint, closed_accounts bigint, earliest_account_opened date, "
        "latest_account_opened date, account_health_status string, active_ratio_pct double"
    ),
    "mart_credit_macro_context": (
        "macro_observation_date date, selic_rate decimal(18,4), credit_free_total decimal(18,4), "
        "portfolio_status string, customer_count bigint, total_outstanding_balance decimal(38,2)"
    ),
    "mart_daily_transactions": (
        "transaction_date date, channel string, transaction_type string, transaction_count bigint, "
        "total_amount decimal(38,2), avg_amount double, suspicious_count bigint"
    ),
    "mart_ai_copilot_audit": (
        "audit_timestamp timestamp, status string, question string, citations string, guarded_sql string, "
        "response string"
    ),
}

COMMENTS: dict[str, str] = {
    "customers": "Customer master data as landed.",
    "accounts": "Accounts as landed.",
    "transactions": "Account transactions as landed.",
    "loans": "Loan contracts as landed.",
    "macro_indicators": "Macro series, one row per date and indicator.",
    "cvm_funds": "Investment fund register.",
    "ai_copilot_audit": "One row per governed question.",
    "streaming_suspicious_summary": "Running totals of suspicious transactions per customer.",
    "mart_customer_exposure": "Credit exposure per customer, with the status that follows from days past due.",
    "mart_account_health": "Account counts per customer, with health status and active ratio.",
    "mart_credit_macro_context": "Portfolio totals per status beside the latest macro values.",
    "mart_daily_transactions": "Transactions per day, channel and type.",
    "mart_ai_copilot_audit": "Audit trail of governed questions.",
}

RAW_SCHEMA = "raw"
MART_SCHEMA = "analytics_marts"

SCHEMA_COMMENTS = {
    RAW_SCHEMA: "Banking and macro data as landed.",
    MART_SCHEMA: "Governed marts for dashboards and guarded queries.",
}

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id",),
    "accounts": ("account_id",),
    "loans": ("loan_id",),
    "transactions": ("transaction_id",),
    "macro_indicators": ("observation_date", "indicator_name"),
}

CORE_TABLES = ("customers", "accounts", "transactions", "loans")
OPTIONAL_TABLES = ("macro_indicators", "cvm_funds")

# One line of the audit file; citations are a list there and joined text once loaded.
AUDIT_LINE = (
    "timestamp string, status string, question string, citations array<string>, guarded_sql string, "
    "response string"
)

# One suspicious event, as sent to the topic or file.
EVENT = (
    "event_type string, timestamp string, transaction_id string, customer_id string, account_id string, "
    "transaction_date string, channel string, amount double"
)


def columns_of(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat schema string."""
    pairs = []
    for part in ddl.split(", "):
        name, _, kind = part.strip().partition(" ")
        pairs.append((name, kind))
    return pairs


@dataclass(frozen=True)
class Contract:
    """What a raw file must satisfy before it is loaded."""

    name: str
    required: tuple[str, ...]
    not_null: tuple[str, ...]
    unique: tuple[str, ...]

    @classmethod
    def from_json(cls, text: str) -> Contract:
        """Read a contract file: its name and three lists of column names."""
        spec = json.loads(text)
        return cls(spec["name"], *(tuple(spec[part]) for part in ("required_columns", "not_null", "unique")))


CONTRACTS: dict[str, Contract] = {
    "accounts": Contract(
        "accounts",
        required=("account_id", "customer_id", "account_type", "opened_at", "status"),
        not_null=("account_id", "customer_id", "account_type", "opened_at", "status"),
        unique=("account_id",),
    ),
    "customers": Contract(
        "customers",
        required=(
            "customer_id", "customer_name", "document_type", "segment", "state", "created_at", "internal_score",
        ),
        not_null=("customer_id", "segment", "state", "created_at"),
        unique=("customer_id",),
    ),
    "cvm_funds": Contract(
        "cvm_funds",
        required=("cnpj", "fund_name", "fund_type", "status", "class_type", "net_worth"),
        not_null=("cnpj", "fund_name", "status"),
        unique=("cnpj",),
    ),
    "loans": Contract(
        "loans",
        required=(
            "loan_id", "customer_id", "product_type", "origination_date", "maturity_date", "principal_amount",
            "outstanding_balance", "interest_rate", "days_past_due", "risk_rating",
        ),
        not_null=(
            "loan_id", "customer_id", "product_type", "origination_date", "maturity_date", "principal_amount",
            "outstanding_balance", "days_past_due", "risk_rating",
        ),
        unique=("loan_id",),
    ),
    "transactions": Contract(
        "transactions",
        required=(
            "transaction_id", "customer_id", "account_id", "transaction_date", "channel", "transaction_type",
            "amount", "is_suspicious",
        ),
        not_null=("transaction_id", "customer_id", "account_id", "transaction_date", "amount"),
        unique=("transaction_id",),
    ),
}

PORTFOLIO_STATUSES = ("PERFORMING", "WATCHLIST", "HIGH_RISK", "DEFAULT_RISK")
HEALTH_STATUSES = ("HEALTHY", "PARTIALLY_BLOCKED", "FULLY_BLOCKED", "ALL_CLOSED")
ACCOUNT_STATUSES = ("ACTIVE", "BLOCKED", "CLOSED")
RISK_RATINGS = ("AA", "A", "B", "C", "D", "E")
INDICATORS = ("selic", "credit_free_total")
AUDIT_STATUSES = ("answered", "rejected")


@dataclass(frozen=True)
class ModelTests:
    """Column and rule tests of one model; ``rules`` holds SQL predicates that select failing rows."""

    model: str
    unique: str | None = None
    not_null: tuple[str, ...] = ()
    accepted: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rules: dict[str, str] = field(default_factory=dict)


MODEL_TESTS: dict[str, ModelTests] = {
    "stg_customers": ModelTests("stg_customers", "customer_id", ("customer_id", "segment")),
    "stg_transactions": ModelTests(
        "stg_transactions", "transaction_id", ("transaction_id", "amount"),
        rules={"no_future_transactions": "transaction_date > current_date()"},
    ),
    "stg_loans": ModelTests("stg_loans", "loan_id", ("loan_id",), {"risk_rating": RISK_RATINGS}),
    "stg_macro_indicators": ModelTests(
        "stg_macro_indicators", None, ("observation_date", "indicator_name", "value"),
        {"indicator_name": INDICATORS},
    ),
    "stg_accounts": ModelTests(
        "stg_accounts", "account_id", ("account_id", "customer_id", "status"), {"status": ACCOUNT_STATUSES},
    ),
    "mart_customer_exposure": ModelTests(
        "mart_customer_exposure", "customer_id", ("customer_id", "segment", "total_outstanding_balance"),
        {"portfolio_status": PORTFOLIO_STATUSES},
        {
            "customer_exposure_non_negative": (
                "total_outstanding_balance < 0 OR total_principal_amount < 0 OR loan_count < 0"
            ),
            "portfolio_status_matches_dpd": (
                f"portfolio_status <> CASE WHEN max_days_past_due >= {MART_BANDS.default_from} THEN 'DEFAULT_RISK' "
                f"WHEN max_days_past_due >= {MART_BANDS.high_from} THEN 'HIGH_RISK' "
                f"WHEN max_days_past_due >= {MART_BANDS.watch_from} THEN 'WATCHLIST' "
                "WHEN max_days_past_due = 0 THEN 'PERFORMING' ELSE portfolio_status END"
            ),
        },
    ),
    "mart_daily_transactions": ModelTests(
        "mart_daily_transactions", None,
        ("transaction_date", "channel", "transaction_count", "suspicious_count"), {},
        {
            "suspicious_count_within_transaction_count": (
                "suspicious_count > transaction_count OR suspicious_count < 0 OR transaction_count < 0"
            ),
        },
    ),
    "mart_credit_macro_context": ModelTests(
        "mart_credit_macro_context", None, ("macro_observation_date", "total_outstanding_balance"),
        {"portfolio_status": PORTFOLIO_STATUSES},
    ),
    "mart_ai_copilot_audit": ModelTests(
        "mart_ai_copilot_audit", None, ("audit_timestamp", "status", "question"), {"status": AUDIT_STATUSES},
    ),
    "mart_account_health": ModelTests(
        "mart_account_health", "customer_id",
        ("customer_id", "account_health_status", "total_accounts"),
        {"account_health_status": HEALTH_STATUSES},
    ),
}
