"""The checking SQL of every named query, written for DuckDB and independent of the DataFrame code.

``{name}`` stands for a sample table or view; the views a query uses are put in front of it.
"""

from __future__ import annotations

from riskloom.sources.samples import with_views

STAMP = "2026-01-01T00:00:00+00:00"
BATCH = "2026-01-01T00-00-00Z"
AS_OF = "2024-01-10"
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The canned queries and answer texts, written out so that a change in the code under test shows.
EXPOSURE_BY_SEGMENT = (
    "select segment, sum(total_outstanding_balance) as total_outstanding_balance "
    "from analytics_marts.mart_customer_exposure group by segment order by total_outstanding_balance desc"
)
SUSPICIOUS_BY_CHANNEL = (
    "select transaction_date, channel, sum(suspicious_count) as suspicious_count "
    "from analytics_marts.mart_daily_transactions group by transaction_date, channel order by transaction_date desc"
)
EXPOSURE_BY_STATUS = (
    "select portfolio_status, count(*) as customer_count, "
    "sum(total_outstanding_balance) as total_outstanding_balance "
    "from analytics_marts.mart_customer_exposure group by portfolio_status order by total_outstanding_balance desc"
)
ACCOUNT_HEALTH = (
    "select account_health_status, count(*) as customer_count, sum(total_accounts) as total_accounts, "
    "avg(active_ratio_pct) as avg_active_ratio "
    "from analytics_marts.mart_account_health group by account_health_status order by customer_count desc"
)
REFUSED = (
    "I cannot run destructive or administrative statements. "
    "Risk desk answers questions about the portfolio and reads the risk marts only."
)
OFFLINE = (
    "Risk desk is in governed offline mode: answers come from the project's documents, "
    "and queries are proposed for the allowed risk marts only."
)
SQL_BLOCK = ("\n\nGuarded SQL:\n```sql\n", "\n```")
NO_SQL = "\n\nThis question needs no SQL."
SOURCES = "\n\nSources:\n"
NO_SOURCES = "\n\nNo document matched this question."


BODIES: dict[str, str] = {}


def lit(text: str) -> str:
    """A Python text as a SQL literal; line breaks go in as chr(10)."""
    pieces = ["'" + piece.replace("'", "''") + "'" for piece in text.split("\n")]
    return "(" + " || chr(10) || ".join(pieces) + ")"


def squeeze(column: str) -> str:
    return f"trim(regexp_replace({column}, '{WHITESPACE}+', ' ', 'g'))"


def is_blank(column: str) -> str:
    return f"(regexp_replace(coalesce({column}, ''), '{WHITESPACE}+', '', 'g') = '')"


def as_text(view: str, columns: str) -> str:
    return "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns.split()) + " FROM {" + view + "}"


C_CUSTOMERS = "customer_id customer_name document_type segment state created_at internal_score"
C_ACCOUNTS = "account_id customer_id account_type opened_at status"
C_TRANSACTIONS = "transaction_id customer_id account_id transaction_date channel transaction_type amount is_suspicious"
C_LOANS = (
    "loan_id customer_id product_type origination_date maturity_date principal_amount outstanding_balance "
    "interest_rate days_past_due risk_rating"
)


def keys_as_text(view: str, columns: str) -> str:
    """Typed columns with the ids as text, the shape of a table read from CSV and cast again."""
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" if c.endswith("_id") else c for c in columns.split())


# Building blocks shared by several bodies.

PROFILE = """
profile AS (
  SELECT c.customer_id, c.segment, c.state, c.internal_score, count(l.loan_id) AS loan_count,
    CAST(coalesce(sum(l.principal_amount), 0) AS DECIMAL(38,2)) AS total_principal_amount,
    CAST(coalesce(sum(l.outstanding_balance), 0) AS DECIMAL(38,2)) AS total_outstanding_balance,
    coalesce(max(l.days_past_due), 0) AS max_days_past_due,
    coalesce(avg(l.days_past_due), 0.0) AS avg_days_past_due,
    min(l.risk_rating) AS best_risk_rating, max(l.risk_rating) AS worst_risk_rating
  FROM {v_customers} c LEFT JOIN {v_loans} l ON c.customer_id = l.customer_id
  GROUP BY c.customer_id, c.segment, c.state, c.internal_score)"""

EXPOSURE = PROFILE + """,
exposure AS (
  SELECT customer_id, segment, state, internal_score, loan_count, total_principal_amount,
    total_outstanding_balance, max_days_past_due, avg_days_past_due,
    CASE WHEN max_days_past_due >= 90 THEN 'DEFAULT_RISK' WHEN max_days_past_due >= 30 THEN 'HIGH_RISK'
      WHEN max_days_past_due > 0 THEN 'WATCHLIST' ELSE 'PERFORMING' END AS portfolio_status
  FROM profile)"""

DAILY = """
daily AS (
  SELECT transaction_date, channel, transaction_type, count(*) AS transaction_count,
    CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount,
    round(CAST(sum(amount) AS DOUBLE) / count(amount), 6) AS avg_amount,
    CAST(sum(CASE WHEN is_suspicious THEN 1 ELSE 0 END) AS BIGINT) AS suspicious_count
  FROM {v_transactions} GROUP BY 1, 2, 3)"""

HEALTH = """
counted AS (
  SELECT a.customer_id, c.segment, c.state, count(*) AS total_accounts,
    CAST(sum(CASE WHEN a.status = 'ACTIVE' THEN 1 ELSE 0 END) AS BIGINT) AS active_accounts,
    CAST(sum(CASE WHEN a.status = 'BLOCKED' THEN 1 ELSE 0 END) AS BIGINT) AS blocked_accounts,
    CAST(sum(CASE WHEN a.status = 'CLOSED' THEN 1 ELSE 0 END) AS BIGINT) AS closed_accounts,
    min(a.opened_at) AS earliest_account_opened, max(a.opened_at) AS latest_account_opened
  FROM {v_accounts} a JOIN {v_customers} c ON a.customer_id = c.customer_id GROUP BY 1, 2, 3),
health AS (
  SELECT *, CASE WHEN blocked_accounts > 0 AND active_accounts = 0 THEN 'FULLY_BLOCKED'
      WHEN blocked_accounts > 0 THEN 'PARTIALLY_BLOCKED'
      WHEN closed_accounts = total_accounts THEN 'ALL_CLOSED' ELSE 'HEALTHY' END AS account_health_status,
    round(CAST(active_accounts AS DOUBLE) / total_accounts * 100, 1) AS active_ratio_pct
  FROM counted)"""

WIDE = """
wide AS (
  SELECT observation_date, max(CASE WHEN indicator_name = 'selic' THEN value END) AS selic_rate,
    max(CASE WHEN indicator_name = 'credit_free_total' THEN value END) AS credit_free_total
  FROM {v_macro_indicators} GROUP BY 1)"""

LATEST = WIDE + """,
latest AS (SELECT * FROM wide WHERE observation_date = (SELECT max(observation_date) FROM wide))"""

MACRO_CONTEXT = EXPOSURE + "," + LATEST + """,
macro_context AS (
  SELECT observation_date AS macro_observation_date, selic_rate, credit_free_total, portfolio_status,
    customer_count, total_outstanding_balance
  FROM latest CROSS JOIN (
    SELECT portfolio_status, count(*) AS customer_count,
      CAST(sum(total_outstanding_balance) AS DECIMAL(38,2)) AS total_outstanding_balance
    FROM exposure GROUP BY 1) p)"""

AUDIT = """
audit AS (
  SELECT strftime(CAST(replace(replace(timestamp, 'T', ' '), '+00:00', '') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')
      AS audit_timestamp, status, question, concat_ws(', ', citation_1, citation_2) AS citations, guarded_sql, response
  FROM {feed_audit})"""

STATUS_LABEL = (
    "CASE portfolio_status WHEN 'PERFORMING' THEN 'Performing' WHEN 'WATCHLIST' THEN 'Watchlist' "
    "WHEN 'HIGH_RISK' THEN 'High Risk' WHEN 'DEFAULT_RISK' THEN 'Default Risk' ELSE portfolio_status END"
)
HEALTH_LABEL = (
    "CASE account_health_status WHEN 'HEALTHY' THEN 'Healthy' WHEN 'PARTIALLY_BLOCKED' THEN 'Partially Blocked' "
    "WHEN 'FULLY_BLOCKED' THEN 'Fully Blocked' WHEN 'ALL_CLOSED' THEN 'All Closed' ELSE account_health_status END"
)

# Sources and sinks.

BODIES["scan_csv_raw"] = as_text("v_customers", C_CUSTOMERS)

BODIES["load_row_counts"] = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {{v_{name}}}"
    for name in ("customers", "accounts", "transactions", "loans", "macro_indicators")
)

BODIES["scan_layer"] = f"SELECT *, '{BATCH}' AS batch_id FROM {{v_accounts}}"

BODIES["layer_manifest"] = f"""
SELECT '{BATCH}' AS batch_id, 'bronze' AS layer, 'accounts' AS table_name, count(*) AS row_count FROM {{v_accounts}}
UNION ALL SELECT '{BATCH}', 'bronze', 'transactions', count(*) FROM {{v_transactions}}
UNION ALL SELECT '{BATCH}', 'silver', 'accounts', count(*) FROM (SELECT DISTINCT * FROM {{v_accounts}}) t
"""

BODIES["scan_jsonl_audit"] = """
SELECT timestamp, status, question,
  CAST((citation_1 IS NOT NULL) AS INTEGER) + CAST((citation_2 IS NOT NULL) AS INTEGER) AS n_citations,
  guarded_sql, response FROM {feed_audit}
"""

BODIES["audit_load"] = """
SELECT timestamp, status, question, concat_ws(', ', citation_1, citation_2) AS citations, guarded_sql, response
FROM {feed_audit}
"""

BODIES["publish_bronze"] = f"""
SELECT batch_id, channel, count(*) AS row_count, count(DISTINCT transaction_id) AS ids
FROM {{feed_transactions}}
CROSS JOIN (SELECT '{BATCH}' AS batch_id UNION ALL SELECT '{BATCH.replace("2026", "2027")}') b GROUP BY 1, 2
"""

BODIES["layers_silver_loans"] = (
    as_text("v_loans", C_LOANS).replace(
        " FROM ", f", '{STAMP}' AS ingestion_processed_at, '{BATCH}' AS batch_id FROM "
    )
)

BODIES["scan_register"] = """
SELECT CNPJ_FUNDO AS cnpj, DENOM_SOCIAL || ' Ações' AS fund_name, TP_FUNDO AS fund_type,
  nullif(SITUACAO, '') AS status, CAST(NULL AS VARCHAR) AS class_type, VL_PATRIM_LIQ AS net_worth
FROM {feed_register}
"""

BODIES["index_corpus"] = """
SELECT doc_id AS vec_id, source, CAST(len(embedding) AS INTEGER) AS dims, CAST(length(text) AS INTEGER) AS chars
FROM {documents} LEFT JOIN {embeddings} ON vec_id = doc_id
"""

BODIES["corpus_scan"] = f"""
SELECT path AS source, text FROM {{feed_files}}
WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('md', 'sql', 'yml', 'yaml', 'json')
  AND NOT {is_blank('text')}
"""

BODIES["cvm_first_rows"] = """
SELECT CNPJ_FUNDO AS cnpj, DENOM_SOCIAL AS fund_name, TP_FUNDO AS fund_type, SITUACAO AS status,
  CAST(NULL AS VARCHAR) AS class_type, VL_PATRIM_LIQ AS net_worth FROM {feed_register}
ORDER BY 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST, 4 NULLS FIRST, 6 NULLS FIRST LIMIT 40
"""

BODIES["cvm_normalize"] = """
SELECT CNPJ_FUNDO AS cnpj, DENOM_SOCIAL AS fund_name, TP_FUNDO AS fund_type, SITUACAO AS status,
  CAST(NULL AS VARCHAR) AS class_type, VL_PATRIM_LIQ AS net_worth FROM {feed_register}
"""

BODIES["bcb_normalize"] = """
SELECT CAST(strptime(data, '%d/%m/%Y') AS DATE) AS observation_date, 'selic' AS indicator_name, 11 AS series_id,
  TRY_CAST(valor AS DECIMAL(18,4)) AS value FROM {feed_series} WHERE indicator_name = 'selic'
"""

BODIES["scan_series"] = BODIES["bcb_normalize"]

BODIES["scan_csv_quoted"] = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  md5('say "' || source || '", then C:' || chr(92) || 'dir' || chr(92) || chr(10) || text) AS digest FROM {documents}
"""

BODIES["scan_csv_numbered"] = """
SELECT row_number() OVER (ORDER BY doc_id) AS row_id, CAST(doc_id AS VARCHAR) AS doc_id,
  md5(text || chr(10) || '"') AS digest FROM {documents}
"""

BODIES["index_corpus_changes"] = """
SELECT doc_id AS vec_id, source, CAST(CASE doc_id % 10 WHEN 1 THEN 1 ELSE len(embedding) END AS INTEGER) AS dims,
  md5(CASE doc_id % 10 WHEN 1 THEN text || '+' ELSE text END) AS digest
FROM {documents} LEFT JOIN {embeddings} ON vec_id = doc_id WHERE doc_id % 10 <> 0
UNION ALL SELECT -doc_id, source, 1, md5(text) FROM {documents} WHERE doc_id % 10 = 2
"""

BODIES["unique_across_batches"] = """
WITH counted AS (
  SELECT CAST(customer_id AS VARCHAR) AS value, 'b' || CAST(account_id % 3 AS INTEGER) AS batch_id, count(*) AS rows
  FROM {v_accounts} WHERE customer_id IS NOT NULL GROUP BY 1, 2),
placed AS (SELECT *, min(batch_id) OVER (PARTITION BY value ORDER BY batch_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_batch FROM counted)
SELECT value, batch_id, rows, earlier_batch, CASE WHEN earlier_batch IS NULL THEN rows - 1 ELSE rows END AS duplicates
FROM placed WHERE earlier_batch IS NOT NULL OR rows > 1
"""

BODIES["overwrite_layer"] = "SELECT account_id, upper(account_type) AS kind FROM {v_accounts}"

BODIES["corpus_files"] = "SELECT source AS folder, count(*) AS documents FROM {documents} GROUP BY 1"

BODIES["silver_newest"] = """
SELECT CAST(account_id AS VARCHAR) AS account_id, CAST(customer_id AS VARCHAR) AS customer_id, account_type, opened_at,
  CASE WHEN account_id % 5 <> 0 THEN status ELSE 'BLOCKED' END AS status FROM {v_accounts}
"""

BODIES["silver_incremental"] = BODIES["silver_newest"]

BODIES["macro_union"] = """
SELECT CAST(strptime(data, '%d/%m/%Y') AS DATE) AS observation_date, indicator_name,
  CASE indicator_name WHEN 'selic' THEN 11 ELSE 20542 END AS series_id,
  TRY_CAST(valor AS DECIMAL(18,4)) AS value FROM {feed_series}
"""

# Staging and Silver.

for _name, _columns in (
    ("customers", C_CUSTOMERS), ("accounts", C_ACCOUNTS), ("transactions", C_TRANSACTIONS), ("loans", C_LOANS),
):
    _picked = keys_as_text(f"v_{_name}", _columns)
    BODIES[f"stg_{_name}"] = f"SELECT {_picked} FROM {{v_{_name}}}"
    BODIES[f"silver_{_name}"] = f"SELECT {_picked}, '{STAMP}' AS ingestion_processed_at FROM {{v_{_name}}}"

BODIES["stg_macro_indicators"] = "SELECT observation_date, indicator_name, series_id, value FROM {v_macro_indicators}"

BODIES["silver_macro"] = f"""
SELECT observation_date, indicator_name, CAST(series_id AS VARCHAR) AS series_id, value,
  '{STAMP}' AS ingestion_processed_at FROM {{v_macro_indicators}}
"""

BODIES["stg_ai_copilot_audit"] = "WITH " + AUDIT.strip() + " SELECT * FROM audit"
BODIES["mart_ai_copilot_audit"] = BODIES["stg_ai_copilot_audit"]
BODIES["audit_recent"] = BODIES["stg_ai_copilot_audit"]

BODIES["silver_standardize"] = (
    as_text("v_customers", C_CUSTOMERS).replace(" FROM ", f", '{STAMP}' AS ingestion_processed_at FROM ")
)

BODIES["silver_dedup_rows"] = """
SELECT DISTINCT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM {lineitem}
"""

BODIES["silver_dedup_pk"] = """
SELECT * EXCLUDE (r) REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey NULLS LAST, l_suppkey NULLS LAST, l_quantity NULLS LAST, l_extendedprice NULLS LAST,
      l_discount NULLS LAST, l_tax NULLS LAST, l_returnflag NULLS LAST, l_linestatus NULLS LAST,
      l_shipdate NULLS LAST) AS r FROM {lineitem}) t
WHERE r = 1
"""

BODIES["silver_dedup_latest"] = """
SELECT * EXCLUDE (r) REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM {lineitem}) t
WHERE r = 1
"""

# Gold, intermediate models, marts.

BODIES["gold_customer_credit_snapshot"] = """
WITH totals AS (
  SELECT customer_id, count(DISTINCT loan_id) AS loan_count, sum(principal_amount) AS principal,
    sum(outstanding_balance) AS balance, max(days_past_due) AS worst, avg(days_past_due) AS average
  FROM {v_loans} GROUP BY 1)
SELECT c.*, coalesce(loan_count, 0) AS loan_count,
  CAST(coalesce(principal, 0) AS DECIMAL(38,2)) AS total_principal_amount,
  CAST(coalesce(balance, 0) AS DECIMAL(38,2)) AS total_outstanding_balance,
  coalesce(worst, 0) AS max_days_past_due, coalesce(average, 0.0) AS avg_days_past_due,
  CASE WHEN worst > 90 THEN 'DEFAULT_RISK' WHEN worst > 30 THEN 'HIGH_RISK' WHEN worst > 5 THEN 'WATCHLIST'
    ELSE 'PERFORMING' END AS portfolio_status
FROM {v_customers} c LEFT JOIN totals t ON c.customer_id = t.customer_id
"""

BODIES["local_customer_credit_snapshot"] = """
WITH totals AS (
  SELECT customer_id, count(DISTINCT loan_id) AS loan_count, sum(principal_amount) AS principal,
    sum(outstanding_balance) AS balance, max(days_past_due) AS worst
  FROM {v_loans} GROUP BY 1)
SELECT CAST(c.customer_id AS VARCHAR) AS customer_id, customer_name, document_type, segment, state,
  CAST(created_at AS VARCHAR) AS created_at, CAST(internal_score AS VARCHAR) AS internal_score,
  coalesce(loan_count, 0) AS loan_count, CAST(coalesce(principal, 0) AS DECIMAL(38,2)) AS total_principal_amount,
  CAST(coalesce(balance, 0) AS DECIMAL(38,2)) AS total_outstanding_balance,
  coalesce(worst, 0) AS max_days_past_due
FROM {v_customers} c LEFT JOIN totals t ON c.customer_id = t.customer_id
"""

BODIES["gold_daily_transaction_monitoring"] = """
SELECT transaction_date, channel, count(DISTINCT transaction_id) AS transaction_count,
  CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount,
  CAST(sum(CASE WHEN is_suspicious THEN 1 ELSE 0 END) AS BIGINT) AS suspicious_count
FROM {v_transactions} GROUP BY 1, 2
"""

BODIES["local_daily_transaction_monitoring"] = """
SELECT transaction_date, channel, count(DISTINCT transaction_id) AS transaction_count,
  CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_amount,
  CAST(sum(CASE WHEN lower(is_suspicious) IN ('true', '1', 't', 'yes') THEN 1 ELSE 0 END) AS BIGINT)
    AS suspicious_count
FROM {feed_transactions} WHERE transaction_date IS NOT NULL AND channel IS NOT NULL GROUP BY 1, 2
"""

BODIES["layers_gold_snapshot"] = BODIES["local_customer_credit_snapshot"]
# A CSV holds no difference between null and empty, and no null id is counted.
BODIES["layers_gold_monitoring"] = BODIES["local_daily_transaction_monitoring"].replace(
    "DISTINCT transaction_id", "DISTINCT nullif(transaction_id, '')"
)

BODIES["int_customer_credit_profile"] = "WITH " + PROFILE.strip() + " SELECT * FROM profile"
BODIES["mart_customer_exposure"] = "WITH " + EXPOSURE.strip() + " SELECT * FROM exposure"
BODIES["mart_daily_transactions"] = "WITH " + DAILY.strip() + " SELECT * FROM daily"

BODIES["states_customer_exposure"] = BODIES["mart_customer_exposure"]
BODIES["states_daily_transactions"] = BODIES["mart_daily_transactions"]
BODIES["states_daily_monitoring"] = BODIES["local_daily_transaction_monitoring"]
BODIES["mart_account_health"] = "WITH " + HEALTH.strip() + " SELECT * FROM health"
BODIES["int_credit_macro_context"] = "WITH " + WIDE.strip() + " SELECT * FROM wide"
BODIES["macro_latest"] = "WITH " + LATEST.strip() + " SELECT * FROM latest"
BODIES["mart_credit_macro_context"] = "WITH " + MACRO_CONTEXT.strip() + " SELECT * FROM macro_context"

BODIES["loan_risk_rating"] = "SELECT loan_id, risk_rating FROM {v_loans}"

BODIES["status_labels"] = """
SELECT account_id, CASE status WHEN 'ACTIVE' THEN 'Active' WHEN 'BLOCKED' THEN 'Blocked' ELSE status END
  AS status_label FROM {v_accounts}
"""

# Contracts. Every feed under its contract's column names, as text; a missing column is null.

FEED_SQL = {
    "accounts": ("feed_accounts", C_ACCOUNTS.split(), C_ACCOUNTS.split(), "account_id", ()),
    "customers": (
        "feed_customers", C_CUSTOMERS.split(), ["customer_id", "segment", "state", "created_at"], "customer_id", (),
    ),
    "cvm_funds": (
        "(SELECT row_id, CNPJ_FUNDO AS cnpj, DENOM_SOCIAL AS fund_name, TP_FUNDO AS fund_type, SITUACAO AS status, "
        "VL_PATRIM_LIQ AS net_worth FROM {feed_register})",
        ["cnpj", "fund_name", "fund_type", "status", "class_type", "net_worth"], ["cnpj", "fund_name", "status"],
        "cnpj", ("class_type",),
    ),
    "loans": (
        "feed_loans", C_LOANS.split(),
        ["loan_id", "customer_id", "product_type", "origination_date", "maturity_date", "principal_amount",
         "outstanding_balance", "days_past_due", "risk_rating"], "loan_id", ("risk_rating",),
    ),
    "transactions": (
        "feed_transactions", C_TRANSACTIONS.split(),
        ["transaction_id", "customer_id", "account_id", "transaction_date", "amount"], "transaction_id", (),
    ),
}


def _feed(source: str) -> str:
    return source if source.startswith("(") else "{" + source + "}"


def _fails(column: str, absent: tuple[str, ...]) -> str:
    return "TRUE" if column in absent else is_blank(column)


def _contract_bodies() -> None:
    required, not_null, unique, summary, errors = [], [], [], [], []
    for name, (source, columns, filled, key, absent) in FEED_SQL.items():
        feed = _feed(source)
        for column in columns:
            required.append(
                f"SELECT '{name}' AS contract, '{column}' AS column_name, {column not in absent} AS present, "
                f"count(*) AS rows_checked FROM {feed} t"
            )
        for column in filled:
            not_null.append(
                f"SELECT '{name}' AS contract, '{column}' AS column_name, "
                f"count(*) FILTER (WHERE {_fails(column, absent)}) AS failures FROM {feed} t"
            )
        repeats = (
            f"SELECT row_id, coalesce({key}, '') AS value, "
            f"row_number() OVER (PARTITION BY coalesce({key}, '') ORDER BY row_id) AS nth FROM {feed} t"
        )
        unique.append(
            f"SELECT '{name}' AS contract, '{key}' AS column_name, row_id, value FROM ({repeats}) r WHERE nth > 1"
        )
        listed = [
            f"SELECT NULL AS row_id, {i} AS step, 'Missing required column: {column}' AS error"
            for i, column in enumerate(absent)
        ]
        listed += [
            f"SELECT row_id, {i}, 'Row ' || row_id || ': null/empty value in ''{column}''' FROM {feed} t "
            f"WHERE {_fails(column, absent)}"
            for i, column in enumerate(filled)
        ]
        listed.append(
            f"SELECT row_id, {len(filled)}, 'Row ' || row_id || ': duplicate value ''' || value || ''' in ''{key}''' "
            f"FROM ({repeats}) r WHERE nth > 1"
        )
        every = " UNION ALL ".join(listed) if absent else (
            "SELECT NULL AS row_id, 0 AS step, '' AS error WHERE FALSE UNION ALL " + " UNION ALL ".join(listed)
        )
        errors.append(
            f"SELECT '{name}' AS contract, row_id, step, error FROM (SELECT CAST(row_id AS BIGINT) AS row_id, step, "
            f"error FROM ({every}) e ORDER BY row_id NULLS FIRST, step LIMIT 50) f"
        )
        summary.append(
            f"SELECT '{name}' AS contract, (SELECT count(*) FROM {feed} t) AS rows_checked, "
            f"(SELECT count(*) FROM ({every}) e) AS error_count, (SELECT count(*) FROM ({every}) e) = 0 AS passed"
        )
    BODIES["contract_required_columns"] = " UNION ALL ".join(required)
    BODIES["contract_not_null"] = " UNION ALL ".join(not_null)
    BODIES["contract_unique"] = " UNION ALL ".join(unique)
    BODIES["contract_errors"] = " UNION ALL ".join(errors)
    BODIES["contract_summary"] = " UNION ALL ".join(summary)


_contract_bodies()

# Data tests.


def _result(model: str, test: str, failures: str) -> str:
    return (
        f"SELECT '{model}' AS model, '{test}' AS test_name, failures, failures = 0 AS passed FROM ("
        f"SELECT CAST(({failures}) AS BIGINT) AS failures) t"
    )


def _repeated(source: str, key: str) -> str:
    return (
        f"SELECT count(*) FROM (SELECT {key} FROM {source} WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1) u"
    )


def _nulls(source: str, column: str) -> str:
    return f"SELECT count(*) FROM {source} WHERE {column} IS NULL"


def _outside(source: str, column: str, values: str) -> str:
    return f"SELECT count(*) FROM {source} WHERE {column} NOT IN ({values})"


BODIES["dq_unique"] = " UNION ALL ".join(
    _result(name, f"unique_{name}_{key}", _repeated("{feed_" + name + "}", key))
    for name, key in (("transactions", "transaction_id"), ("loans", "loan_id"), ("accounts", "account_id"))
)

BODIES["dq_not_null"] = " UNION ALL ".join(
    _result(name, f"not_null_{name}_{column}", _nulls("{feed_" + name + "}", column))
    for name, column in (
        ("customers", "customer_id"), ("customers", "state"), ("accounts", "account_id"), ("accounts", "status"),
    )
)

BODIES["dq_accepted_values"] = " UNION ALL ".join(
    _result("accounts", f"accepted_values_accounts_{column}", _outside("{feed_accounts}", column, values))
    for column, values in (("status", "'ACTIVE', 'BLOCKED', 'CLOSED'"), ("account_type", "'CHECKING', 'SAVINGS'"))
)

BODIES["dq_exposure_non_negative"] = "WITH " + EXPOSURE.strip() + """
SELECT count(*) AS rows_checked, count(*) FILTER (WHERE total_outstanding_balance < 0 OR total_principal_amount < 0
  OR loan_count < 0) AS failures FROM exposure
"""

BODIES["dq_no_future_transactions"] = f"""
SELECT transaction_date, count(*) AS failures FROM {{v_transactions}}
WHERE transaction_date > DATE '{AS_OF}' GROUP BY 1
"""

MISMATCH = (
    "(max_days_past_due >= 90 AND portfolio_status <> 'DEFAULT_RISK') "
    "OR (max_days_past_due >= 30 AND max_days_past_due < 90 AND portfolio_status <> 'HIGH_RISK') "
    "OR (max_days_past_due > 0 AND max_days_past_due < 30 AND portfolio_status <> 'WATCHLIST') "
    "OR (max_days_past_due = 0 AND portfolio_status <> 'PERFORMING')"
)

BODIES["dq_status_matches_dpd"] = (
    "WITH s AS (" + BODIES["gold_customer_credit_snapshot"].strip() + ") "
    f"SELECT count(*) AS rows_checked, count(*) FILTER (WHERE {MISMATCH}) AS failures FROM s"
)

BODIES["dq_suspicious_within_total"] = "WITH " + DAILY.strip() + """
SELECT count(*) AS rows_checked, count(*) FILTER (WHERE suspicious_count > transaction_count OR suspicious_count < 0
  OR transaction_count < 0) AS failures FROM daily
"""

BODIES["dq_referential"] = """
SELECT a.customer_id, count(*) AS child_rows FROM {feed_accounts} a
WHERE a.customer_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM {v_customers} c WHERE CAST(c.customer_id AS VARCHAR) = a.customer_id)
GROUP BY 1
"""

STATUSES = "'PERFORMING', 'WATCHLIST', 'HIGH_RISK', 'DEFAULT_RISK'"


def _suite_body() -> str:
    sources = {
        "stg_customers": "{v_customers}", "stg_transactions": "{v_transactions}", "stg_loans": "{v_loans}",
        "stg_macro_indicators": "{v_macro_indicators}", "stg_accounts": "{v_accounts}",
        "mart_customer_exposure": "exposure", "mart_daily_transactions": "daily",
        "mart_credit_macro_context": "macro_context", "mart_ai_copilot_audit": "audit",
        "mart_account_health": "health",
    }
    unique = {
        "stg_customers": "customer_id", "stg_transactions": "transaction_id", "stg_loans": "loan_id",
        "stg_accounts": "account_id", "mart_customer_exposure": "customer_id", "mart_account_health": "customer_id",
    }
    not_null = {
        "stg_customers": "customer_id segment", "stg_transactions": "transaction_id amount", "stg_loans": "loan_id",
        "stg_macro_indicators": "observation_date indicator_name value",
        "stg_accounts": "account_id customer_id status",
        "mart_customer_exposure": "customer_id segment total_outstanding_balance",
        "mart_daily_transactions": "transaction_date channel transaction_count suspicious_count",
        "mart_credit_macro_context": "macro_observation_date total_outstanding_balance",
        "mart_ai_copilot_audit": "audit_timestamp status question",
        "mart_account_health": "customer_id account_health_status total_accounts",
    }
    accepted = {
        ("stg_loans", "risk_rating"): "'AA', 'A', 'B', 'C', 'D', 'E'",
        ("stg_macro_indicators", "indicator_name"): "'selic', 'credit_free_total'",
        ("stg_accounts", "status"): "'ACTIVE', 'BLOCKED', 'CLOSED'",
        ("mart_customer_exposure", "portfolio_status"): STATUSES,
        ("mart_credit_macro_context", "portfolio_status"): STATUSES,
        ("mart_ai_copilot_audit", "status"): "'answered', 'rejected'",
        ("mart_account_health", "account_health_status"):
            "'HEALTHY', 'PARTIALLY_BLOCKED', 'FULLY_BLOCKED', 'ALL_CLOSED'",
    }
    rules = (
        ("stg_transactions", "no_future_transactions", "transaction_date > current_date"),
        ("mart_customer_exposure", "customer_exposure_non_negative",
         "total_outstanding_balance < 0 OR total_principal_amount < 0 OR loan_count < 0"),
        ("mart_customer_exposure", "portfolio_status_matches_dpd", MISMATCH),
        ("mart_daily_transactions", "suspicious_count_within_transaction_count",
         "suspicious_count > transaction_count OR suspicious_count < 0 OR transaction_count < 0"),
    )
    rows = [_result(m, f"unique_{m}_{key}", _repeated(sources[m], key)) for m, key in unique.items()]
    rows += [
        _result(m, f"not_null_{m}_{column}", _nulls(sources[m], column))
        for m, columns in not_null.items()
        for column in columns.split()
    ]
    rows += [
        _result(m, f"accepted_values_{m}_{column}", _outside(sources[m], column, values))
        for (m, column), values in accepted.items()
    ]
    rows += [
        _result(m, f"assert_{rule}", f"SELECT count(*) FROM {sources[m]} WHERE {predicate}")
        for m, rule, predicate in rules
    ]
    models = ",".join([MACRO_CONTEXT, DAILY, HEALTH, AUDIT]).strip()
    return "WITH " + models + " " + " UNION ALL ".join(rows)


BODIES["dq_suite_report"] = _suite_body()

# Streaming.

BODIES["suspicious_filter"] = """
SELECT row_id, customer_id, is_suspicious FROM {feed_transactions}
WHERE lower(is_suspicious) IN ('true', '1', 't', 'yes')
"""

BODIES["suspicious_events"] = f"""
SELECT 'suspicious_transaction_detected' AS event_type, '{BATCH}' AS batch_id,
  CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(customer_id AS VARCHAR) AS customer_id,
  CAST(account_id AS VARCHAR) AS account_id, CAST(transaction_date AS VARCHAR) AS transaction_date, channel,
  CAST(amount AS DOUBLE) AS amount FROM {{v_transactions}} WHERE is_suspicious
"""

BODIES["event_jsonl"] = f"""
SELECT 'suspicious_transaction_detected' AS event_type, '{BATCH}' AS batch_id, transaction_id, customer_id,
  account_id, transaction_date, channel, CAST(amount AS DOUBLE) AS amount
FROM {{feed_transactions}} WHERE lower(is_suspicious) IN ('true', '1', 't', 'yes')
"""

BODIES["suspicious_event_stream"] = BODIES["suspicious_events"].replace(f"'{BATCH}' AS batch_id,", "")

SUMMARY = """
summary AS (
  SELECT CAST(customer_id AS VARCHAR) AS customer_id, count(*) AS suspicious_count,
    CAST(sum(amount) AS DECIMAL(38,2)) AS total_suspicious_amount,
    CAST(max(transaction_date) AS VARCHAR) AS last_suspicious_timestamp
  FROM {v_transactions} WHERE is_suspicious GROUP BY 1)"""

BODIES["streaming_suspicious_summary"] = "WITH " + SUMMARY.strip() + " SELECT * FROM summary"

BODIES["streaming_replayed_events"] = BODIES["streaming_suspicious_summary"]

BODIES["streaming_alert_kpis"] = "WITH " + SUMMARY.strip() + """
SELECT count(*) AS customers_under_alert, CAST(sum(total_suspicious_amount) AS DECIMAL(38,2)) AS flagged_volume
FROM summary
"""

BODIES["top_flagged_customers"] = "WITH " + SUMMARY.strip() + """
SELECT customer_id, suspicious_count, total_suspicious_amount,
  '2026-01-01T00:00:00.000000+00:00' AS last_suspicious_timestamp
FROM summary ORDER BY suspicious_count DESC, customer_id LIMIT 5
"""

# Retrieval and governance.

BODIES["corpus_token_counts"] = """
SELECT term, count(*) AS uses FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM {v_corpus}) t GROUP BY 1
"""

BODIES["compact_text"] = f"""
SELECT source, CASE WHEN length(flat) <= 900 THEN flat ELSE substring(flat, 1, 897) || '...' END AS compact
FROM (SELECT source, {squeeze('text')} AS flat FROM {{v_corpus}}) t
"""


def _ranked(questions: str, top_k: int) -> str:
    """CTEs ending in ``hits``: the best documents of every distinct question in ``questions``."""
    return f"""
question_terms AS (
  SELECT question, term, count(*) AS weight FROM (
    SELECT question, unnest(regexp_extract_all(lower(question), '[a-z0-9_]+')) AS term
    FROM (SELECT DISTINCT question FROM {questions}) d) t GROUP BY 1, 2),
postings AS (
  SELECT source, term, count(*) AS uses FROM (
    SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM {{v_corpus}}) t GROUP BY 1, 2),
scored AS (
  SELECT question, source, CAST(sum(weight * uses) AS BIGINT) AS score
  FROM question_terms JOIN postings USING (term) GROUP BY 1, 2),
hits AS (
  SELECT question, source, score, CAST(place AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, source) AS place FROM scored) t
  WHERE place <= {top_k})"""


BODIES["retrieve_keyword_topk"] = "WITH " + _ranked("{feed_questions}", 4).strip() + " SELECT * FROM hits"

BODIES["retrieve_keyword_index"] = BODIES["retrieve_keyword_topk"]

BODIES["keyword_index_terms"] = """
SELECT term, count(*) AS documents, CAST(sum(n) AS BIGINT) AS uses, max(n) AS most FROM (
  SELECT source, term, count(*) AS n FROM (
    SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM {v_corpus}) t GROUP BY 1, 2) u
GROUP BY 1
"""

BODIES["retrieve_context"] = "WITH " + _ranked("{feed_questions}", 4).strip() + f"""
SELECT question, h.source, score, rank,
  CASE WHEN length(flat) <= 900 THEN flat ELSE substring(flat, 1, 897) || '...' END AS text
FROM hits h JOIN (SELECT source, {squeeze('text')} AS flat FROM {{v_corpus}}) c ON h.source = c.source
"""

BODIES["retrieve_vector_topk"] = """
WITH parts AS (
  SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS x FROM {embeddings}),
means AS (SELECT label, dim, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM parts GROUP BY 1, 2),
queries AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY dim) AS vector FROM means GROUP BY 1),
scored AS (
  SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), vector), 6) AS cosine
  FROM {embeddings} CROSS JOIN queries),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place FROM scored)
SELECT query_id, vec_id, cosine, CAST(trunc(cosine * 100) AS INTEGER) AS score, CAST(place AS INTEGER) AS rank
FROM placed WHERE place <= 3
"""

BODIES["retrieve_vector_index"] = BODIES["retrieve_vector_topk"]

LIMITED = r"(?i)\blimit\s+([0-9]+)\s*$"


def _limited(query: str, limit: int) -> str:
    return (
        f"CASE WHEN NOT regexp_matches({query}, '{LIMITED}') THEN {query} || ' limit {limit}' "
        f"WHEN coalesce(TRY_CAST(regexp_extract({query}, '{LIMITED}', 1) AS HUGEINT) <= {limit}, FALSE) THEN {query} "
        f"ELSE regexp_replace({query}, '{LIMITED}', 'limit {limit}') END"
    )


BODIES["guardrail_classify"] = rf"""
WITH flat AS (SELECT statement_id, {squeeze("coalesce(sql, '')")} AS flat FROM {{feed_statements}}),
normal AS (
  SELECT *, CASE WHEN flat LIKE '%;' THEN trim(substring(flat, 1, length(flat) - 1)) ELSE flat END AS query FROM flat),
probes AS (SELECT *, lower(regexp_replace(query, '''(?:''''|[^''])*''', '''''', 'g')) AS probe FROM normal),
found AS (
  SELECT *, list_sort(regexp_extract_all(probe, '\b(alter|call|copy|create|delete|drop|execute|grant|insert|merge'
      || '|revoke|truncate|update|vacuum)\b', 1)) AS words,
    list_sort(regexp_extract_all(probe, '\b(?:from|join)\s+([a-z_][\w]*)\.([a-z_][\w]*)\b', 1)) AS schemas
  FROM probes),
judged AS (
  SELECT *, list_filter(schemas, lambda x: x <> 'analytics_marts') AS foreign_schemas FROM found),
reasons AS (
  SELECT *, CASE WHEN flat = '' THEN 'SQL statement is empty.'
    WHEN NOT (starts_with(probe, 'select ') OR starts_with(probe, 'with ')) THEN 'Only SELECT statements are allowed.'
    WHEN len(words) > 0 THEN 'Blocked SQL keyword: ' || words[1]
    WHEN contains(probe, ';') THEN 'Only one SQL statement is allowed.'
    WHEN len(schemas) = 0 THEN 'Query must reference an allowlisted schema-qualified table.'
    WHEN len(foreign_schemas) > 0 THEN 'Schema is not allowlisted: ' || foreign_schemas[1] END AS reason FROM judged)
SELECT statement_id, CASE WHEN reason IS NULL THEN {_limited('query', 100)} END AS guarded_sql, reason FROM reasons
"""

BODIES["guardrail_limit"] = f"""
SELECT statement_id, {_limited('flat', 500)} AS limited_sql
FROM (SELECT statement_id, {squeeze('sql')} AS flat FROM {{feed_statements}}) t
"""


def _destructive(text: str) -> str:
    return f"regexp_matches(lower({text}), 'delete|drop|truncate|update|insert|grant')"


def _routed(text: str) -> str:
    low = f"lower({text})"
    return (
        f"CASE WHEN {low} LIKE '%exposure%' AND {low} LIKE '%segment%' THEN {lit(EXPOSURE_BY_SEGMENT)} "
        f"WHEN {low} LIKE '%suspicious%' OR {low} LIKE '%transaction%' THEN {lit(SUSPICIOUS_BY_CHANNEL)} "
        f"WHEN {low} LIKE '%default%' OR {low} LIKE '%high risk%' THEN {lit(EXPOSURE_BY_STATUS)} "
        f"WHEN {low} LIKE '%account%' AND ({low} LIKE '%health%' OR {low} LIKE '%status%' OR {low} LIKE '%blocked%') "
        f"THEN {lit(ACCOUNT_HEALTH)} END"
    )


def _composed(sql: str, sources: str) -> str:
    """Answer text; ``sources`` is the bulleted list or null."""
    return (
        f"{lit(OFFLINE)} || coalesce({lit(SQL_BLOCK[0])} || {sql} || "
        f"{lit(SQL_BLOCK[1])}, {lit(NO_SQL)}) || coalesce({lit(SOURCES)} || {sources}, "
        f"{lit(NO_SOURCES)})"
    )


BODIES["question_screen"] = (
    f"SELECT question_id, {_destructive("question")} AS destructive FROM {{feed_questions}}"
)

BODIES["question_route"] = (
    f"SELECT question_id, {_routed("question")} AS draft_sql FROM {{feed_questions}}"
)

BODIES["answer_compose"] = (
    "SELECT audit_id, "
    + _composed("guarded_sql", "('- ' || citation_1 || coalesce(chr(10) || '- ' || citation_2, ''))")
    + " AS response FROM {feed_audit}"
)

ANSWERS = _ranked(f"(SELECT question FROM {{feed_questions}} WHERE NOT {_destructive('question')})", 3) + f""",
cited AS (
  SELECT question, string_agg(source, ', ' ORDER BY rank) AS citations,
    string_agg('- ' || source, chr(10) ORDER BY rank) AS bullets FROM hits GROUP BY 1),
answers AS (
  SELECT q.question_id, q.question, {_destructive('q.question')} AS refused, coalesce(citations, '') AS citations,
    bullets, CASE WHEN NOT {_destructive('q.question')} THEN {_routed('q.question')} || ' limit 100' END AS guarded_sql
  FROM {{feed_questions}} q LEFT JOIN cited c ON q.question = c.question),
replies AS (
  SELECT question_id, CASE WHEN refused THEN 'rejected' ELSE 'answered' END AS status, question, citations,
    guarded_sql, CASE WHEN refused THEN {lit(REFUSED)}
      ELSE {_composed('guarded_sql', 'bullets')} END AS response FROM answers)"""

BODIES["copilot_audit_batch"] = "WITH " + ANSWERS.strip() + " SELECT * FROM replies"

EVALS = ANSWERS + """,
judged AS (
  SELECT question_id AS id, question LIKE '%account%' AND guarded_sql IS NULL AS lacks_sql,
    list_filter([CASE WHEN status = 'rejected' THEN 'Cannot run' ELSE 'Governed Offline Mode' END,
        CASE WHEN question_id % 2 = 0 THEN split_part(question, ' ', -1) ELSE '' END],
      lambda term: NOT contains(lower(response || chr(10) || coalesce(guarded_sql, '')), lower(term))) AS missing
  FROM replies),
results AS (
  SELECT id, len(missing) = 0 AND NOT lacks_sql AS passed,
    CASE WHEN len(missing) > 0 THEN 'Missing terms: [' || array_to_string(
        list_transform(missing, lambda term: '''' || term || ''''), ', ') || ']'
      WHEN lacks_sql THEN 'Expected guarded SQL, got none' ELSE 'ok' END AS details FROM judged)"""

BODIES["eval_results"] = "WITH " + EVALS.strip() + " SELECT * FROM results"

BODIES["eval_summary"] = "WITH " + EVALS.strip() + """
SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed
FROM results
"""

BODIES["copilot_exposure_by_segment"] = "WITH " + EXPOSURE.strip() + """
SELECT segment, CAST(sum(total_outstanding_balance) AS DECIMAL(38,2)) AS total_outstanding_balance
FROM exposure GROUP BY 1
"""

BODIES["guarded_query"] = BODIES["copilot_exposure_by_segment"] + " ORDER BY 2 DESC LIMIT 100"

BODIES["copilot_suspicious_by_channel"] = "WITH " + DAILY.strip() + """
SELECT transaction_date, channel, CAST(sum(suspicious_count) AS BIGINT) AS suspicious_count
FROM daily GROUP BY 1, 2
"""

BODIES["copilot_exposure_by_status"] = "WITH " + EXPOSURE.strip() + """
SELECT portfolio_status, count(*) AS customer_count,
  CAST(sum(total_outstanding_balance) AS DECIMAL(38,2)) AS total_outstanding_balance
FROM exposure GROUP BY 1
"""

BODIES["copilot_account_health"] = "WITH " + HEALTH.strip() + """
SELECT account_health_status, count(*) AS customer_count, CAST(sum(total_accounts) AS BIGINT) AS total_accounts,
  round(avg(active_ratio_pct), 6) AS avg_active_ratio
FROM health GROUP BY 1
"""

# Serving.

BODIES["kpi_exposure"] = "WITH " + EXPOSURE.strip() + """
SELECT count(DISTINCT customer_id) AS total_customers,
  CAST(sum(total_outstanding_balance) AS DECIMAL(38,2)) AS total_balance,
  count(DISTINCT customer_id) FILTER (WHERE portfolio_status IN ('HIGH_RISK', 'DEFAULT_RISK')) AS critical_customers,
  round(avg(avg_days_past_due), 6) AS avg_days_past_due,
  round(CAST(count(DISTINCT customer_id) FILTER (WHERE portfolio_status IN ('HIGH_RISK', 'DEFAULT_RISK')) AS DOUBLE)
    / count(DISTINCT customer_id) * 100, 6) AS critical_pct FROM exposure
"""

BODIES["exposure_by_segment_status"] = "WITH " + EXPOSURE.strip() + f"""
SELECT segment, {STATUS_LABEL} AS risk_status,
  CAST(sum(total_outstanding_balance) AS DECIMAL(38,2)) AS total_outstanding_balance FROM exposure GROUP BY 1, 2
"""

BODIES["exposure_share_by_status"] = "WITH " + EXPOSURE.strip() + f"""
SELECT {STATUS_LABEL} AS risk_status,
  CAST(sum(total_outstanding_balance) AS DECIMAL(38,2)) AS total_outstanding_balance,
  round(CAST(sum(total_outstanding_balance) AS DOUBLE)
    / (SELECT CAST(sum(total_outstanding_balance) AS DOUBLE) FROM exposure) * 100, 6) AS share_pct
FROM exposure GROUP BY 1
"""

DAYS = DAILY + """,
days AS (
  SELECT transaction_date, CAST(sum(total_amount) AS DECIMAL(38,2)) AS total_amount,
    CAST(sum(suspicious_count) AS BIGINT) AS suspicious_count FROM daily GROUP BY 1)"""

BODIES["daily_totals"] = "WITH " + DAYS.strip() + " SELECT * FROM days"

BODIES["daily_suspicious_scaled"] = "WITH " + DAYS.strip() + """
SELECT transaction_date, total_amount, suspicious_count, round(suspicious_count * (
  SELECT CASE WHEN max(suspicious_count) > 0 THEN CAST(max(total_amount) AS DOUBLE) / max(suspicious_count) ELSE 1 END
  FROM days), 6) AS suspicious_scaled FROM days
"""

BODIES["kpi_account_health"] = "WITH " + HEALTH.strip() + """
SELECT count(DISTINCT customer_id) AS total_customers, round(avg(active_ratio_pct), 6) AS avg_active_ratio,
  count(*) FILTER (WHERE account_health_status IN ('FULLY_BLOCKED', 'PARTIALLY_BLOCKED')) AS blocked_customers,
  CAST(sum(total_accounts) AS BIGINT) AS total_accounts,
  round(CAST(count(*) FILTER (WHERE account_health_status IN ('FULLY_BLOCKED', 'PARTIALLY_BLOCKED')) AS DOUBLE)
    / count(DISTINCT customer_id) * 100, 6) AS blocked_pct FROM health
"""

BODIES["health_by_segment"] = "WITH " + HEALTH.strip() + f"""
SELECT segment, {HEALTH_LABEL} AS health_status, count(customer_id) AS customer_count FROM health GROUP BY 1, 2
"""

BODIES["health_share"] = "WITH " + HEALTH.strip() + f"""
SELECT {HEALTH_LABEL} AS health_status, count(*) AS customer_count,
  round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM health) * 100, 6) AS share_pct FROM health GROUP BY 1
"""

BODIES["active_ratio_by_state"] = "WITH " + HEALTH.strip() + """
SELECT state, min(active_ratio_pct) AS min_ratio, round(quantile_cont(active_ratio_pct, 0.25), 6) AS q1_ratio,
  round(quantile_cont(active_ratio_pct, 0.5), 6) AS median_ratio,
  round(quantile_cont(active_ratio_pct, 0.75), 6) AS q3_ratio, max(active_ratio_pct) AS max_ratio
FROM health GROUP BY 1
"""

BODIES["audit_kpis"] = "WITH " + AUDIT.strip() + """
SELECT count(*) AS total_queries, count(*) FILTER (WHERE status = 'rejected') AS rejected_queries,
  round(CAST(count(*) FILTER (WHERE status = 'rejected') AS DOUBLE) / count(*) * 100, 6) AS rejection_rate FROM audit
"""

BODIES["audit_by_status"] = "WITH " + AUDIT.strip() + """
SELECT CASE status WHEN 'answered' THEN 'Answered' WHEN 'rejected' THEN 'Blocked by Guardrails' ELSE status END
  AS status_label, count(*) AS count FROM audit GROUP BY 1
"""

ORACLE: dict[str, str] = {name: with_views(body) for name, body in BODIES.items()}
