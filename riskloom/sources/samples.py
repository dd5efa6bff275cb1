"""The banking entities as views over the sample tables, and raw feeds with seeded faults.

Each view is one SQL text that Spark and the checking database both run: names in braces are the tables and views it
reads. The views stand in for a bank's own files; the library itself never reads them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

VIEWS: dict[str, str] = {}

VIEWS["v_customers"] = """
SELECT CAST(c.c_custkey AS BIGINT) AS customer_id, c.c_name AS customer_name,
  CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'CNPJ' ELSE 'CPF' END AS document_type,
  c.c_mktsegment AS segment, n.n_name AS state,
  CAST(DATE '1990-01-01' + CAST(c.c_custkey % 1500 AS INT) AS DATE) AS created_at,
  CAST(250 + (c.c_custkey * 13) % 701 AS INT) AS internal_score
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

VIEWS["v_accounts"] = """
SELECT o_orderkey AS account_id, o_custkey AS customer_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'CHECKING' WHEN 1 THEN 'SAVINGS' ELSE 'INVESTMENT' END AS account_type,
  CAST(o_orderdate AS DATE) AS opened_at,
  CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'BLOCKED' ELSE 'CLOSED' END AS status
FROM {orders}
"""

VIEWS["v_scored_loans"] = """
SELECT l.*, c.internal_score
FROM (SELECT o_orderkey AS loan_id, o_custkey AS customer_id,
    CASE o_orderkey % 5 WHEN 0 THEN 'PERSONAL_LOAN' WHEN 1 THEN 'AUTO_LOAN' WHEN 2 THEN 'MORTGAGE'
      WHEN 3 THEN 'WORKING_CAPITAL' ELSE 'CREDIT_CARD' END AS product_type,
    CAST(o_orderdate AS DATE) AS origination_date,
    CAST(CAST(o_orderdate AS DATE) + CAST(365 * (1 + o_orderkey % 5) AS INT) AS DATE) AS maturity_date,
    CAST(o_totalprice AS DECIMAL(18,2)) AS principal_amount,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(15 + o_orderkey % 86 AS DECIMAL(3,0))
      * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS outstanding_balance,
    CAST(CAST(120 + o_orderkey % 431 AS DECIMAL(6,0)) * CAST(0.0001 AS DECIMAL(4,4)) AS DECIMAL(10,4))
      AS interest_rate,
    CAST(GREATEST(0, (o_orderkey * 37) % 160 - 40) AS INT) AS days_past_due
  FROM {orders}) l
JOIN {v_customers} c ON l.customer_id = c.customer_id
"""

VIEWS["v_loans"] = """
SELECT loan_id, customer_id, product_type, origination_date, maturity_date, principal_amount, outstanding_balance,
  interest_rate, days_past_due,
  CASE WHEN days_past_due = 0 AND internal_score >= 750 THEN 'AA'
    WHEN days_past_due <= 5 AND internal_score >= 680 THEN 'A' WHEN days_past_due <= 15 THEN 'B'
    WHEN days_past_due <= 30 THEN 'C' WHEN days_past_due <= 90 THEN 'D' ELSE 'E' END AS risk_rating
FROM {v_scored_loans}
"""

VIEWS["v_transactions"] = """
SELECT event_id AS transaction_id, user_id AS customer_id, event_id AS account_id,
  CAST(ts AS DATE) AS transaction_date,
  CASE event_id % 6 WHEN 0 THEN 'PIX' WHEN 1 THEN 'CARD' WHEN 2 THEN 'ATM' WHEN 3 THEN 'BRANCH'
    WHEN 4 THEN 'TED' ELSE 'APP' END AS channel,
  CASE event_type WHEN 'view' THEN 'DEBIT' WHEN 'click' THEN 'CREDIT' WHEN 'signup' THEN 'TRANSFER'
    WHEN 'purchase' THEN 'PAYMENT' ELSE 'WITHDRAWAL' END AS transaction_type,
  CAST(value AS DECIMAL(18,2)) AS amount, (event_type = 'error' AND value > 100) AS is_suspicious
FROM {events}
"""

VIEWS["v_macro_indicators"] = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS observation_date, 'selic' AS indicator_name,
  11 AS series_id, CAST(COUNT(*) AS DECIMAL(18,4)) AS value
FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1
UNION ALL
SELECT CAST(date_trunc('month', o_orderdate) AS DATE), 'credit_free_total', 20542,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,4))
FROM {orders} GROUP BY 1
"""

# Raw feeds: every column is text, and some rows have blanks, repeated keys, unknown codes or orphans.
VIEWS["feed_customers"] = """
SELECT customer_id AS row_id,
  CASE WHEN customer_id % 53 = 0 THEN '' WHEN customer_id % 29 = 0 THEN CAST(customer_id - 1 AS STRING)
    ELSE CAST(customer_id AS STRING) END AS customer_id,
  customer_name, document_type,
  CASE WHEN customer_id % 17 = 0 THEN '   ' ELSE segment END AS segment,
  CASE WHEN customer_id % 23 = 0 THEN NULL ELSE state END AS state,
  CAST(created_at AS STRING) AS created_at, CAST(internal_score AS STRING) AS internal_score
FROM {v_customers}
"""

VIEWS["feed_accounts"] = """
SELECT account_id AS row_id, CAST(account_id AS STRING) AS account_id,
  CASE WHEN account_id % 37 = 0 THEN CAST(-account_id AS STRING) ELSE CAST(customer_id AS STRING) END AS customer_id,
  account_type, CAST(opened_at AS STRING) AS opened_at,
  CASE WHEN account_id % 19 = 0 THEN 'FROZEN' WHEN account_id % 41 = 0 THEN NULL ELSE status END AS status
FROM {v_accounts}
"""

# Without risk_rating, which its contract requires.
VIEWS["feed_loans"] = """
SELECT loan_id AS row_id,
  CASE WHEN loan_id % 43 = 0 THEN 'L-0' ELSE CAST(loan_id AS STRING) END AS loan_id,
  CAST(customer_id AS STRING) AS customer_id, product_type, CAST(origination_date AS STRING) AS origination_date,
  CAST(maturity_date AS STRING) AS maturity_date, CAST(principal_amount AS STRING) AS principal_amount,
  CASE WHEN loan_id % 13 = 0 THEN ' ' ELSE CAST(outstanding_balance AS STRING) END AS outstanding_balance,
  CAST(interest_rate AS STRING) AS interest_rate, CAST(days_past_due AS STRING) AS days_past_due
FROM {v_loans}
"""

# A third of the rows share one transaction id.
VIEWS["feed_transactions"] = """
SELECT transaction_id AS row_id,
  CASE WHEN transaction_id % 3 = 0 THEN 'unknown' WHEN transaction_id % 97 = 0 THEN ''
    WHEN transaction_id % 31 = 0 THEN CAST(transaction_id - 1 AS STRING)
    ELSE CAST(transaction_id AS STRING) END AS transaction_id,
  CAST(customer_id AS STRING) AS customer_id,
  CASE WHEN transaction_id % 11 = 0 THEN ' ' ELSE CAST(account_id AS STRING) END AS account_id,
  CAST(transaction_date AS STRING) AS transaction_date, channel, transaction_type,
  CAST(amount AS STRING) AS amount,
  CASE WHEN is_suspicious THEN CASE transaction_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN '1' WHEN 2 THEN 't'
      ELSE 'YES' END
    ELSE CASE transaction_id % 4 WHEN 0 THEN 'False' WHEN 1 THEN '0' WHEN 2 THEN '' ELSE NULL END
    END AS is_suspicious
FROM {v_transactions}
"""

# The fund register under its source headers; the class column is missing.
VIEWS["feed_register"] = """
SELECT s_suppkey AS row_id, CAST(s_suppkey AS STRING) AS CNPJ_FUNDO, s_name AS DENOM_SOCIAL, 'FI' AS TP_FUNDO,
  CASE WHEN s_nationkey % 2 = 0 THEN 'EM FUNCIONAMENTO NORMAL' ELSE '' END AS SITUACAO,
  CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS STRING) AS VL_PATRIM_LIQ
FROM {supplier}
"""

# Macro series as landed: day-first dates and numbers as text, some of them unreadable.
VIEWS["feed_series"] = """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'selic' ELSE 'credit_free_total' END AS indicator_name,
  lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/'
    || CAST(year(o_orderdate) AS STRING) AS data,
  CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS valor
FROM {orders}
"""

# Audit lines: one per conversation turn, with up to two citations.
VIEWS["feed_audit"] = """
SELECT conv_id * 1000 + turn AS audit_id,
  '2024-03-' || lpad(CAST(1 + conv_id % 28 AS STRING), 2, '0') || 'T' || lpad(CAST(turn % 24 AS STRING), 2, '0')
    || ':00:00+00:00' AS timestamp,
  CASE WHEN role = 'system' THEN 'rejected' ELSE 'answered' END AS status, text AS question,
  CASE WHEN role = 'user' THEN 'doc' || CAST(conv_id AS STRING) || '.md' END AS citation_1,
  CASE WHEN role = 'user' AND turn % 2 = 0 THEN 'schema.yml' END AS citation_2,
  CASE WHEN role = 'assistant' THEN 'select 1' END AS guarded_sql, role AS response
FROM {conversations}
"""

# SQL statements that carry the turns of the conversations as quoted text, some of them unsafe.
VIEWS["feed_statements"] = """
SELECT conv_id * 1000 + turn AS statement_id,
  CASE (conv_id * 7 + turn) % 16
    WHEN 0 THEN 'select * from analytics_marts.mart_customer_exposure where note = ' || quoted
    WHEN 1 THEN '  SELECT segment FROM analytics_marts.mart_customer_exposure' || spaced || ' LIMIT 25 '
    WHEN 2 THEN 'select * from analytics_marts.mart_daily_transactions where note = ' || quoted || ' limit 10000;'
    WHEN 3 THEN 'delete from analytics_marts.mart_customer_exposure where note = ' || quoted
    WHEN 4 THEN 'select ' || quoted || ' from analytics_marts.mart_account_health; drop table raw.customers'
    WHEN 5 THEN 'insert into analytics_marts.mart_customer_exposure values (' || quoted || ')'
    WHEN 6 THEN 'select * from raw.customers c join analytics_marts.mart_account_health h on c.note = ' || quoted
    WHEN 7 THEN 'select ' || quoted
    WHEN 8 THEN 'with m as (select ' || quoted || ' as t from analytics_marts.mart_account_health) select * from m;'
    WHEN 9 THEN 'select * from staging.a join Raw.b on true where note = ' || quoted
    WHEN 10 THEN spaced
    WHEN 11 THEN 'select updated_at, ''drop; table'' from Analytics_Marts.mart_account_health where x = ' || quoted
    WHEN 12 THEN 'select * from analytics_marts.mart_account_health; select ' || quoted || ';'
    WHEN 13 THEN 'select grant, alter from analytics_marts.mart_account_health where x = ' || quoted || ' limit 7'
    WHEN 14 THEN 'select a from analytics_marts.mart_account_health where x = ' || quoted
      || ' limit 99999999999999999999999999999999999999999999'
    ELSE text END AS sql
FROM (SELECT conv_id, turn, text, '''' || replace(text, '''', '''''') || '''' AS quoted,
    ' ' || chr(10) || chr(9) || ' ' AS spaced FROM {conversations}) t
"""

# Questions: the text of each user turn, behind an opening that some of the routes know.
VIEWS["feed_questions"] = """
SELECT conv_id * 1000 + turn AS question_id,
  concat_ws(' ', CASE (conv_id * 7 + turn) % 10
    WHEN 0 THEN 'show customer exposure by segment'
    WHEN 1 THEN 'summarize suspicious transactions by channel'
    WHEN 2 THEN 'delete all raw customer records'
    WHEN 3 THEN 'how does this project validate data quality?'
    WHEN 4 THEN 'drop table analytics_marts.mart_customer_exposure'
    WHEN 5 THEN 'show account health status summary for blocked accounts'
    WHEN 6 THEN 'who is in default or high risk by the end of the month, and by the end of the year?'
    WHEN 7 THEN 'which of the accounts and the loans is the oldest'
    WHEN 8 THEN 'When was the customer table last Updated'
    ELSE 'zzz' END, text) AS question
FROM {conversations} WHERE role = 'user'
"""

# The documents as files of several kinds, with a path that tells them apart.
VIEWS["feed_files"] = """
SELECT source || '/' || CAST(doc_id AS STRING) ||
  CASE doc_id % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.SQL' WHEN 2 THEN '.yml' WHEN 3 THEN '.yaml' WHEN 4 THEN '.json'
    WHEN 5 THEN '.txt' ELSE '' END AS path,
  CASE WHEN doc_id % 14 = 0 THEN ' ' || chr(10) ELSE text END AS text
FROM {documents}
"""

VIEWS["v_corpus"] = """
SELECT source || '/' || CAST(doc_id AS STRING) AS source, text FROM {documents}
"""

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def reads(name: str) -> list[str]:
    """The tables and views a view reads directly."""
    return list(dict.fromkeys(re.findall(r"{(\w+)}", VIEWS[name])))


# Schemas of the tables read so far, so that a footer is read once per table and not once per query.
_SCHEMAS: dict[str, StructType] = {}


class Samples:
    """The sample tables and views of one data directory, as lazy DataFrames by name."""

    def __init__(self, spark: SparkSession, sf_dir: str, **replaced: DataFrame):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = dict(replaced)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                self._made[name] = self.spark.sql(VIEWS[name], **{used: self[used] for used in reads(name)})
            else:
                path = f"{self.sf_dir}/{name}.parquet"
                if path not in _SCHEMAS:
                    _SCHEMAS[path] = self.spark.read.parquet(path).schema
                self._made[name] = self.spark.read.schema(_SCHEMAS[path]).parquet(path)
        return self._made[name]


def with_views(body: str) -> str:
    """A query in the checking database's SQL, preceded by the views it names as ``{view}``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for used in reads(name):
                visit(used)
            order.append(name)

    named = list(dict.fromkeys(re.findall(r"{([a-z_]+)}", body)))
    for name in named:
        visit(name)
    known = [*VIEWS, *TABLE_NAMES]
    plain = "|".join(known)

    def bare(text: str) -> str:
        return re.sub(r"{(" + plain + r")}", r"\1", text)

    if not order:
        return bare(body)
    views = ",\n".join(f"{name} AS ({bare(VIEWS[name]).strip()})" for name in order)
    text = bare(body).strip()
    if text.upper().startswith("WITH "):
        return f"WITH {views},\n{text[5:]}"
    return f"WITH {views}\n{text}"
