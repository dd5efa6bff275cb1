"""Governed answers for a table of questions: screen, route to a canned query, guard, cite, compose, audit."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.guard import guard
from riskloom.functions.relations import check_analysed, check_parsed
from riskloom.operators.joins import join_lookup
from riskloom.operators.keyword_index import search_keywords
from riskloom.operators.retrieval import keyword_topk
from riskloom.operators.sizing import fits
from riskloom.operators.topk import top_overall
from riskloom.plans.marts import money
from riskloom.schemas import MART_SCHEMA
from riskloom.session import staged

# Words that make a question destructive, limits, and the canned query of each intent.
DESTRUCTIVE = ("delete", "drop", "truncate", "update", "insert", "grant")
ANSWER_LIMIT = 100
CITATIONS = 3
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

# Answer texts. Evals look for "cannot run destructive" and "governed offline mode", which are fixed values.
REFUSED = (
    "I cannot run destructive or administrative statements. "
    "{name} answers questions about the portfolio and reads the risk marts only."
)
OFFLINE = (
    "{name} is in governed offline mode: answers come from the project's documents, "
    "and queries are proposed for the allowed risk marts only."
)
GUARD_REFUSED = "The guardrails refused the proposed SQL: "
SQL_BLOCK = ("\n\nGuarded SQL:\n```sql\n", "\n```")
NO_SQL = "\n\nThis question needs no SQL."
SOURCES = "\n\nSources:\n"
NO_SOURCES = "\n\nNo document matched this question."
ASSISTANT = "Riskloom"

# The outcome texts of an eval.
EVAL_MISSING = "Missing terms: "
EVAL_NO_SQL = "Expected guarded SQL, got none"
EVAL_OK = "ok"


def _mentions(text: Column, *words: str) -> Column:
    """Any of the words occurs somewhere in the text, also inside a longer word."""
    return text.rlike("|".join(words))


def is_destructive(question: Column) -> Column:
    """The question contains a destructive word."""
    return _mentions(F.lower(question), *DESTRUCTIVE)


def canned_sql(question: Column) -> Column:
    """The query of the first intent a question matches, else null."""
    text = F.lower(question)
    account_topic = _mentions(text, "health", "status", "blocked")
    return (
        F.when(_mentions(text, "exposure") & _mentions(text, "segment"), EXPOSURE_BY_SEGMENT)
        .when(_mentions(text, "suspicious", "transaction"), SUSPICIOUS_BY_CHANNEL)
        .when(_mentions(text, "default", "high risk"), EXPOSURE_BY_STATUS)
        .when(_mentions(text, "account") & account_topic, ACCOUNT_HEALTH)
    )


def compose(citations: Column, guarded_sql: Column, name: str = ASSISTANT) -> Column:
    """The answer text from a citation list and a guarded query, either of which may be missing."""
    listed = F.array_join(F.transform(citations, lambda source: F.concat(F.lit("- "), source)), "\n")
    sql_part = F.coalesce(F.concat(F.lit(SQL_BLOCK[0]), guarded_sql, F.lit(SQL_BLOCK[1])), F.lit(NO_SQL))
    source_part = F.when(F.size(citations) > 0, F.concat(F.lit(SOURCES), listed)).otherwise(NO_SOURCES)
    return F.concat(F.lit(OFFLINE.format(name=name)), sql_part, source_part)


def per_question(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join rows to ``found``, one row per question, without gathering a hot question's rows in one task."""
    found = staged(found, "answers")
    if fits(found):
        return rows.join(F.broadcast(found), "question", how)
    return join_lookup(rows, found, "question", how)


def cite(questions: DataFrame, corpus: DataFrame | None, top_k: int = CITATIONS,
         index: DataFrame | None = None) -> DataFrame:
    """``(question, citations)`` for the distinct questions with a match, best source first.

    A kept keyword ``index`` takes the place of the corpus.
    """
    hits = keyword_topk(questions, corpus, top_k) if index is None else search_keywords(questions, index, top_k)
    return hits.groupBy("question").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda hit: hit["source"]).alias(
            "citations"
        )
    )


def answer_batch(
    questions: DataFrame,
    corpus: DataFrame | None,
    allowed_schemas: tuple[str, ...] = (MART_SCHEMA,),
    default_limit: int = ANSWER_LIMIT,
    name: str = ASSISTANT,
    citations: int = CITATIONS,
    index: DataFrame | None = None,
) -> DataFrame:
    """Add ``status, citations, guarded_sql, response`` to every question row.

    Equal questions are retrieved once; the list of a question has at most ``citations`` sources. They come from the
    corpus, or from a kept keyword ``index`` of it.
    """
    screened = questions.withColumn("_refused", is_destructive(F.col("question")))
    asked = screened.where(~F.col("_refused"))
    found = cite(asked, corpus, citations, index)
    none = F.array().cast("array<string>")
    drafted = (
        per_question(screened, found, "left")
        .withColumn("citations", F.coalesce("citations", none))
        .withColumn("_draft", F.when(~F.col("_refused"), canned_sql(F.col("question"))))
    )
    # A question without a draft needs no SQL, so the guard's verdict on the missing text does not count.
    unsafe = F.col("_draft").isNotNull() & F.col("reason").isNotNull()
    return (
        guard(drafted, "_draft", allowed_schemas, default_limit)
        .withColumn(
            "response",
            F.when(F.col("_refused"), REFUSED.format(name=name))
            .when(unsafe, F.concat(F.lit(GUARD_REFUSED), F.col("reason")))
            .otherwise(compose(F.col("citations"), F.col("guarded_sql"), name)),
        )
        .withColumn("status", F.when(F.col("_refused") | unsafe, "rejected").otherwise("answered"))
        .drop("_refused", "_draft", "reason")
    )


def audit_records(answers: DataFrame, asked_at: Column | None = None) -> DataFrame:
    """Answers in the shape of audit lines, stamped with the given or the current time."""
    stamp = F.current_timestamp() if asked_at is None else asked_at
    iso = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return answers.select(iso.alias("timestamp"), "status", "question", "citations", "guarded_sql", "response")


def run_guarded(spark: SparkSession, sql: str, allowed_schemas: tuple[str, ...] = (MART_SCHEMA,),
                default_limit: int = ANSWER_LIMIT, marts: dict[str, DataFrame] | None = None) -> DataFrame:
    """Guard one statement and run what is left of it.

    After the text rule, the parsed statement may hold only known steps and functions, and the analysed one may read
    only tables of an allowed schema: temporary views, files, table functions and scripts are refused, whatever names a
    common table gives them. ``marts`` stands in for the tables of the mart schema; without it the statement reads the
    catalog.
    """
    statement = spark.range(1).select(F.lit(sql).alias("sql"))
    verdict = guard(statement, "sql", allowed_schemas, default_limit).first()
    if verdict["reason"]:
        raise ValueError(verdict["reason"])
    query = verdict["guarded_sql"]
    places = check_parsed(spark, query, allowed_schemas)
    views = {name.lower(): f"guarded_{name}_{uuid.uuid4().hex}" for name in marts or {}}
    try:
        for name, df in (marts or {}).items():
            df.createTempView(views[name.lower()])
        for place in reversed(places):
            if place.schema == MART_SCHEMA and place.table in views:
                named = re.match(r"`?\w+`?\s*\.\s*`?\w+`?", query[place.start:])
                stand_in = views[place.table] + (f" AS {place.table}" if place.bare else "")
                query = query[:place.start] + stand_in + query[place.start + named.end():]
        df = spark.sql(query)
        check_analysed(df, allowed_schemas, set(views.values()))
        return df
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def _first(df: DataFrame, order: list, limit: int | None) -> DataFrame:
    """Rows in order, all of them unless a limit is given."""
    return df.orderBy(*order) if limit is None else top_overall(df, order, limit)


def exposure_by_segment(exposure: DataFrame, limit: int | None = None) -> DataFrame:
    """Balance per segment, largest first."""
    totals = exposure.groupBy("segment").agg(money("total_outstanding_balance").alias("total_outstanding_balance"))
    return _first(totals, [F.desc("total_outstanding_balance"), F.asc("segment")], limit)


def suspicious_by_channel(daily: DataFrame, limit: int | None = None) -> DataFrame:
    """Suspicious transactions per day and channel, newest first."""
    totals = daily.groupBy("transaction_date", "channel").agg(F.sum("suspicious_count").alias("suspicious_count"))
    return _first(totals, [F.desc("transaction_date"), F.asc("channel")], limit)


def exposure_by_status(exposure: DataFrame, limit: int | None = None) -> DataFrame:
    """Customers and balance per status, largest first."""
    totals = exposure.groupBy("portfolio_status").agg(
        F.count(F.lit(1)).alias("customer_count"),
        money("total_outstanding_balance").alias("total_outstanding_balance"),
    )
    return _first(totals, [F.desc("total_outstanding_balance"), F.asc("portfolio_status")], limit)


def health_summary(health: DataFrame, limit: int | None = None) -> DataFrame:
    """Customers, accounts and mean active ratio per health status, largest first."""
    totals = health.groupBy("account_health_status").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum("total_accounts").alias("total_accounts"),
        F.round(F.avg("active_ratio_pct"), 6).alias("avg_active_ratio"),
    )
    return _first(totals, [F.desc("customer_count"), F.asc("account_health_status")], limit)


def eval_results(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """``(id, passed, details)`` per case: every expected term occurs, and SQL is there where it is required.

    ``cases(id, question, expected_terms, requires_sql)``; ``answers`` has one row per distinct question.
    """
    text = F.lower(F.concat(F.col("response"), F.lit("\n"), F.coalesce("guarded_sql", F.lit(""))))
    terms = F.coalesce("expected_terms", F.array().cast("array<string>"))
    missing = F.filter(terms, lambda term: ~F.col("_text").contains(F.lower(term)))
    quoted = F.array_join(F.transform("_missing", lambda term: F.concat(F.lit("'"), term, F.lit("'"))), ", ")
    lacks_sql = F.coalesce("requires_sql", F.lit(False)) & F.col("guarded_sql").isNull()
    replies = answers.select("question", "response", "guarded_sql")
    return (
        per_question(cases, replies, "inner")
        .withColumn("_text", text)
        .withColumn("_missing", missing)
        .select(
            "id",
            ((F.size("_missing") == 0) & ~lacks_sql).alias("passed"),
            F.when(F.size("_missing") > 0, F.concat(F.lit(EVAL_MISSING + "["), quoted, F.lit("]")))
            .when(lacks_sql, EVAL_NO_SQL)
            .otherwise(EVAL_OK)
            .alias("details"),
        )
    )


def eval_summary(results: DataFrame) -> DataFrame:
    """Cases in total, passed and failed."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
    )
