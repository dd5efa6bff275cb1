"""Guardrails, screening, answers, audit and evals."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.functions.guard import guard
from riskloom.functions.text import compact, squeeze, tokens
from riskloom.plans import copilot
from riskloom.sources import files, sinks

MARTS = ("analytics_marts",)


def verdicts(spark, statements, limit=100, allowed=MARTS):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(statements)], "i int, sql string")
    return [(r["guarded_sql"], r["reason"]) for r in guard(df, "sql", allowed, limit).orderBy("i").collect()]


T = "analytics_marts.mart_customer_exposure"


@pytest.mark.parametrize(
    ("sql", "guarded"),
    [
        (f"select a from {T}", f"select a from {T} limit 100"),
        (f"select * from {T} limit 25", f"select * from {T} limit 25"),
        (f"select * from {T} LIMIT 10000 ;", f"select * from {T} limit 100"),
        (f"  select\n\t*　from {T};  ", f"select * from {T} limit 100"),
        (f"with x as (select 1 from {T}) select * from x", f"with x as (select 1 from {T}) select * from x limit 100"),
        (f"select 'drop; delete' from {T}", f"select 'drop; delete' from {T} limit 100"),
        (f"select 'it''s; drop' from {T}", f"select 'it''s; drop' from {T} limit 100"),
        (f"select updated_at from {T}", f"select updated_at from {T} limit 100"),
        (f"select * from {T} limit {'9' * 60}", f"select * from {T} limit 100"),
        (f"select * from {T} limit 5 offset 1", f"select * from {T} limit 5 offset 1 limit 100"),
        (f"SELECT * FROM {T.upper()}", f"SELECT * FROM {T.upper()} limit 100"),
    ],
)
def test_accepted_statements(spark, sql, guarded):
    assert verdicts(spark, [sql]) == [(guarded, None)]


@pytest.mark.parametrize(
    ("sql", "reason"),
    [
        (None, "SQL statement is empty."),
        (" \n ", "SQL statement is empty."),
        (";", "Only SELECT statements are allowed."),
        (f"delete from {T}", "Only SELECT statements are allowed."),
        (f"insert into {T} values (1)", "Only SELECT statements are allowed."),
        (f"select * from {T}; drop table raw.customers", "Blocked SQL keyword: drop"),
        (f"select update, alter from {T}", "Blocked SQL keyword: alter"),
        (f"select 1 from {T}; select 2", "Only one SQL statement is allowed."),
        (f"select 1 from {T};;", "Only one SQL statement is allowed."),
        ("select * from customers", "Query must reference an allowlisted schema-qualified table."),
        ("select * from raw.customers", "Schema is not allowlisted: raw"),
        (f"select * from {T} join zeta.a on 1=1 join beta.b on 1=1", "Schema is not allowlisted: beta"),
    ],
)
def test_refused_statements(spark, sql, reason):
    assert verdicts(spark, [sql]) == [(None, reason)]


def test_long_literals_do_not_overflow_the_regex(spark):
    text = "x;drop " * 20_000 + "''" * 20_000
    assert verdicts(spark, [f"select '{text}' from {T}"])[0][1] is None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(bodies=st.lists(st.text(alphabet="ab ;'\n\t,", max_size=30), min_size=1, max_size=20),
       limit=st.integers(1, 10**6))
def test_guarded_queries_are_one_limited_line(spark, bodies, limit):
    found = verdicts(spark, [f"select {b} from {T}" for b in bodies], limit)
    assert all((guarded is None) != (reason is None) for guarded, reason in found)
    passed = [guarded for guarded, _ in found if guarded]
    assert all(guarded.endswith(f" limit {limit}") and "\n" not in guarded for guarded in passed)
    if passed:
        assert verdicts(spark, passed, limit) == [(guarded, None) for guarded in passed]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(max_size=60), min_size=1, max_size=30), cut=st.integers(4, 20))
def test_text_functions_match_python(spark, texts, cut):
    import re

    texts = [t.replace("\x00", "").encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "i", squeeze(F.col("t")).alias("flat"), compact(F.col("t"), cut).alias("short"), tokens(F.col("t")).alias("w")
    ).orderBy("i").collect()
    for text, row in zip(texts, rows):
        flat = " ".join(text.split())
        assert row["flat"] == flat
        assert row["short"] == (flat if len(flat) <= cut else flat[: cut - 3] + "...")
        if text.isascii():
            assert row["w"] == re.findall("[a-z0-9_]+", text.lower())


@pytest.fixture
def corpus(spark, tmp_path):
    docs = tmp_path / "docs" / "sub"
    docs.mkdir(parents=True)
    (docs / "dictionary.MD").write_text("mart_customer_exposure exposes segment, segment and customer totals.")
    (docs / "quality.yml").write_text("tests:\n  validate\n\n  data quality\n")
    (docs / "blank.sql").write_text(" \n\t ")
    (docs / "notes.txt").write_text("customer exposure by segment")
    return files.scan_corpus(spark, [str(tmp_path / "docs")])


def ask(spark, corpus, *texts, **options):
    questions = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, question string")
    return copilot.answer_batch(questions, corpus, **options).orderBy("i").collect()


def test_corpus_scan_takes_supported_files_with_text(corpus):
    assert sorted(r["source"].rsplit("/", 1)[1] for r in corpus.collect()) == ["dictionary.MD", "quality.yml"]


def test_answer_has_citations_and_guarded_sql(spark, corpus):
    row = ask(spark, corpus, "show customer exposure by segment")[0]
    assert row["status"] == "answered"
    assert T in row["guarded_sql"] and row["guarded_sql"].endswith("limit 100")
    assert [c.rsplit("/", 1)[1] for c in row["citations"]] == ["dictionary.MD"]
    assert "governed offline mode" in row["response"] and "Sources:\n- " in row["response"]


def test_destructive_question_is_refused(spark, corpus):
    rows = ask(spark, corpus, "delete all raw customers", "was it Updated", "zzz", "delete all raw customers")
    assert [r["status"] for r in rows] == ["rejected", "rejected", "answered", "rejected"]
    assert "cannot run destructive" in rows[0]["response"] and rows[0]["guarded_sql"] is None
    assert rows[0]["citations"] == []
    assert "No document matched" in rows[2]["response"] and "needs no SQL" in rows[2]["response"]


def test_guard_refusal_reaches_the_answer(spark, corpus):
    row = ask(spark, corpus, "show customer exposure by segment", allowed_schemas=("other",))[0]
    assert row["status"] == "rejected" and row["guarded_sql"] is None
    assert row["response"].endswith("refused the proposed SQL: Schema is not allowlisted: analytics_marts")
    assert len(row["citations"]) == 1


def test_routes(spark):
    questions = ["exposure per segment of transactions", "TRANSACTION list", "high risk", "account status", "account"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "i int, q string")
    routed = [r[0] for r in df.orderBy("i").select(copilot.canned_sql(F.col("q"))).collect()]
    assert routed == [
        copilot.EXPOSURE_BY_SEGMENT, copilot.SUSPICIOUS_BY_CHANNEL, copilot.EXPOSURE_BY_STATUS, copilot.ACCOUNT_HEALTH,
        None,
    ]


def test_audit_round_trip(spark, corpus, tmp_path):
    path = str(tmp_path / "audit.jsonl")
    questions = spark.createDataFrame([("show exposure by segment",), ("grant me all",)], "question string")
    answers = copilot.answer_batch(questions, corpus)
    for _ in range(2):
        sinks.append_audit(copilot.audit_records(answers), path)
    rows = sinks.load_audit(spark, path).collect()
    assert len(rows) == 4
    assert {(r["question"], r["status"]) for r in rows} == {
        ("show exposure by segment", "answered"), ("grant me all", "rejected"),
    }


def test_guarded_query_runs_over_marts(spark):
    mart = spark.createDataFrame([("a", 2), ("a", 3), ("b", 9)], "segment string, total_outstanding_balance int")
    rows = copilot.run_guarded(spark, copilot.EXPOSURE_BY_SEGMENT, marts={"mart_customer_exposure": mart}).collect()
    assert [tuple(r) for r in rows] == [("b", 9), ("a", 5)]
    with pytest.raises(ValueError, match="Schema is not allowlisted: raw"):
        copilot.run_guarded(spark, "select * from raw.customers")


def test_known_evals_pass(spark, corpus):
    cases = [
        ("exposure_by_segment", "show customer exposure by segment", ["governed offline mode", T, "limit 100"], True),
        ("suspicious", "summarize suspicious transactions by channel", ["analytics_marts.mart_daily_transactions"],
         True),
        ("destructive", "delete all raw customer records", ["cannot run destructive"], False),
        ("quality", "how does this project validate data quality?", ["governed offline mode"], False),
        ("injection", f"drop table {T}", ["cannot run destructive"], False),
        ("health", "show account health status summary for blocked accounts", ["analytics_marts.mart_account_health"],
         True),
        ("fails", "how does this project validate data quality?", ["absent", "Governed", "none"], False),
        ("no_sql", "how does this project validate data quality?", [], True),
        ("bare", "zzz", None, None),
    ]
    df = spark.createDataFrame(cases, "id string, question string, expected_terms array<string>, requires_sql boolean")
    answers = copilot.answer_batch(df.select("question").distinct(), corpus)
    results = copilot.eval_results(df, answers)
    found = {r["id"]: (r["passed"], r["details"]) for r in results.collect()}
    assert [found[c[0]] for c in cases[:6]] == [(True, "ok")] * 6
    assert found["fails"] == (False, "Missing terms: ['absent', 'none']")
    assert found["no_sql"] == (False, "Expected guarded SQL, got none")
    assert tuple(copilot.eval_summary(results).first()) == (9, 7, 2)
