"""The jobs end to end, and row numbers of split files."""

from __future__ import annotations

import json

import pytest

from riskloom.__main__ import parser, run
from riskloom.schemas import CONTRACTS, Contract
from riskloom.sources import files


def job(spark, *args):
    return run(spark, parser().parse_args([str(a) for a in args]))


def test_row_numbers_follow_the_files(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for part in range(3):
        rows = "".join(f"{part * 1000 + i},{'x' * (i % 50)}\n" for i in range(1000))
        (folder / f"part-{part}.csv").write_text("n,pad\n" + rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = files.scan_csv(spark, str(folder))
        assert df.rdd.getNumPartitions() > 5
        rows = files.with_row_numbers(df).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["row_id"], int(r["n"])) for r in rows) == [(i + 1, i) for i in range(3000)]


def test_validate_reports_rows_and_exit_code(spark, tmp_path, capsys):
    path = tmp_path / "accounts.csv"
    header = "account_id,customer_id,account_type,opened_at,status\n"
    path.write_text(header + "a1,c1,CHECKING,2020-01-01,ACTIVE\n")
    assert job(spark, "validate", "--input", path, "--contract", "accounts") == 0
    assert capsys.readouterr().out == "Validation passed for 'accounts'. Rows checked: 1\n"
    path.write_text(header + "a1,c1,CHECKING,2020-01-01,ACTIVE\na1, ,CHECKING,2020-01-01,ACTIVE\n" * 40)
    assert job(spark, "validate", "--input", path, "--contract", "accounts") == 1
    lines = capsys.readouterr().out.splitlines()
    assert lines[:4] == [
        "Validation failed for 'accounts'. Errors: 119",
        "- Row 2: null/empty value in 'customer_id'",
        "- Row 2: duplicate value 'a1' in 'account_id'",
        "- Row 3: duplicate value 'a1' in 'account_id'",
    ]
    assert len(lines) == 52 and lines[-1] == "... and 69 more errors"


def test_contract_file(spark, tmp_path, capsys):
    spec = {"name": "mine", "required_columns": ["id", "x"], "not_null": ["id"], "unique": ["id"]}
    contract = tmp_path / "mine.json"
    contract.write_text(json.dumps(spec, indent=2))
    assert Contract.from_json(json.dumps(spec)) == Contract("mine", ("id", "x"), ("id",), ("id",))
    data = tmp_path / "mine.csv"
    data.write_text("id\n1\n")
    assert job(spark, "validate", "--input", data, "--contract", contract) == 1
    assert "- Missing required column: x" in capsys.readouterr().out
    assert CONTRACTS["loans"].unique == ("loan_id",)


def _raw(folder):
    folder.mkdir()
    (folder / "customers.csv").write_text(
        "customer_id,customer_name,document_type,segment,state,created_at,internal_score\n"
        "c1,Ana,CPF,PF_MASS,SP,2020-01-02,710\nc2,Bia,CPF,PF_MASS,RJ,2020-01-03,600\n"
    )
    (folder / "accounts.csv").write_text(
        "account_id,customer_id,account_type,opened_at,status\na1,c1,CHECKING,2021-01-01,ACTIVE\n"
    )
    (folder / "loans.csv").write_text(
        "loan_id,customer_id,product_type,origination_date,maturity_date,principal_amount,outstanding_balance,"
        "interest_rate,days_past_due,risk_rating\nl1,c1,MORTGAGE,2021-01-01,2031-01-01,100.00,90.00,0.0123,90,D\n"
    )
    (folder / "transactions.csv").write_text(
        "transaction_id,customer_id,account_id,transaction_date,channel,transaction_type,amount,is_suspicious\n"
        "t1,c1,a1,2026-05-23,PIX,DEBIT,10.50,True\nt2,c1,a1,2026-05-23,PIX,DEBIT,5.00,False\n"
    )
    (folder / "macro_indicators.csv").write_text(
        "observation_date,indicator_name,series_id,value\n2024-01-01,selic,11,11.75\n2024-02-01,selic,11,11.25\n"
    )
    return folder


def test_warehouse_jobs(spark, tmp_path, capsys):
    raw = _raw(tmp_path / "raw")
    assert job(spark, "load", "--raw", raw, "--audit", tmp_path / "absent.jsonl") == 0
    assert job(spark, "marts") == 0
    row = spark.table("analytics_marts.mart_credit_macro_context").where("portfolio_status = 'DEFAULT_RISK'").first()
    assert (str(row["macro_observation_date"]), float(row["selic_rate"]), row["customer_count"]) == (
        "2024-02-01", 11.25, 1,
    )
    capsys.readouterr()
    assert job(spark, "test") == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 43 and all(line.startswith("PASS") for line in lines)
    (raw / "loans.csv").write_text(
        (raw / "loans.csv").read_text()
        + "l1,c2,MORTGAGE,2021-01-01,2031-01-01,100.00,-90.00,0.0123,0,ZZ\n"
    )
    job(spark, "load", "--raw", raw)
    job(spark, "marts")
    capsys.readouterr()
    assert job(spark, "test") == 1
    failed = {line.split()[1] for line in capsys.readouterr().out.splitlines() if line.startswith("FAIL")}
    assert failed == {
        "unique_stg_loans_loan_id", "accepted_values_stg_loans_risk_rating", "assert_customer_exposure_non_negative",
    }


def test_layer_jobs(spark, tmp_path):
    raw, lake = _raw(tmp_path / "raw"), tmp_path / "lake"
    for name in ("bronze", "layers"):
        assert job(spark, name, "--raw", raw, "--lake", lake, "--batch-id", "b1") == 0
    assert job(spark, "silver", "--lake", lake) == 0
    assert job(spark, "gold", "--lake", lake) == 0
    assert files.scan_layer(spark, str(lake), "gold_typed", "customer_credit_snapshot").count() == 2


def test_stream_jobs(spark, tmp_path):
    raw = _raw(tmp_path / "raw")
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "transactions.csv").write_text((raw / "transactions.csv").read_text())
    events, summary = tmp_path / "events", tmp_path / "summary"
    for _ in range(2):
        job(spark, "publish", "--input", landing, "--output", events, "--checkpoint", tmp_path / "cp1")
        job(spark, "consume", "--input", events, "--output", summary, "--checkpoint", tmp_path / "cp2")
    from riskloom.streaming.suspicious import read_summary

    assert [(r["customer_id"], r["suspicious_count"]) for r in read_summary(spark, str(summary)).collect()] == [
        ("c1", 1)
    ]
    assert read_summary(spark, str(tmp_path / "nothing")).count() == 0


def test_question_jobs(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("exposure by segment")
    (tmp_path / "questions.txt").write_text("show exposure by segment\ndrop it\n")
    audit = tmp_path / "audit.jsonl"
    assert job(spark, "ask", "--questions", tmp_path / "questions.txt", "--corpus", docs, "--audit", audit) == 0
    assert sorted(r["status"] for r in files.scan_jsonl(spark, str(audit)).collect()) == ["answered", "rejected"]
    cases = tmp_path / "cases.json"
    cases.write_text(
        '{"id": "a", "question": "show exposure by segment", "expected_terms": ["limit 100"], "requires_sql": true}\n'
        '{"id": "b", "question": "nothing", "expected_terms": ["absent"]}\n'
    )
    assert job(spark, "evals", "--cases", cases, "--corpus", docs) == 1
    assert capsys.readouterr().out.splitlines() == ["FAIL b: Missing terms: ['absent']", "Summary: 1/2 passed"]
    yaml = tmp_path / "cases.yml"
    yaml.write_text("cases:\n  - id: a\n    question: show exposure by segment\n    requires_sql: true\n")
    pytest.importorskip("yaml")
    assert job(spark, "evals", "--cases", yaml, "--corpus", docs) == 0


def test_index_jobs(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("exposure by segment")
    (docs / "b.md").write_text("account health")
    assert job(spark, "index", "--corpus", docs, "--index", tmp_path / "keywords") == 0
    (tmp_path / "questions.txt").write_text("show exposure by segment\n")
    (docs / "a.md").write_text("the index is what is read")
    audit = tmp_path / "audit.jsonl"
    assert job(spark, "ask", "--questions", tmp_path / "questions.txt", "--index", tmp_path / "keywords", "--audit", audit) == 0
    row = files.scan_jsonl(spark, str(audit)).first()
    assert [c.rsplit("/", 1)[1] for c in row["citations"]] == ["a.md"]
    with pytest.raises(ValueError, match="corpus or an index"):
        job(spark, "ask", "--questions", tmp_path / "questions.txt", "--audit", audit)


def test_unique_job(spark, tmp_path, capsys):
    unique = CONTRACTS["accounts"].unique[0]
    one, two = tmp_path / "1.csv", tmp_path / "2.csv"
    one.write_text(f"{unique},note\na,x\nb,\"y\nz\"\n")
    two.write_text(f"{unique},note\nb,x\nc,y\nc,z\n")
    common = ("--contract", "accounts", "--index", tmp_path / "keys", "--multi-line", "1")
    assert job(spark, "unique", "--input", one, "--batch-id", "b1", *common) == 0
    assert job(spark, "unique", "--input", two, "--batch-id", "b2", *common) == 1
    assert job(spark, "unique", "--input", one, "--batch-id", "b1", *common) == 1
    assert capsys.readouterr().out.splitlines() == [f"{unique}: 0 repeated", f"{unique}: 2 repeated", f"{unique}: 1 repeated"]
