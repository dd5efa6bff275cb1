"""Raw files to Bronze, Silver and Gold."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskloom.plans.layers import bronze_to_silver, build_layers, silver_to_gold
from riskloom.schemas import MARTS, TABLES
from riskloom.sources import files, sinks

CUSTOMERS = "customer_id,segment,state,internal_score\nc1,PF_MASS,SP,710\nc2,PJ_SMALL,RJ,640\n"
LOANS = (
    "loan_id,customer_id,principal_amount,outstanding_balance,days_past_due\n"
    "l1,c1,1000.0,700.0,0\nl2,c1,500.0,300.0,45\n"
)


@pytest.fixture
def raw(tmp_path: Path) -> Path:
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "customers.csv").write_text(CUSTOMERS)
    (folder / "loans.csv").write_text(LOANS)
    return folder


def test_build_writes_all_layers_and_a_manifest(spark, raw, tmp_path):
    lake = str(tmp_path / "lake")
    built = build_layers(spark, str(raw), lake, "test-batch", datetime(2026, 1, 1, tzinfo=UTC))
    assert built.batch_id == "test-batch"
    assert built.tables == {"customers": 2, "loans": 2}
    assert built.silver == {"customers": 2, "loans": 2}
    assert built.gold == {"customer_credit_snapshot": 2}
    rows = {r["customer_id"]: r for r in files.scan_layer(spark, lake, "gold", "customer_credit_snapshot").collect()}
    assert rows["c1"]["loan_count"] == 2
    assert float(rows["c1"]["total_outstanding_balance"]) == 1000.0
    assert rows["c1"]["max_days_past_due"] == 45
    assert rows["c2"]["loan_count"] == 0 and float(rows["c2"]["total_principal_amount"]) == 0.0
    stamped = files.scan_layer(spark, lake, "silver", "customers").select("ingestion_processed_at").distinct()
    assert [r[0] for r in stamped.collect()] == ["2026-01-01T00:00:00+00:00"]
    lines = [json.loads(line) for f in Path(built.manifest_path).glob("*.json") for line in f.read_text().splitlines()]
    assert {(x["layer"], x["table_name"]) for x in lines} == {
        ("bronze", "customers"), ("bronze", "loans"), ("silver", "customers"), ("silver", "loans"),
        ("gold", "customer_credit_snapshot"),
    }
    assert all("batch_id=test-batch" in x["file"] for x in lines)


def test_rerun_replaces_only_its_batch(spark, raw, tmp_path):
    lake = str(tmp_path / "lake")
    for batch in ("a", "b", "a"):
        build_layers(spark, str(raw), lake, batch)
    counted = files.scan_layer(spark, lake, "bronze", "loans").groupBy("batch_id").count().collect()
    assert {r["batch_id"]: r["count"] for r in counted} == {"a": 2, "b": 2}


def test_batch_filter_prunes_directories(spark, raw, tmp_path):
    lake = str(tmp_path / "lake")
    build_layers(spark, str(raw), lake, "a")
    df = files.scan_layer(spark, lake, "bronze", "loans").where("batch_id = 'a'")
    assert "PartitionFilters: [isnotnull(batch_id" in df._jdf.queryExecution().executedPlan().toString()


def test_silver_removes_repeated_rows_but_local_gold_counts_them(spark, raw, tmp_path):
    (raw / "loans.csv").write_text(LOANS + "l2,c1,500.0,300.0,45\n")
    lake = str(tmp_path / "lake")
    built = build_layers(spark, str(raw), lake, "x")
    assert built.silver["loans"] == 2
    row = files.scan_layer(spark, lake, "gold", "customer_credit_snapshot").where("customer_id = 'c1'").first()
    assert row["loan_count"] == 2 and float(row["total_outstanding_balance"]) == 1300.0


def test_bronze_keeps_raw_text_and_names(spark, raw, tmp_path):
    (raw / "loans.csv").write_text(" Loan_ID ,amount\n007,1.50\n")
    lake = str(tmp_path / "lake")
    sinks.publish_bronze({"loans": files.scan_raw(spark, str(raw))["loans"]}, lake, "b")
    bronze = files.scan_layer(spark, lake, "bronze", "loans")
    assert bronze.columns == [" Loan_ID ", "amount", "batch_id"]
    assert bronze.first()[:2] == ("007", "1.50")


def test_odd_headers_pass_through_every_layer(spark, raw, tmp_path):
    (raw / "other.csv").write_text(" Odd.Name ,B\n1,2\n1,2\n")
    lake = str(tmp_path / "lake")
    built = build_layers(spark, str(raw), lake, "b")
    assert built.tables["other"] == 2 and built.silver["other"] == 1
    assert files.scan_layer(spark, lake, "bronze", "other").columns == [" Odd.Name ", "B", "batch_id"]
    assert files.scan_layer(spark, lake, "silver", "other").columns == [
        "odd.name", "b", "ingestion_processed_at", "batch_id",
    ]


def test_missing_inputs_are_errors(spark, raw, tmp_path):
    with pytest.raises(FileNotFoundError, match="Raw directory not found"):
        build_layers(spark, str(tmp_path / "none"), str(tmp_path / "lake"))
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError, match="No CSV files found"):
        build_layers(spark, str(empty), str(tmp_path / "lake"))
    with pytest.raises(FileNotFoundError, match="Missing CSV file"):
        files.scan_core(spark, str(raw))


def test_ragged_row_is_an_error(spark, raw):
    (raw / "loans.csv").write_text(LOANS + "l3,c1\n")
    with pytest.raises(Exception, match="MALFORMED"):
        files.scan_raw(spark, str(raw))["loans"].collect()


def _raw_core(raw: Path) -> None:
    (raw / "customers.csv").write_text(
        "customer_id,customer_name,document_type,segment,state,created_at,internal_score\n"
        "c1,Ana,CPF,PF_MASS,SP,2020-01-02,710\nc2,Bia,CPF,PF_MASS,RJ,2020-01-03,600\n"
    )
    (raw / "accounts.csv").write_text(
        "account_id,customer_id,account_type,opened_at,status\na1,c1,CHECKING,2021-01-01,ACTIVE\n"
        "a2,c1,SAVINGS,2021-02-01,BLOCKED\na1,c1,CHECKING,2021-01-01,ACTIVE\n"
    )
    (raw / "loans.csv").write_text(
        "loan_id,customer_id,product_type,origination_date,maturity_date,principal_amount,outstanding_balance,"
        "interest_rate,days_past_due,risk_rating\nl1,c1,MORTGAGE,2021-01-01,2031-01-01,100.00,90.00,0.0123,90,D\n"
    )
    (raw / "transactions.csv").write_text(
        "transaction_id,customer_id,account_id,transaction_date,channel,transaction_type,amount,is_suspicious\n"
        "t1,c1,a1,2026-05-23,PIX,DEBIT,10.50,True\nt2,c1,a1,2026-05-23,PIX,DEBIT,5.00,False\n"
    )


def test_typed_silver_and_gold(spark, raw, tmp_path):
    _raw_core(raw)
    lake = str(tmp_path / "lake")
    sinks.publish_bronze(files.scan_core(spark, str(raw)), lake, "b")
    for table in ("customers", "accounts", "loans", "transactions"):
        bronze_to_silver(spark, lake, table)
    silver = files.scan_layer(spark, lake, "silver_typed", "loans")
    kinds = dict(silver.dtypes)
    assert kinds["principal_amount"] == "decimal(18,2)" and kinds["interest_rate"] == "decimal(10,4)"
    assert kinds["origination_date"] == "date" and kinds["ingestion_processed_at"] == "timestamp"
    silver_to_gold(spark, lake)
    snapshot = files.scan_layer(spark, lake, "gold_typed", "customer_credit_snapshot")
    assert {r["customer_id"]: r["portfolio_status"] for r in snapshot.collect()} == {
        "c1": "HIGH_RISK", "c2": "PERFORMING",
    }
    health = files.scan_layer(spark, lake, "gold_typed", "mart_account_health").collect()
    assert [(r["total_accounts"], r["account_health_status"], r["active_ratio_pct"]) for r in health] == [
        (2, "PARTIALLY_BLOCKED", 50.0)
    ]
    daily = files.scan_layer(spark, lake, "gold_typed", "daily_transaction_monitoring").first()
    assert (daily["transaction_count"], float(daily["total_amount"]), daily["suspicious_count"]) == (2, 15.5, 1)


def test_warehouse_load_and_declared_tables(spark, raw):
    _raw_core(raw)
    for schema in ("raw", "analytics_marts"):
        spark.sql(f"DROP DATABASE IF EXISTS {schema} CASCADE")
    sinks.declare_tables(spark)
    assert spark.table("analytics_marts.mart_customer_exposure").count() == 0
    for schema, tables in (("raw", TABLES), ("analytics_marts", MARTS)):
        assert set(tables) <= {t.name for t in spark.catalog.listTables(schema)}
    counts = {r["table_name"]: r["row_count"] for r in sinks.load_warehouse(spark, str(raw)).collect()}
    assert counts == {"customers": 2, "accounts": 3, "transactions": 2, "loans": 1}
    (raw / "macro_indicators.csv").write_text(
        "observation_date,indicator_name,series_id,value\n2024-01-01,selic,11,11.75\n"
    )
    comment = spark.sql("DESCRIBE TABLE EXTENDED raw.loans").where("col_name = 'Comment'").first()["data_type"]
    assert comment == "Loan contracts as landed."
    again = {r["table_name"]: r["row_count"] for r in sinks.load_warehouse(spark, str(raw)).collect()}
    assert again == {**counts, "macro_indicators": 1}


def test_series_are_normalised(spark, tmp_path):
    path = tmp_path / "selic.json"
    path.write_text('[{"data": "02/01/2024", "valor": "10.50"}, {"data": "03/01/2024", "valor": "n/a"}]')
    rows = files.normalize_series(files.scan_series(spark, str(path)), "selic").collect()
    assert [(str(r["observation_date"]), r["indicator_name"], r["series_id"]) for r in rows] == [
        ("2024-01-02", "selic", 11), ("2024-01-03", "selic", 11),
    ]
    assert float(rows[0]["value"]) == 10.5 and rows[1]["value"] is None


def test_register_is_read_as_latin1_and_renamed(spark, tmp_path):
    path = tmp_path / "register.csv"
    path.write_bytes(
        "CNPJ_FUNDO;DENOM_SOCIAL;TP_FUNDO;SITUACAO;VL_PATRIM_LIQ\n2;Fundo Ações;FI;OK;10.5\n1;Outro;FI;OK;1\n".encode(
            "latin1"
        )
    )
    frame = files.scan_register(spark, str(path))
    df = files.normalize_register(frame)
    assert df.columns == ["cnpj", "fund_name", "fund_type", "status", "class_type", "net_worth"]
    assert df.where("cnpj = '2'").first()["fund_name"] == "Fundo Ações"
    assert df.where("class_type is null").count() == 2
    assert [r["cnpj"] for r in files.normalize_register(frame, max_rows=1).collect()] == ["1"]


def test_audit_load(spark, tmp_path):
    path = tmp_path / "audit.jsonl"
    path.write_text(
        '{"timestamp": "2026-01-01T00:00:00+00:00", "status": "answered", "question": "q", '
        '"citations": ["doc1.md", "doc2.md"], "guarded_sql": null, "response": "r"}\n\n'
    )
    rows = sinks.load_audit(spark, str(path)).collect()
    assert [(r["citations"], r["guarded_sql"]) for r in rows] == [("doc1.md, doc2.md", None)]
    empty = sinks.load_audit(spark, str(tmp_path / "absent.jsonl"))
    assert empty.count() == 0 and dict(empty.dtypes)["citations"] == "string"


def test_malformed_json_line_is_an_error(spark, tmp_path):
    path = tmp_path / "audit.jsonl"
    path.write_text("{not json}\n")
    with pytest.raises(Exception, match="MALFORMED"):
        files.scan_jsonl(spark, str(path)).select(F.count("question")).collect()
