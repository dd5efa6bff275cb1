"""Event publishing and the running summary."""

from __future__ import annotations

import json
from decimal import Decimal
from pathlib import Path

from riskloom.plans import serving
from riskloom.streaming import suspicious

SCHEMA = (
    "transaction_id string, customer_id string, account_id string, transaction_date string, channel string, "
    "amount double, is_suspicious string"
)


def _transactions(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _event(customer, amount, timestamp="2026-05-23T00:00:00+00:00", **more):
    event = {
        "event_type": "suspicious_transaction_detected", "transaction_id": "t", "customer_id": customer,
        "account_id": "a", "transaction_date": "2026-05-22", "channel": "PIX", "amount": amount, **more,
    }
    return event if timestamp is None else {**event, "timestamp": timestamp}


def _drop(folder: Path, name: str, *events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e) for e in events) + "\n\n")


def _drain(spark, folder, tmp_path, max_files=None):
    events = suspicious.events_from_files(spark, str(folder), max_files)
    job = suspicious.maintain_summary(events, str(tmp_path / "summary"), str(tmp_path / "checkpoint"))
    job.awaitTermination()
    rows = suspicious.read_summary(spark, str(tmp_path / "summary")).collect()
    return {
        r["customer_id"]: (r["suspicious_count"], float(r["total_suspicious_amount"]), r["last_suspicious_timestamp"])
        for r in rows
    }


def test_event_batch_holds_flagged_rows_in_order(spark, tmp_path):
    df = _transactions(spark, [
        ("t9", "c", "a", "2026-05-23", "PIX", 3000.0, "true"), ("t2", "c", "a", "2026-05-23", "CARD", 50.0, "false"),
        ("t10", "c", "a", "2026-05-23", "ATM", 1.0, "YES"), ("t3", "c", "a", "2026-05-23", "ATM", 1.0, None),
    ])
    path = suspicious.write_event_batch(df, str(tmp_path), "b1")
    events = [json.loads(x) for f in sorted(Path(path).glob("*.json")) for x in f.read_text().splitlines()]
    assert [e["transaction_id"] for e in events] == ["t10", "t9"]
    assert events[1] == {
        "event_type": "suspicious_transaction_detected", "batch_id": "b1", "transaction_id": "t9", "customer_id": "c",
        "account_id": "a", "transaction_date": "2026-05-23", "channel": "PIX", "amount": 3000.0,
    }


def test_published_events_flow_into_the_summary(spark, tmp_path):
    raw = tmp_path / "raw"
    _transactions(spark, [
        ("uuid-t1", "uuid-c1", "uuid-a1", "2026-05-23", "PIX", 5000.0, "True"),
        ("uuid-t2", "uuid-c1", "uuid-a1", "2026-05-23", "PIX", 1.0, "False"),
    ]).write.json(str(raw))
    stream = spark.readStream.schema(SCHEMA).json(str(raw))
    job = suspicious.publish_to_files(
        suspicious.suspicious_events(stream), str(tmp_path / "events"), str(tmp_path / "publish-checkpoint")
    )
    job.awaitTermination()
    found = _drain(spark, tmp_path / "events", tmp_path)
    assert found.keys() == {"uuid-c1"}
    assert found["uuid-c1"][:2] == (1, 5000.0)


def test_drain_counts_every_event_once(spark, tmp_path):
    folder = tmp_path / "events"
    _drop(folder, "1.jsonl", _event("c1", 10.0), _event("c2", 5.5), _event("c1", 0.1, None))
    first = _drain(spark, folder, tmp_path)
    assert first == {
        "c1": (2, 10.1, "2026-05-23T00:00:00+00:00"), "c2": (1, 5.5, "2026-05-23T00:00:00+00:00"),
    }
    assert _drain(spark, folder, tmp_path) == first
    _drop(folder, "2.jsonl", _event("c1", 1.0, "2026-06-01T00:00:00+00:00"))
    _drop(folder, "3.jsonl", _event("c3", 2.0, None))
    assert _drain(spark, folder, tmp_path, max_files=1) == {
        "c1": (3, 11.1, "2026-06-01T00:00:00+00:00"), "c2": first["c2"], "c3": (1, 2.0, "2026-05-22"),
    }
    suspicious.compact_summary(spark, str(tmp_path / "summary"), str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 3


def test_batch_that_is_run_again_after_a_crash_counts_once(spark, tmp_path):
    folder = tmp_path / "events"
    _drop(folder, "1.jsonl", _event("c1", 10.0), _event("c2", 5.5))
    first = _drain(spark, folder, tmp_path)
    # The sink has the batch but the commit is gone, as when the driver dies between the two.
    commits = tmp_path / "checkpoint" / "commits"
    for name in ("0", ".0.crc"):
        (commits / name).unlink(missing_ok=True)
    _drop(folder, "2.jsonl", _event("c1", 1.0))
    assert _drain(spark, folder, tmp_path) == {**first, "c1": (2, 11.0, first["c1"][2])}


def test_top_flagged_and_kpis(spark):
    df = spark.createDataFrame(
        [(f"c{i}", n, Decimal("1.5")) for i, n in enumerate([3, 9, 3, 1, 9, 3, 3])],
        "customer_id string, suspicious_count bigint, total_suspicious_amount decimal(38,2)",
    )
    assert [r["customer_id"] for r in serving.top_flagged_customers(df).collect()] == ["c1", "c4", "c0", "c2", "c5"]
    kpis = serving.streaming_alert_kpis(df).first()
    assert (kpis["customers_under_alert"], float(kpis["flagged_volume"])) == (7, 10.5)


def test_topic_messages_are_json(spark):
    df = _transactions(spark, [("t1", "c1", "a1", "2026-05-23", "PIX", 2.0, "1")])
    row = suspicious.as_messages(suspicious.suspicious_events(df)).first()
    assert row["key"] == "c1" and json.loads(row["value"])["amount"] == 2.0


def test_every_message_is_an_event_or_a_dead_letter(spark):
    values = ['{"customer_id": "c1", "amount": 1.5}', "{bad", "[1]", "7", None, "", '{"amount": 2}', '{"customer_id": "c2"}',
              '{"customer_id": "c3", "amount": "much"}']
    messages = spark.createDataFrame([(None if v is None else v.encode(), k) for k, v in enumerate(values)],
                                     "value binary, offset int")
    events = suspicious.parsed_messages(messages, strict=False)
    assert sorted(r["customer_id"] for r in events.collect()) == ["c1", "c2"]
    assert events.columns == suspicious.parsed_messages(messages).columns
    letters = {r["offset"]: r["reason"] for r in suspicious.dead_letters(messages).collect()}
    assert letters == {1: "not an event", 2: "not an event", 3: "not an event", 4: "no value", 5: "not an event",
                       6: "no customer", 8: "not an event"}


def test_replays_and_dead_letters_in_a_stream(spark, tmp_path):
    """Files delivered again count once, over restarts; lines that are no events do not stop the stream."""
    folder = tmp_path / "events"
    first = [_event("c1", 10.0, transaction_id="t1"), _event("c2", 5.5, transaction_id="t2"),
             _event("c1", 1.0, transaction_id=None), _event("c1", 1.0, transaction_id=None)]
    _drop(folder, "1.jsonl", *first)

    def drain():
        messages = suspicious.messages_from_files(spark, str(folder), 1)
        suspicious.keep_dead_letters(messages, str(tmp_path / "dead"), str(tmp_path / "dead-cp")).awaitTermination()
        events = suspicious.unique_events(suspicious.parsed_messages(messages, strict=False))
        suspicious.maintain_summary(events, str(tmp_path / "summary"), str(tmp_path / "cp")).awaitTermination()
        return {r["customer_id"]: (r["suspicious_count"], float(r["total_suspicious_amount"]))
                for r in suspicious.read_summary(spark, str(tmp_path / "summary")).collect()}

    assert drain() == {"c1": (2, 11.0), "c2": (1, 5.5)}
    _drop(folder, "2.jsonl", *first, _event("c2", 1.0, transaction_id="t3"))
    (folder / "3.jsonl").write_text('{"customer_id": \n\nnothing\n')
    assert drain() == {"c1": (2, 11.0), "c2": (2, 6.5)}
    dead = spark.read.json(str(tmp_path / "dead")).collect()
    assert sorted((r["value"], r["reason"]) for r in dead) == [("nothing", "not an event"), ('{"customer_id": ', "not an event")]
    assert drain() == {"c1": (2, 11.0), "c2": (2, 6.5)}


def test_unique_events_of_a_table(spark):
    rows = [("t1", "c1", 1.0), ("t1", "c9", 9.0), (None, "c1", 1.0), (None, "c1", 1.0), (None, "c2", None), ("", "c1", 1.0)]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id string, amount double")
    found = suspicious.unique_events(df)
    assert found.columns == df.columns
    assert sorted(str(r["transaction_id"]) for r in found.collect()) == ["", "None", "None", "t1"]
