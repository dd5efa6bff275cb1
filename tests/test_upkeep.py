"""Tables kept up to date batch by batch, against the same built at once."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.plans import gold, marts, staging, states
from riskloom.sources import corpus_index, files, key_index, keyed, sinks, snapshots

# Keyed tables.


def _merged(spark, path: str) -> dict:
    return {r["k"]: r["v"] for r in snapshots.read_snapshot(spark, path).collect()}


def test_merges_equal_a_dictionary(spark, tmp_path):
    some, path, expected = random.Random(4), str(tmp_path / "t"), {}
    for step in range(5):
        rows = {some.randrange(60): (step, some.random()) for _ in range(some.choice([3, 30]))}
        gone = [some.randrange(60) for _ in range(4)]
        df = spark.createDataFrame([(k, s, v) for k, (s, v) in rows.items()], "k int, s int, v double")
        taken = spark.createDataFrame([(k,) for k in gone], "k int")
        keyed.merge_rows(path, df, ["k"], [F.desc("s")], gone=taken, part_rows=5)
        for k in gone:
            expected.pop(k, None)
        expected |= {k: v for k, (_, v) in rows.items()}
        assert _merged(spark, path) == expected
        parts = snapshots.snapshot(spark, path)
        assert sum(p["rows"] for p in parts.parts.values()) == len(expected)
    everything = spark.createDataFrame([(k,) for k in expected], "k int")
    keyed.merge_rows(path, everything.where("false").selectExpr("k", "0 AS s", "0D AS v"), ["k"], [F.desc("s")],
                     gone=everything, part_rows=5)
    assert _merged(spark, path) == {}
    keyed.merge_rows(path, spark.createDataFrame([(1, 1, 1.0)], "k int, s int, v double"), ["k"], [F.desc("s")])
    assert _merged(spark, path) == {1: 1.0}


def test_null_keys_are_one_key_and_an_empty_table_can_begin(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = spark.createDataFrame([], "k int, s int, v double")
    keyed.merge_rows(path, empty, ["k"], [F.desc("s")])
    assert snapshots.read_snapshot(spark, path).count() == 0
    rows = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), (3, 1, 3.0)], "k int, s int, v double")
    keyed.merge_rows(path, rows, ["k"], [F.desc("s")])
    assert _merged(spark, path) == {None: 2.0, 3: 3.0}
    keyed.merge_rows(path, empty, ["k"], [F.desc("s")], gone=rows.where("k is null"))
    assert _merged(spark, path) == {3: 3.0}


def test_long_rows_make_more_parts(spark, tmp_path, monkeypatch):
    """A part is written by one task, so it may not grow with the bytes of its rows."""
    monkeypatch.setattr(keyed, "PART_BYTES", 50_000)
    path = str(tmp_path / "t")
    rows = spark.range(400).selectExpr("id AS k", "1 AS s", "repeat('x', 1000) AS text")
    done = keyed.merge_rows(path, rows, ["k"], [F.desc("s")])
    assert len(done.parts) == 9 and max(p["bytes"] for p in done.parts.values()) < 100_000
    more = spark.range(10).selectExpr("id AS k", "2 AS s", "repeat('y', 200000) AS text")
    done = keyed.merge_rows(path, more, ["k"], [F.desc("s")])
    assert len(done.parts) > 30 and sum(p["rows"] for p in done.parts.values()) == 400
    found = snapshots.read_snapshot(spark, path).groupBy(F.length("text").alias("n")).count().collect()
    assert sorted(map(tuple, found)) == [(1_000, 390), (200_000, 10)]


# Unique values over batches.


def test_duplicates_over_batches(spark, tmp_path):
    some, path, held = random.Random(6), str(tmp_path / "index"), {}
    batches = [(f"b{k}", [some.choice(["", "x", None, *map(str, range(40))]) for _ in range(25)]) for k in range(4)]
    for batch, values in [*batches, ("b1", ["7", "7", "new", None])]:
        df = spark.createDataFrame([(v, 1) for v in values], "name string, batch_id int")
        found = {(r["value"], r["rows"], r["earlier_batch"], r["duplicates"])
                 for r in key_index.check_batch(df, "name", batch, path, part_rows=8).collect()}
        held.pop(batch, None)
        expected = set()
        for value, n in Counter(v for v in values if v is not None).items():
            earlier = min((b for b, other in held.items() if value in other), default=None)
            if n - (earlier is None) > 0:
                expected.add((value, n, earlier, n - (earlier is None)))
        assert found == expected
        held[batch] = values
    index = snapshots.read_snapshot(spark, path)
    assert index.count() == sum(len({v for v in values if v is not None}) for values in held.values())


def test_old_rows_are_not_read(spark, tmp_path):
    """Few new values touch few parts of the index."""
    path = str(tmp_path / "index")
    old = spark.range(500).selectExpr("cast(id AS string) AS v")
    assert key_index.check_batch(old, "v", "1", path, part_rows=10).count() == 0
    probe = spark.createDataFrame([("7",)], "v string")
    digest = probe.select(F.sha2(F.concat(F.lit("1"), "v"), 256).alias("digest"))
    known = keyed.current_rows(spark, path, ["digest"], digest)
    assert known.count() < 100
    assert [tuple(r) for r in key_index.check_batch(probe, "v", "2", path).collect()] == [("7", 1, "1", 1)]
    nulls = spark.createDataFrame([(None,), (None,), ("",)], "v string")
    assert [tuple(r) for r in key_index.check_batch(nulls, "v", "3", path, nulls=True).collect()] == [(None, 2, None, 1)]


# An index of a changing corpus.


def test_only_changes_of_a_corpus_are_embedded(spark, tmp_path):
    path, embedded = str(tmp_path / "index"), []

    def embed(rows):
        embedded.append(sorted(r["vec_id"] for r in rows.collect()))
        return rows.withColumn("vector", F.array(F.length("text").cast("float")))

    def update(*texts):
        df = spark.createDataFrame([(k, s, t, 1) for k, s, t in texts], "vec_id int, source string, text string, change int")
        counts = corpus_index.update_index(df, path, embed, part_rows=2)
        rows = corpus_index.read_index(spark, path).collect()
        assert {(r["vec_id"], r["source"], r["text"], r["vector"][0]) for r in rows} == {
            (k, s, t, None if t is None else float(len(t))) for k, s, t in texts}
        return counts

    first = [(k, f"{k}.md", "text " * k) for k in range(1, 9)]
    assert update(*first) == {"new": 8}
    assert update(*first) == {} and len(embedded) == 1
    changed = [(k, s, "other" if k == 3 else t) for k, s, t in first if k != 5] + [(20, "20.md", "new"), (21, None, None)]
    assert update(*changed) == {"new": 2, "changed": 1, "removed": 1}
    assert embedded[1:] == [[3, 20, 21]]
    assert update(*changed, (22, "", "")) == {"new": 1}
    assert update((21, None, None)) == {"removed": 10 - 1}


# Marts from states.


TRANSACTIONS = ("transaction_id string, customer_id string, account_id string, transaction_date string, channel string, "
                "transaction_type string, amount string, is_suspicious string")
LOANS = ("loan_id string, customer_id string, product_type string, origination_date string, maturity_date string, "
         "principal_amount string, outstanding_balance string, interest_rate string, days_past_due string, risk_rating string")


def _transactions(spark, seed: int, n: int):
    some = random.Random(seed)
    rows = [(some.choice([None, *(f"t{k}" for k in range(30))]), "c", "a", some.choice([None, "2024-01-01", "2024-01-02"]),
             some.choice([None, "PIX", "ATM"]), some.choice(["DEBIT", "CREDIT"]),
             some.choice([None, f"{some.random() * 100:.2f}"]), some.choice([None, "true", "false"])) for _ in range(n)]
    return spark.createDataFrame(rows, TRANSACTIONS)


def _loans(spark, seed: int, n: int):
    some = random.Random(seed)
    rows = [(some.choice([None, f"l{k}"]), some.choice([None, *(f"c{k}" for k in range(6))]), "X", "2020-01-01", "2030-01-01",
             "100.10", some.choice([None, f"{some.random() * 100:.2f}"]), "0.1", some.choice([None, str(some.randrange(120))]),
             "A") for k in range(n)]
    return spark.createDataFrame(rows, LOANS)


def _same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    right = right.select(*left.columns)
    assert [t for _, t in left.dtypes] == [t for _, t in right.dtypes]
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def _compare(spark, lake: str):
    transactions = files.scan_layer(spark, lake, "bronze", "transactions")
    loans = files.scan_layer(spark, lake, "bronze", "loans")
    customers = spark.createDataFrame([(f"c{k}", "S", "SP", k) for k in range(8)],
                                      "customer_id string, segment string, state string, internal_score int")
    _same(states.daily_transactions(states.read_states(spark, lake, "daily_transactions")),
          marts.mart_daily_transactions(staging.stg_transactions(transactions)))
    _same(states.daily_monitoring(states.read_states(spark, lake, "daily_monitoring")),
          gold.local_daily_transaction_monitoring(gold.for_gold(transactions)))
    _same(states.customer_exposure(customers, states.read_states(spark, lake, "customer_loans")),
          marts.mart_customer_exposure(customers, staging.stg_loans(loans)))


def test_marts_from_states_equal_rebuilt_marts(spark, tmp_path):
    lake = str(tmp_path)
    update = lambda: [states.update_states(spark, lake, name) for name in states.STATES]
    for batch, seed in (("b1", 1), ("b2", 2)):
        sinks.write_batch(_transactions(spark, seed, 80), lake, "bronze", "transactions", batch)
        sinks.write_batch(_loans(spark, seed, 40), lake, "bronze", "loans", batch)
        assert update() == [[batch]] * 3
        _compare(spark, lake)
    assert update() == [[]] * 3
    # A corrected batch, an empty one, and one that is taken back.
    sinks.write_batch(_transactions(spark, 9, 50), lake, "bronze", "transactions", "b1")
    sinks.write_batch(_loans(spark, 9, 0).limit(0), lake, "bronze", "loans", "b3")
    assert update() == [["b1"], ["b1"], ["b3"]]
    _compare(spark, lake)
    assert update() == [[]] * 3
    (tmp_path / "bronze/transactions/batch_id=b2").rename(tmp_path / "bronze/transactions/_taken_back")
    assert update() == [[]] * 3
    _compare(spark, lake)
    with pytest.raises(FileNotFoundError):
        states.read_states(spark, str(tmp_path / "none"), "daily_transactions")
