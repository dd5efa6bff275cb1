"""The weighted hash tree: its laws, where rows move, and slots of repeated rows."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import replace

import compare
import pytest
from conftest import SMALL

from riskloom.llm import sharding
from riskloom.llm.queries import QUERIES
from riskloom.llm.sharding import Leaf, moves, shard_documents, uniform_tree, with_shard


def numbered(spark, n: int):
    return spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text")


def placed(spark, n: int, before: list[Leaf], after: list[Leaf]) -> list:
    return shard_documents(numbered(spark, n), before, after).collect()


def test_every_row_has_its_size_checksum_and_a_gapless_slot(spark):
    rows = QUERIES["op11_shard_tree"](spark, SMALL).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "key")
    for shard in range(16):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = uniform_tree(2, 2, 4)
    for _ in range(3):
        grown = with_shard(tree)
        went = {(r.shard, r.grown_shard) for r in placed(spark, 4_000, tree, grown) if r.shard != r.grown_shard}
        assert went and {to for _, to in went} == {len(tree)}
        tree = grown


def test_only_id_and_tree_decide(spark):
    tree = uniform_tree(2, 2, 4)
    one = {r.doc_id: r.shard for r in placed(spark, 500, tree, tree)}
    other = shard_documents(numbered(spark, 100).selectExpr("doc_id", "'else' AS text"), tree).collect()
    assert all(one[r.doc_id] == r.shard and r.grown_shard is None for r in other)


def test_movement_stays_on_the_path_that_grew(spark):
    tree = uniform_tree(3, 2, 2)
    heavier = [replace(leaf, weight=3.0) if leaf.shard == 5 else leaf for leaf in tree]
    where = {leaf.shard: leaf for leaf in tree}
    rows = placed(spark, 6_000, tree, heavier)
    for r in rows:
        old, new = where[r.shard], where[r.grown_shard]
        if old.region != new.region:
            assert new.region == where[5].region
        elif old.rack != new.rack:
            assert (new.region, new.rack) == (where[5].region, where[5].rack)
        elif old.shard != new.shard:
            assert new.shard == 5
    share = Counter(r.grown_shard for r in rows)
    assert share[5] / len(rows) == pytest.approx(3 / 14, abs=0.02)
    report = moves(shard_documents(numbered(spark, 6_000), tree, heavier)).collect()
    assert sum(r.rows for r in report) == sum(r.shard != r.grown_shard for r in rows)


def test_weights_set_the_shares_and_zero_takes_nothing(spark):
    tree = [Leaf(0, 0, 0, 1.0), Leaf(0, 1, 1, 3.0), Leaf(1, 0, 2, 4.0), Leaf(1, 1, 3, 0.0)]
    share = Counter(r.shard for r in placed(spark, 8_000, tree, tree))
    assert set(share) == {0, 1, 2}
    assert [share[k] / 8_000 for k in range(3)] == pytest.approx([1 / 8, 3 / 8, 1 / 2], abs=0.02)
    for bad in ([Leaf(0, 0, 0, 0.0)], [Leaf(0, 0, 0, -1.0)]):
        with pytest.raises(ValueError, match="weight"):
            shard_documents(numbered(spark, 1), bad)


def test_repeated_rows_take_as_many_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    monkeypatch.setattr(sharding, "GROUP_ROWS", 2)
    rows = [(1, "same")] * 40 + [(None, None)] * 9 + [(k, "") for k in range(2, 30)] + [(1, "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = shard_documents(docs, uniform_tree(1, 1, 2)).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len(t or "") + 1) for i, t in rows)
    for shard in (0, 1):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in found if r.doc_id == 1}) == 1


def test_sql_of_the_descent_has_the_same_rows(spark):
    rows = QUERIES["op11_shard_tree"](spark, SMALL)
    assert compare.difference(rows, compare.connect(SMALL), sharding.ORACLE["op11_shard_tree"]) is None
