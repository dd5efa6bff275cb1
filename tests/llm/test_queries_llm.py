"""The registered queries against their SQL, on the given tables, on odd ones and on empty ones."""

from __future__ import annotations

import json
import subprocess
import sys

import compare
import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import ROOT, SMALL

from riskloom.llm.queries import ORACLE, QUERIES

LONG = "on and " * 9_000 + "x" * 70_000
PASSAGE = " ".join(f"w{k}" for k in range(40))
NEAR = PASSAGE.replace("w20", "other")

# Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use inside.
ROWS = [
    (1, PASSAGE + "\nLine A\nLine B", "en", "a"), (2, PASSAGE, "en", "a"), (3, NEAR, "en", "a"), (4, "", "en", "a"),
    (5, None, "en", "a"), (6, " \t\n\x0b ", "fr", None), (7, LONG, "en", None), (8, LONG, None, "b"),
    (9, "word", "fr", "b"), (10, "WORD", "fr", "b"), (11, "Line A\n" + NEAR, None, "a"), (11, "Line A\n" + NEAR, None, "a"),
    (12, "12 34 !?", "es", "c"), (13, "Line A", "en", "a"), (14, "Line A\nsecond\n\nline here", "en", "a"),
    (15, "Line A \nthird one", "en", "a"), (16, "é" * 50 + " ñandú", "es", "é"), (17, "Line A\n" * 3 + "end", "en", "a"),
    (18, "a b c d e f g h i j k l m a b c d e f g h i j k l m", "en", "z"), (-5, "a b c d e f g h i j k l m", "en", "z"),
]
NAMES = ("key", "slot", "sign", "size", "range", "row", "taken", "score", "gone", "n", "cid", "toxic", "quality", "copy")


def write(folder, name: str, columns: dict, schema: list) -> None:
    pq.write_table(pa.table(columns, schema=pa.schema(schema)), f"{folder}/{name}.parquet")


def tables(folder, rows: list, ids=pa.int64()) -> str:
    """The tables that the queries read, with ``rows`` as documents."""
    text, number = pa.string(), pa.int64()
    extra = {name: [k % 3 for k in range(len(rows))] for name in NAMES}
    write(folder, "documents", {
        "doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows],
        "source": [r[3] for r in rows], "n_chars": [len(r[1]) if r[1] else None for r in rows], **extra,
    }, [("doc_id", ids), ("text", text), ("lang", text), ("source", text), ("n_chars", number),
        *((name, number) for name in NAMES)])
    some = bool(rows)
    items = [(1, PASSAGE), (2, "  b C d  "), (None, "word"), (4, None), (5, "!!"), (1, "é"), (7, "34")] if some else []
    write(folder, "benchmark", {"item_id": [i[0] for i in items], "text": [i[1] for i in items]},
          [("item_id", number), ("text", text)])
    labels = [(1, 1, 0), (2, 1, 0), (3, None, 1), (None, 1, 1), (99, 1, 0), (14, 1, 1), (2, 0, 0)] if some else []
    write(folder, "labels", {"doc_id": [i[0] for i in labels], "quality": [i[1] for i in labels],
                             "toxic": [i[2] for i in labels]},
          [("doc_id", number), ("quality", pa.int32()), ("toxic", pa.int32())])
    turns = [(1, 0, "user", "hi <b>\\l</b>"), (1, 1, "assistant", None), (2, 0, "user", "hi <b>\\l</b>"),
             (2, 1, "assistant", "</turn>\n<turn user>\nno"), (3, None, "user", "z"), (3, 0, None, ""),
             (3, 0, None, ""), (None, 5, "assistant", "\\\\g"), (4, 0, "user", "hi <b>\\l</b>"), (4, 1, "assistant", ""),
             (4, 2, "a>\nb", LONG[:20_000]), (5, 0, "assistant", "x" * 5_000)] if some else []
    write(folder, "conversations", {"conv_id": [t[0] for t in turns], "turn": [t[1] for t in turns],
                                    "role": [t[2] for t in turns], "text": [t[3] for t in turns]},
          [("conv_id", number), ("turn", number), ("role", text), ("text", text)])
    return str(folder)


@pytest.fixture(scope="session")
def odd(tmp_path_factory) -> str:
    return tables(tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="session")
def empty(tmp_path_factory) -> str:
    return tables(tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare.difference(df, compare.connect(SMALL), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql_on_odd_rows(spark, odd, name):
    assert compare.difference(QUERIES[name](spark, odd), compare.connect(odd), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert [r["conv_id"] for r in rows] == ([-7] if name.startswith("op9") else [])


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_null_ids(spark, tmp_path):
    rows = [(None, PASSAGE, "en", "a"), (None, PASSAGE, "en", "a"), (3, PASSAGE, "en", "a"), (None, None, None, None)]
    folder = tables(tmp_path, rows)
    for name in ("op4_line_dedup", "op5_mix_sources", "op7_benchmark_hits", "op11_shard_tree", "op12_ranked_search"):
        assert compare.difference(QUERIES[name](spark, folder), compare.connect(folder), ORACLE[name]) is None
    removed = {(r.doc_id, r.n_words, r.n_removed) for r in QUERIES["op1_substring_dedup"](spark, folder).collect()}
    assert removed == {(None, 40, 0), (3, 40, 0), (None, 0, 0)}
    groups = [(r.doc_id, r.component_id, r.kept) for r in QUERIES["op10_near_groups"](spark, folder).collect()]
    assert sorted(groups, key=str) == [(3, 3, True)] + [(None, None, True)] * 3
    for name in ("op2_language_id", "op3_quality", "op6_toxicity", "op8_lz_fingerprint"):
        assert QUERIES[name](spark, folder).count() == 4


def test_pipeline_stages_keep_the_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, odd)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        assert kept.exceptAll(docs).count() == 0 or name == "line dedup"
    rows = corpus_pipeline.run(spark, odd)
    assert {"doc_id", "text", "copy", "words"} <= set(rows.columns)
    assert rows.count() == rows.select("doc_id", "copy").distinct().count() > 0


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_stage_by_stage(spark):
    """Each stage against what its operator says of the same rows."""
    import riskloom.llm.frames as frames

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language ID"](spark, docs, SMALL).count()
    assert 0 < told <= docs.count()
    near = frames.written(stages["MinHash near-dedup"](spark, docs, SMALL), "test-near")
    sets = {}
    for r in docs.collect():
        words = "".join(c.lower() if c.isascii() else c for c in r.text or "").encode().split()
        sets[r.doc_id] = {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    reach = {k: k for k in sets}

    def root(k):
        while reach[k] != k:
            k = reach[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                reach[high] = low
    assert sorted(r.doc_id for r in near.collect()) == sorted(k for k in sets if root(k) == k)
    hits = QUERIES["op7_benchmark_hits"](spark, SMALL).where("contaminated").select("doc_id")
    clean = stages["benchmark decontamination"](spark, docs, SMALL)
    assert clean.count() == docs.count() - hits.count() and clean.join(hits, "doc_id").count() == 0
    mixed = stages["mixing sources to target weights"](spark, docs, SMALL)
    taken = QUERIES["op5_mix_sources"](spark, SMALL).where("taken > 0").select("doc_id", "taken")
    summed = mixed.where("words > 0").groupBy("doc_id").agg({"words": "sum"}).withColumnRenamed("sum(words)", "taken")
    assert summed.exceptAll(taken).count() == taken.exceptAll(summed).count() == 0
    from pyspark.sql import functions as F

    counted = mixed.withColumn("own", frames.n_words("text"))
    assert counted.where(F.col("own") != F.col("words")).count() == 0


def test_the_library_imports_without_the_subpackage():
    code = (
        "import sys, json; sys.modules['riskloom.llm'] = None; sys.path.insert(0, sys.argv[1]);"
        "import __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    )
    out = subprocess.run([sys.executable, "-c", code, ROOT], capture_output=True, text=True, check=True).stdout
    queries, oracle = json.loads(out.splitlines()[-1])
    assert "pipeline" not in queries and len(queries) > 90 and oracle
