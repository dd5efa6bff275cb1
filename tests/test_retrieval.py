"""Keyword and vector top-k against brute force."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskloom.operators import joins, keyword_index, retrieval, vector_index
from riskloom.operators.retrieval import keyword_topk, vector_topk
from riskloom.sources.sinks import index_corpus


def _brute(questions, corpus, k):
    best = {}
    for question in questions:
        words = re.findall("[a-z0-9_]+", question.lower())
        scored = []
        for source, text in corpus:
            uses = Counter(re.findall("[a-z0-9_]+", text.lower()))
            score = sum(uses[w] for w in words)
            if score:
                scored.append((-score, source))
        best[question] = [(source, -score) for score, source in sorted(scored)[:k]]
    return {q: hits for q, hits in best.items() if hits}


def _found(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["question"], r["rank"])):
        found.setdefault(r["question"], []).append((r["source"], r["score"]))
    return found


def test_keyword_topk_matches_brute_force_in_blocks(spark):
    rng = random.Random(3)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    corpus = [(f"d{i:03}", " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(120)]
    corpus += [(f"copy{i:03}", corpus[0][1]) for i in range(60)]
    questions = [" ".join(rng.choices(words, k=6)) + "?" for _ in range(25)] + ["nothing here", "The THE the"]
    docs = spark.createDataFrame(corpus, "source string, text string").repartition(5)
    asked = spark.createDataFrame([(q,) for q in questions + questions[:5]], "question string")
    expected = _brute(questions, corpus, 4)
    for block in (1, 7, 512):
        assert _found(keyword_topk(asked, docs, 4, block)) == expected


def test_hits_carry_their_compacted_text(spark, monkeypatch):
    long = "alpha " + "x" * 2000
    docs = spark.createDataFrame([("a", " alpha\n beta "), ("b", long), ("c", "gamma")], "source string, text string")
    asked = spark.createDataFrame([("alpha?",), ("beta",), ("alpha beta",)], "question string")
    expected = {("alpha?", "a"): "alpha beta", ("alpha?", "b"): long[:897] + "...", ("beta", "a"): "alpha beta",
                ("alpha beta", "a"): "alpha beta", ("alpha beta", "b"): long[:897] + "..."}
    for measured in (True, False):
        monkeypatch.setattr(joins, "fits", lambda df, *bounds, measured=measured: measured)
        rows = retrieval.retrieve_context(asked, docs).collect()
        assert {(r["question"], r["source"]): r["text"] for r in rows} == expected


def test_a_text_is_compacted_once_whatever_the_hits(spark, monkeypatch):
    """Only texts that hits name are compacted, and never above the join, where each hit would do it again."""
    compacted, plain = [], retrieval.staged
    monkeypatch.setattr(retrieval, "staged", lambda df, *a: compacted.append((a[0], df.count())) or plain(df, *a))
    docs = spark.createDataFrame([("a", "alpha  beta"), ("b", "gamma"), ("c", None)], "source string, text string")
    hits = spark.createDataFrame([(f"q{k}", "a") for k in range(30)] + [("q", None), ("q", "z")], "question string, source string")
    found = retrieval.with_text(hits, docs, "source")
    assert sorted(map(tuple, found.collect())) == sorted((f"q{k}", "a", "alpha beta") for k in range(30))
    assert ("texts", 1) in compacted
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_vector_topk_matches_brute_force_in_blocks(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8)).astype("float32")
    vectors[100:200] = vectors[7]
    vectors[299] = 0
    queries = rng.normal(size=(7, 8))
    queries[3] = vectors[7]
    corpus = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(999, None)],
        "vec_id bigint, vector array<float>",
    ).repartition(4)
    asked = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)],
                                  "query_id bigint, vector array<double>")
    norms = np.linalg.norm(vectors.astype("float64"), axis=1)
    cosines = (vectors.astype("float64") @ queries.T) / np.where(norms > 0, norms, 1)[:, None]
    cosines = np.round(cosines / np.linalg.norm(queries, axis=1), 6)
    expected = {
        (q, rank + 1): (int(i), float(cosines[i, q]), int(cosines[i, q] * 100))
        for q in range(7)
        for rank, i in enumerate(sorted(range(300), key=lambda i: (-cosines[i, q], i))[:3])
    }
    for block in (2, 7, 100):
        rows = vector_topk(asked, corpus, 3, block).collect()
        assert {(r["query_id"], r["rank"]): (r["vec_id"], r["cosine"], r["score"]) for r in rows} == expected
    assert vector_topk(asked.where("false"), corpus).count() == 0
    text = vector_topk(asked.where("false").select(F.col("query_id").cast("string"), "vector"), corpus)
    assert dict(text.dtypes)["query_id"] == "string"
    with pytest.raises(Exception, match="lacks its id or vector"):
        vector_topk(asked.unionByName(spark.createDataFrame([(9, None)], asked.schema)), corpus).collect()


def test_repeated_query_ids_do_not_depend_on_the_block(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])],
                                   "vec_id bigint, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])],
                                  "query_id bigint, vector array<double>")
    for block in (1, 9):
        rows = vector_topk(asked, corpus, 2, block).collect()
        assert {(r["query_id"], r["rank"], r["vec_id"], r["cosine"]) for r in rows} == {
            (1, 1, 1, 1.0), (1, 2, 2, 1.0), (2, 1, 3, 1.0), (2, 2, 1, 0.707107)}


def test_index_is_kept_unless_forced(spark, tmp_path):
    path = str(tmp_path / "index")
    one = spark.createDataFrame([(1, [1.0, 0.0], "a.md", "x")],
                                "vec_id bigint, vector array<float>, source string, text string")
    assert index_corpus(one, path)
    assert not index_corpus(one.union(one), path)
    assert spark.read.parquet(path).count() == 1
    assert index_corpus(one.union(one), path, force=True)
    assert spark.read.parquet(path).count() == 2


def test_a_kept_keyword_index_answers_like_the_texts(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{int(rng.expovariate(0.1))}" for _ in range(400)]
    corpus = [(f"d{i:03}", " ".join(rng.choices(words, k=rng.randrange(0, 80)))) for i in range(300)]
    corpus += [(f"copy{i:03}", corpus[0][1]) for i in range(100)] + [("none", None), ("blank", " !? ")]
    questions = [" ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(40)] + ["w1 w1 W1", "absent", "?"]
    path = str(tmp_path / "index")
    texts = spark.createDataFrame(corpus, "source string, text string").repartition(3)
    keyword_index.keyword_blocks(texts, block=16).write.parquet(path)
    index = spark.read.schema(keyword_index.INDEX).parquet(path)
    assert index.count() > 20
    asked = spark.createDataFrame([(q,) for q in questions], "question string")
    expected = _brute(questions, [(s, t or "") for s, t in corpus], 5)
    assert _found(keyword_index.search_keywords(asked, index, 5)) == expected
    assert _found(keyword_index.search_keywords(asked, index, 5, part=11)) == expected
    uses = Counter(w for _, t in corpus for w in (t or "").split() if w.startswith("w"))
    held = Counter(w for _, t in corpus for w in set((t or "").split()) if w.startswith("w"))
    found = {r["term"]: (r["documents"], r["uses"]) for r in keyword_index.index_terms(index).collect()}
    assert found == {w: (held[w], n) for w, n in uses.items()}


def test_an_index_is_written_in_row_groups_of_few_blocks(spark, tmp_path):
    """A reader holds a row group at once, so its size must not grow with the index."""
    path = str(tmp_path / "index")
    corpus = [(f"d{i:04}", " ".join(f"w{i}x{k}" for k in range(2_000))) for i in range(400)]
    texts = spark.createDataFrame(corpus, "source string, text string").coalesce(1)
    keyword_index.write_blocks(keyword_index.keyword_blocks(texts), path)
    groups = [pq.ParquetFile(f).metadata for f in (tmp_path / "index").glob("*.parquet")]
    sizes = [meta.row_group(k).total_byte_size for meta in groups for k in range(meta.num_row_groups)]
    assert len(sizes) > 2 and max(sizes) < 4 * keyword_index.KEPT["parquet.block.size"]
    index = spark.read.parquet(path)
    assert index.agg(F.max(F.size("docs"))).first()[0] <= keyword_index.BLOCK_POSTINGS + 2_000
    assert index.agg(F.sum(F.size("sources"))).first()[0] == 400


def test_terms_of_a_block_are_summed_in_one_pass(spark):
    words = [f"w{k}" for k in range(60_000)]
    index = keyword_index.keyword_blocks(spark.createDataFrame([("a", " ".join(words + words[:9]))],
                                                               "source string, text string"))
    begin = time.monotonic()
    found = keyword_index.index_terms(index).groupBy("documents", "uses", "most").count().collect()
    assert sorted(map(tuple, found)) == [(1, 1, 1, 59_991), (1, 2, 2, 9)]
    assert time.monotonic() - begin < 20


def test_blocks_that_cannot_reach_the_score_are_skipped(spark, monkeypatch):
    """A block's documents are scored only where its bound allows it."""
    corpus = [(f"d{i:03}", "rare " * 50 if i < 10 else "rare") for i in range(200)]
    index = keyword_index.keyword_blocks(spark.createDataFrame(corpus, "source string, text string").coalesce(1), 10)
    rows = index.toArrow().to_batches()
    asked = keyword_index._Asked.of([{"question": "rare", "words": ["rare"]}])
    beat, found, scored = np.array([1]), [[]], []
    plain = keyword_index._stretches
    monkeypatch.setattr(keyword_index, "_stretches", lambda begins, ends: scored.append(1) or plain(begins, ends))
    for batch in rows:
        for k in range(batch.num_rows):
            keyword_index._score_block(batch.slice(k, 1), asked, beat, found, 4)
    assert len(scored) == 2 and [s for _, s in found[0]] == ["d000", "d001", "d002", "d003"]
    assert max(b.column("longest")[0].as_py() for b in rows) == 50


def test_every_number_of_cells_gives_the_same_neighbours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PACK_VECTORS", 32)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 6)) * 3
    vectors = np.concatenate([centres[rng.integers(0, 12, 500)] + rng.normal(size=(500, 6)) * 0.2,
                              np.repeat(centres[:1], 80, axis=0), np.zeros((5, 6))])
    queries = np.concatenate([vectors[::97], rng.normal(size=(4, 6)), np.zeros((1, 6))])
    frame = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)],
                                  "vec_id bigint, vector array<double>").repartition(4)
    asked = spark.createDataFrame([(int(i), [float(x) for x in q]) for i, q in enumerate(queries)],
                                  "query_id bigint, vector array<double>")
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1) > 0, np.linalg.norm(m, axis=1), 1)[:, None]
    cosines = np.round(unit(vectors) @ unit(queries).T, 6)
    expected = {(q, rank + 1): int(i) for q in range(len(queries))
                for rank, i in enumerate(sorted(range(len(vectors)), key=lambda i: (-cosines[i, q], i))[:5])}
    for cells in (1, 3, 40, 1_000):
        path = str(tmp_path / str(cells))
        vector_index.vector_packs(frame, cells).write.parquet(path)
        packs = spark.read.parquet(path)
        for part in (3, None):
            rows = vector_index.search_vectors(asked, packs, 5, part).collect()
            assert {(r["query_id"], r["rank"]): r["vec_id"] for r in rows} == expected
    assert packs.count() > 20


@pytest.mark.parametrize(("bad", "told"), [
    ([0.0, 1.0, 0.0], "elements"), ([0.0, 1.0, 0.0, 0.0, 0.0], "elements"), ([0.0, None, 0.0, 0.0], "not a number"),
    ([0.0, float("nan"), 0.0, 0.0], "not a number"), ([0.0, float("inf"), 0.0, 0.0], "not a number"), ([], "elements"),
])
def test_odd_vectors_are_errors(spark, bad, told):
    good = [0.0, 1.0, 0.0, 0.0]
    schema = "vec_id bigint, vector array<double>"
    asked = spark.createDataFrame([(1, good)], "query_id bigint, vector array<double>")
    for rows in ([(1, bad)], [(1, good), (2, bad)]):
        with pytest.raises(Exception, match=told):
            vector_topk(asked, spark.createDataFrame(rows, schema)).collect()
    with pytest.raises(Exception, match=told):
        odd = asked.unionByName(spark.createDataFrame([(2, bad)], asked.schema))
        vector_topk(odd, spark.createDataFrame([(1, good)], schema)).collect()
    with pytest.raises(Exception, match="lacks its id or vector"):
        vector_topk(asked, spark.createDataFrame([(None, good)], schema)).collect()


def test_a_search_reads_few_blocks_at_once(spark, monkeypatch):
    """While blocks are read, the reader and the batches hold few; the caller's settings come back."""
    keys = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch")
    before, seen, plain = [spark.conf.get(k) for k in keys], [], keyword_index.staged
    monkeypatch.setattr(keyword_index, "staged", lambda *a: seen.append([spark.conf.get(k) for k in keys]) or plain(*a))
    docs = spark.createDataFrame([(f"d{k}", f"one w{k}") for k in range(40)], "source string, text string")
    asked = spark.createDataFrame([("one w7",), ("w9",)], "question string")
    found = {(r.question, r["rank"]): r.source for r in keyword_topk(asked, docs, 2).collect()}
    assert found == {("one w7", 1): "d7", ("one w7", 2): "d0", ("w9", 1): "d9"}
    assert seen == [[keyword_index.READ_BLOCKS, keyword_index.READ_BYTES]]
    assert [spark.conf.get(k) for k in keys] == before


@pytest.mark.parametrize("held", [3_000_000, 12])
def test_small_parts_of_questions_take_no_passes_of_their_own(spark, monkeypatch, held):
    """Whatever is scored at once, blocks are read once per unit of questions, and hits are those of scoring all."""
    rng = random.Random(11)
    words = ["the"] * 20 + [f"w{i}" for i in range(60)]
    corpus = [(f"d{i:03}", " ".join(rng.choices(words, k=int(rng.expovariate(0.02)) + 1))) for i in range(250)]
    questions = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(60)] + ["w1 w1 w1 the", "nothing"]
    docs = spark.createDataFrame(corpus, "source string, text string").repartition(4)
    index = retrieval.staged(keyword_index.keyword_blocks(docs, 8), "index")
    asked = spark.createDataFrame([(q,) for q in questions], "question string")
    expected, written, plain = _brute(questions, corpus, 3), [], keyword_index.staged
    monkeypatch.setattr(keyword_index, "staged", lambda *a: written.append(1) or plain(*a))
    monkeypatch.setattr(keyword_index, "HELD", held)
    monkeypatch.setattr(keyword_index, "SEED_BLOCKS", 2)
    for part in (1, 7, 500):
        written.clear()
        assert _found(keyword_index.search_keywords(asked, index, 3, part)) == expected
        assert len(written) == 1 if held > 12 else 1 < len(written)
    empty = spark.createDataFrame([], keyword_index.INDEX)
    assert keyword_index.search_keywords(asked, empty, 3).collect() == []
    assert keyword_index.search_keywords(asked.where("false"), index, 3).collect() == []


def test_blocks_hold_documents_of_similar_length_from_all_tasks(spark):
    corpus = [(f"d{i:04}", "word " * (400 if i % 100 == 0 else 4 + i % 2)) for i in range(1_600)]
    docs = spark.createDataFrame(corpus, "source string, text string").repartition(8)
    rows = keyword_index.keyword_blocks(docs, 16).select("sources", "longest").collect()
    assert sorted(len(r.sources) for r in rows if r.longest == 400) == [16]
    assert sum(len(r.sources) for r in rows) == 1_600


def test_the_first_blocks_travel_once(spark, monkeypatch):
    """What travels to the tasks holds every block once, not with the others it was read with."""
    monkeypatch.setattr(keyword_index, "SEED_BLOCKS", 12)
    rng = random.Random(2)
    docs = [(f"d{k}", " ".join(f"{rng.getrandbits(60):x}" for _ in range(600))) for k in range(40)]
    index = retrieval.staged(keyword_index.keyword_blocks(spark.createDataFrame(docs, "source string, text string"), 2), "i")
    seeds = keyword_index._longest_blocks(index)
    blocks = list(keyword_index._rows(pa.ipc.open_stream(seeds)))
    assert len(blocks) == 12 and len(seeds) < 12 * 2 * 600 * 50


def test_documents_without_a_source_rank_before_others_of_their_score(spark):
    docs = spark.createDataFrame([("b", "x"), (None, "x"), ("a", "x x"), (None, "x"), ("", "x")], "source string, text string")
    asked = spark.createDataFrame([("x",)], "question string")
    for parts in (1, 4):
        hits = keyword_topk(asked, docs.repartition(parts), 4).orderBy("rank").collect()
        assert [(r.source, r.score) for r in hits] == [("a", 2), (None, 1), (None, 1), ("", 1)]


def test_questions_need_documents_of_enough_words(spark):
    """A score is at most the words of a document times the largest use of a question word."""
    index = keyword_index.keyword_blocks(
        spark.createDataFrame([("a", "x " * 90), ("b", "x " * 50 + "y"), ("c", "x")], "source string, text string"), 1)
    seeds = [row for row in keyword_index._rows(index.toArrow().to_batches()) if row.column("longest")[0].as_py() > 1]
    asked = spark.createDataFrame([(1, ["x", "x", "y"]), (2, ["y"])], "q bigint, words array<string>")
    found = {r.question: (r.beat, r.low) for r in keyword_index._seeded(asked, keyword_index._packed(seeds), 2, 9).collect()}
    assert found == {1: (101, 51), 2: (1, 1)}
