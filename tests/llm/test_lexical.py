"""Ranked search against scoring every document, and the bounds that let blocks be skipped."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from riskloom.llm import lexical
from riskloom.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> Counter:
    folded = "".join(c.lower() if c.isascii() else c for c in text or "")
    return Counter(TERM.findall(folded))


def brute(docs: list[tuple], items: list[tuple], top_k: int = 10) -> set:
    """``(item_id, rank, doc_id, score)`` by scoring all documents."""
    counts = [terms(text) for _, text in docs]
    n_docs, n_total = sum(bool(c) for c in counts), sum(c.total() for c in counts)
    held = Counter(term for c in counts for term in c)
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item] += terms(text)
    out = set()
    for item, wanted in asked.items():
        scored = []
        for (doc_id, _), c in zip(docs, counts):
            score = 0
            for term, uses in wanted.items():
                if term in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[term] + 1)))
                    m = 100 - 75 + (75 * c.total() * n_docs) // n_total
                    score += uses * w * ((1_000_000_000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:top_k], 1):
            out.add((item, rank, doc_id, -score))
    return out


def corpus(n: int, seed: int) -> tuple[list, list]:
    """Documents in a few topics, with copies, ties, odd texts and terms of every frequency; queries with repeats."""
    some = random.Random(seed)
    topics = [[f"t{k}w{int(some.expovariate(0.05))}" for _ in range(80)] for k in range(6)]
    common = ["the", "Of", "AND", "é", "ñandú", "12"]
    docs = []
    for k in range(n):
        own = some.choice(topics)
        docs.append((k * 7 % n, " ".join(some.choice(own if some.random() < 0.7 else common)
                                         for _ in range(int(some.expovariate(0.03)) + 1))))
    docs += [(n + k, docs[0][1]) for k in range(n // 3)] + [(3, docs[0][1]), (None, docs[0][1]), (None, "the")]
    docs += [(-1, None), (-2, ""), (-3, "!? \n"), (-4, "rare " + "the " * 40_000)]
    items = [(q, " ".join(some.choice(some.choice(topics) + common) for _ in range(some.randrange(1, 30))))
             for q in range(25)]
    items += [(100, "the the THE"), (101, "rare"), (102, "nowhere"), (103, None), (104, "..."), (105, "the"),
              (105, "rare t1w3"), (None, "of é"), (-7, docs[5][1])]
    return docs, items


def frames(spark, docs: list, items: list):
    return (spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, sizes int").repartition(3),
            spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, q int"))


def rows(df) -> set:
    found = [(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()]
    assert len(set(found)) == len(found)
    return set(found)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_scoring_every_document(spark, monkeypatch, small):
    if small:  # many packs, and lists of many blocks
        monkeypatch.setattr(lexical, "PACK_DOCS", 90)
        monkeypatch.setattr(lexical, "BLOCK", 4)
        monkeypatch.setattr(lexical, "SEED_DOCS", 12)
    docs, items = corpus(700, 3)
    assert rows(lexical.ranked(*frames(spark, docs, items))) == brute(docs, items)
    assert rows(lexical.ranked(*frames(spark, docs, items), top_k=3, query_terms=60)) == brute(docs, items, 3)


def test_text_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TEXT_CHUNK", 50)
    docs = [("b", "one two " * 400), ("a", "one two " * 400), (None, "two"), ("é", "three")]
    left = spark.createDataFrame(docs, "doc_id string, text string")
    items = [("x", "two three")]
    right = spark.createDataFrame(items, "item_id string, text string")
    assert rows(lexical.ranked(left, right)) == brute(docs, items)


def test_blocks_are_bound_by_their_coordinatewise_maxima():
    """Every block's summary bounds its members from above in each coordinate, and some member reaches it."""
    docs, items = corpus(400, 9)
    some = Counter(t for _, text in docs for t in terms(text))
    asked = sorted({t for _, text in items for t in terms(text) if t in some})
    entries = [{"item_id": 1, "term": t, "uses": 1, "held": some[t], "weight": 10} for t in asked]
    queries = lexical.Queries.of(entries)
    packs = list(lexical.Counter(terms(text)) for _, text in docs)
    place: dict[str, int] = {}
    places = [place.setdefault(t, len(place)) for c in packs for t in c]
    pack = {"terms": np.array(list(place), dtype=object), "places": np.array(places),
            "ends": np.cumsum([len(c) for c in packs]), "uses": np.array([n for c in packs for n in c.values()]),
            "sizes": np.array([c.total() for c in packs])}
    vectors = lexical.Vectors.of_pack(pack, queries, len(docs), sum(some.values()))
    reach = lexical.coordinates(queries, np.array([1]), vectors.most)
    assert set(reach) == set(range(len(asked)))
    dense = np.zeros((len(docs), len(asked)), dtype=np.int64)
    for d in range(len(docs)):
        own = slice(vectors.begins[d], vectors.begins[d + 1])
        dense[d, vectors.terms[own]] = vectors.impacts[own]
    for term in reach:
        assert set(vectors.list_of(term)) == set(np.flatnonzero(dense[:, term]))
    assert (vectors.most == dense.max(axis=0)).all()
    full = np.flatnonzero(np.diff(vectors.begins))
    wanted = np.arange(len(asked), dtype=np.int64)
    assert (vectors.scores(full, wanted) == dense[full] @ wanted).all()


def test_empty_tables(spark):
    docs, items = frames(spark, [], [])
    assert lexical.ranked(docs, items).collect() == []
    some_docs, some_items = frames(spark, [(1, "a b")], [(1, "a b")])
    assert lexical.ranked(docs, some_items).collect() == lexical.ranked(some_docs, items).collect() == []


def test_a_query_whose_terms_all_documents_hold(spark):
    docs, items = [(k, "same words") for k in range(30)], [(1, "same"), (2, "words same")]
    assert rows(lexical.ranked(*frames(spark, docs, items))) == brute(docs, items)


def test_every_given_item_is_ranked(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert rows(QUERIES["op12_ranked_search"](spark, folder)) == brute(docs, items)


def test_packs_are_written_and_read_one_by_one(spark, monkeypatch):
    """A task holds a pack or two at once, whatever the number of packs that its documents make."""
    monkeypatch.setattr(lexical, "PACK_POSTINGS", 100_000)
    keys = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch")
    seen, tables, plain = {}, {}, lexical.written

    def kept(df, label, *options):
        seen[label] = [spark.conf.get(k) for k in keys]
        tables[label] = plain(df, label, *options)
        return tables[label]

    monkeypatch.setattr(lexical, "written", kept)
    docs = [(k, " ".join(f"{k:x}w{i * 7919:x}" for i in range(100_000)) + " same") for k in range(9)]
    asked, some_docs = [(1, "same 0w0")], spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    out = rows(lexical.ranked(some_docs, spark.createDataFrame(asked, "item_id bigint, text string"), 2))
    assert out == brute(docs, asked, 2)
    folder = tables["packs"].inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    files = [pq.ParquetFile(f).metadata for f in Path(folder).glob("*.parquet")]
    groups = [meta.row_group(k).num_rows for meta in files for k in range(meta.num_row_groups)]
    assert sum(groups) == 9 and max(groups) <= 4
    assert seen["seeds"] == seen["blocked-index"] == seen["hits"] == ["1", "1"] != seen["packs"]
    assert [spark.conf.get(k) for k in keys] == seen["packs"]
