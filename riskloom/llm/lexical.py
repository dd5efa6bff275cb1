"""Ranked lexical search over per-term lists that are blocked by document similarity.

Documents are scored by whole-number term impacts: the weight of a term (how few documents hold it) times a saturated,
length-normalised count. The score of a document for a query is the sum over the query's terms, repeats included.

The index is cut by documents into packs of bounded size, so that a frequent term is never one list:

1. ``forward_packs`` holds every term of every document, in packs with a dictionary each. It knows no queries.
2. ``blocked_index`` inverts the packs for the terms that queries ask. The documents of a term's list are clustered by
   the nearest of some of them in a random projection of their impact vectors, and each cluster is a block whose
   summary holds the coordinatewise maximum of the block's vectors.
3. ``search`` walks a query's lists from the rarest term. A document is judged in the list of its rarest query term, so
   a block's bound is the product of its summary with the query's terms from that one on. A block is skipped only if
   its bound is below the score to beat, and the walk ends when the maxima of all terms left stay below it.

The score to beat starts at the ``top_k``-th best of documents from the rarest lists of all packs, a lower bound of the true
one, and rises within a pack. Lists that no query can reach with it are not blocked, and a summary has the coordinates
that some query asks together with its term. Skipping is by exact whole-number bounds, so results are those of scoring
every document.

Queries are taken in blocks of about ``QUERY_TERMS`` terms (or one query, if it alone is larger), which is what travels to
the tasks; each block passes over the packs, not over the texts. A pack gives at most ``top_k`` rows per query.

Nulls: a null text has no terms; rows that share an item id, null included, are one query with the terms of all; a null
document id sorts last among equal scores. Rows that share a document id are ranked one by one. A query whose terms occur
nowhere has no rows, and empty tables give an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.contamination import LOWER, UPPER, words
from riskloom.llm.frames import counted, lean, table, written
from riskloom.llm.text import mix
from riskloom.operators.topk import top_per_group
from riskloom.session import setting

TOP_K = 10
PACK_DOCS, PACK_POSTINGS = 4_096, 1_000_000  # a pack is full at either
QUERY_TERMS = 200_000  # query terms that travel to the tasks at once
BLOCK = 64  # documents of a block on average; a list of no more is one block, bound by its own maxima
SEED_DOCS = 64  # documents of a pack that are scored per query for the first score to beat
DIMENSIONS = 32  # of the random projection
# A pack is a very long row. Spark's reader decodes the rows of a batch at once and its writer holds those of a row group,
# whose size it checks after a hundred rows unless told otherwise.
KEPT = {"parquet.block.size": 4 * 1024 * 1024, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1,
        "parquet.page.size.row.check.min": 1}
TEXT_CHUNK = 1_000_000  # bytes of a text whose terms are counted at once

# Words are runs of digits, letters and bytes beyond ASCII; A to Z are lowered and all else separates.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def term_counts(text: str | None) -> Counter:
    """How often each term occurs in a whole text."""
    data, found, at = (text or "").encode().translate(FOLD), Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + TEXT_CHUNK)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def forward_packs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` in packs: ids, sizes, and per document its terms in the pack's dictionary and their counts.

    ``held`` counts the documents that hold a dictionary term, ``some`` those that hold any, ``total`` all terms.
    """
    lean(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, ends, places, uses, place = [], [], [], [], [], {}
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = term_counts(text)
                ids.append(doc_id)
                sizes.append(found.total())
                places += [place.setdefault(term, len(place)) for term in found]
                uses += found.values()
                ends.append(len(places))
                if len(ids) >= PACK_DOCS or len(places) >= PACK_POSTINGS:
                    yield _pack(ids, id_type, sizes, ends, places, uses, place)
                    ids, sizes, ends, places, uses, place = [], [], [], [], [], {}
        if ids:
            yield _pack(ids, id_type, sizes, ends, places, uses, place)

    return docs.select("doc_id", "text").mapInArrow(
        pack, f"ids array<{kind}>, sizes array<bigint>, ends array<int>, places array<int>, uses array<bigint>, "
        "terms array<string>, held array<bigint>, some bigint, total bigint")


@contextmanager
def one_by_one(spark: SparkSession) -> Iterator[None]:
    """While plans that read packs run: one pack is decoded and travels to Python at once."""
    with (setting(spark, "spark.sql.parquet.columnarReaderBatchSize", "1"),
          setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "1")):
        yield


def _list(values, kind: pa.DataType) -> pa.Array:
    """One list as the only row of a column."""
    flat = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _pack(ids, id_type, sizes, ends, places, uses, place) -> pa.RecordBatch:
    used = np.array(places, dtype=np.int32)
    columns = {
        "ids": _list(ids, id_type), "sizes": _list(sizes, pa.int64()), "ends": _list(ends, pa.int32()),
        "places": _list(used, pa.int32()), "uses": _list(uses, pa.int64()),
        "terms": _list([term.decode() for term in place], pa.string()),
        "held": _list(np.bincount(used, minlength=len(place)), pa.int64()),
        "some": pa.array([sum(size > 0 for size in sizes)], pa.int64()), "total": pa.array([sum(sizes)], pa.int64()),
    }
    return pa.RecordBatch.from_pydict(columns)


def weighted_queries(packs: DataFrame, items: DataFrame, n_docs: int) -> DataFrame:
    """``(item_id, term, uses, held, weight)`` of ``items(item_id, text)``: the terms that occur in some document."""
    asked = items.select("item_id", F.explode(words(F.col("text"))).alias("term"))
    asked = asked.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("uses"))
    each = packs.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).select(F.col("t.terms").alias("term"),
                                                                                    F.col("t.held").alias("held"))
    each = each.join(asked.select("term").distinct(), "term", "left_semi")
    held = each.groupBy("term").agg(F.sum("held").alias("held"))
    ratio = F.lit(float(2 * n_docs + 2)) / (2 * F.col("held") + 1).cast("double")
    return asked.join(held, "term").withColumn("weight", F.floor(F.ln(ratio) * 1000.0).cast("long"))


@dataclass
class Queries:
    """A block of queries: for each its terms from the rarest on; terms are numbered."""

    items: list
    ends: np.ndarray
    terms: np.ndarray
    uses: np.ndarray
    vocabulary: dict[str, int]
    weights: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Queries:
        """From rows of ``weighted_queries``, whole queries."""
        rows = sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["held"], r["term"]))
        vocabulary: dict[str, int] = {}
        terms = [vocabulary.setdefault(r["term"], len(vocabulary)) for r in rows]
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        weights[terms] = [r["weight"] for r in rows]
        items = [r["item_id"] for r in rows]
        last = [k for k in range(len(rows)) if items[k: k + 1] != items[k + 1: k + 2]]
        return cls([items[k] for k in last], np.array([k + 1 for k in last], dtype=np.int64),
                   np.array(terms, dtype=np.int64), np.array([r["uses"] for r in rows], dtype=np.int64), vocabulary,
                   weights)

    def query(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        begin = self.ends[q - 1] if q else 0
        return self.terms[begin: self.ends[q]], self.uses[begin: self.ends[q]]


def _spans(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places from each begin up to its end, one stretch after another."""
    sizes = ends - begins
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(begins - first, sizes)


class Vectors:
    """The impact vectors of a pack's documents over a block's vocabulary, and its lists by term."""

    def __init__(self, begins: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        self.begins, self.terms, self.impacts = begins, terms, impacts
        rows = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        order = np.argsort(terms, kind="stable")
        self.listed = rows[order]
        self.lists = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, dtype=np.int64)
        np.maximum.at(self.most, terms, impacts)

    @classmethod
    def of_pack(cls, pack: dict, queries: Queries, n_docs: int, n_total: int) -> Vectors:
        """From a row of ``forward_packs``."""
        line = np.array([queries.vocabulary.get(term, -1) for term in pack["terms"].tolist()], dtype=np.int64)
        own = line[pack["places"]] if len(line) else np.zeros(0, dtype=np.int64)
        known = own >= 0
        ends = np.concatenate([[0], pack["ends"]])
        rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[known]
        lengths = np.array([25 + 75 * n * n_docs // max(n_total, 1) for n in pack["sizes"].tolist()], dtype=np.int64)
        terms, uses = own[known], pack["uses"][known]
        impacts = queries.weights[terms] * (1_000_000_000 * uses // (1000 * uses + 8 * lengths[rows]))
        return cls(np.searchsorted(rows, np.arange(len(ends))), terms, impacts, len(queries.weights))

    def list_of(self, term: int) -> np.ndarray:
        return self.listed[self.lists[term]: self.lists[term + 1]]

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Products of the documents' vectors, none of them empty, with a query's vector."""
        begins, ends = self.begins[docs], self.begins[docs + 1]
        at = _spans(begins, ends)
        sizes = ends - begins
        return np.add.reduceat(self.impacts[at] * wanted[self.terms[at]], np.cumsum(sizes) - sizes)

    def projected(self, signs: np.ndarray) -> np.ndarray:
        """The documents' vectors in a random projection, of length 1."""
        out = np.zeros((len(self.begins) - 1, signs.shape[1]), dtype=np.float32)
        full = np.flatnonzero(np.diff(self.begins))
        for part in np.array_split(full, max(1, len(self.terms) // 200_000)):
            if len(part):
                at = _spans(self.begins[part], self.begins[part + 1])
                sizes = self.begins[part + 1] - self.begins[part]
                out[part] = np.add.reduceat(self.impacts[at, None].astype(np.float32) * signs[self.terms[at]],
                                            np.cumsum(sizes) - sizes, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _row_arrays(row: pa.RecordBatch) -> dict:
    """The list columns of a batch of one row as arrays; ids and terms keep their Python values."""
    out = {}
    for name in row.schema.names:
        column = row.column(name)
        if pa.types.is_list(column.type):
            flat = column.flatten()
            as_array = name != "ids" and not pa.types.is_string(flat.type)
            out[name] = flat.to_numpy(zero_copy_only=False) if as_array else np.array(flat.to_pylist(), dtype=object)
    return out


def _each_row(task: Callable[[dict], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from task(_row_arrays(batch.slice(k, 1)))

    return run


def _best(docs: np.ndarray, scores: np.ndarray, ids: np.ndarray, top_k: int) -> list[int]:
    """Places of the highest scores, equal ones by id with null last."""
    places = np.arange(len(docs))
    if len(docs) > top_k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - top_k)[len(scores) - top_k])
    key = lambda k: (-scores[k], ids[docs[k]] is None, 0 if ids[docs[k]] is None else ids[docs[k]])
    return sorted(places.tolist(), key=key)[:top_k]


def first_scores(packs: DataFrame, queries: Queries, n_docs: int, n_total: int, top_k: int) -> tuple:
    """For each query a score that ``top_k`` documents reach (1 if fewer have one), and for each term its highest impact.

    Every pack scores some documents of each query's rarest lists.
    """

    def seeds(pack: dict) -> Iterator[pa.RecordBatch]:
        vectors = Vectors.of_pack(pack, queries, n_docs, n_total)
        wanted, found = np.zeros(len(queries.weights), dtype=np.int64), []
        for q in range(len(queries.items)):
            terms, uses = queries.query(q)
            docs = np.zeros(0, dtype=np.int64)
            for term in terms:
                docs = np.union1d(docs, vectors.list_of(term)[: SEED_DOCS - len(docs)])
                if len(docs) >= SEED_DOCS:
                    break
            if len(docs):
                wanted[terms] = uses
                scores = np.sort(vectors.scores(docs, wanted))[-top_k:]
                wanted[terms] = 0
                found += [(q, -1, int(score)) for score in scores if score > 0]
        some = np.flatnonzero(vectors.most)
        q, term, value = (np.array(c, dtype=np.int64) for c in (zip(*found) if found else ((), (), ())))
        yield pa.RecordBatch.from_pydict({
            "q": np.concatenate([q, np.full(len(some), -1)]), "term": np.concatenate([term, some]),
            "value": np.concatenate([value, vectors.most[some]])})

    with one_by_one(packs.sparkSession):
        rows = written(packs.mapInArrow(_each_row(seeds), "q bigint, term bigint, value bigint"), "seeds")
    best = top_per_group(rows.where("q >= 0"), "q", [F.desc("value")], top_k).where(F.col("rank") == top_k)
    beat, most = np.ones(len(queries.items), dtype=np.int64), np.zeros(len(queries.weights), dtype=np.int64)
    for row in best.collect():
        beat[row["q"]] = row["value"]
    for row in rows.where("q < 0").groupBy("term").agg(F.max("value").alias("value")).collect():
        most[row["term"]] = row["value"]
    return beat, most


def coordinates(queries: Queries, beat: np.ndarray, most: np.ndarray) -> dict[int, np.ndarray]:
    """The terms whose lists some query reaches, each with the terms that those queries ask from it on."""
    found: dict[int, list] = {}
    for q in range(len(queries.items)):
        terms, uses = queries.query(q)
        left = np.cumsum((uses * most[terms])[::-1])[::-1]
        for i in np.flatnonzero(left >= beat[q]):
            found.setdefault(int(terms[i]), []).append(terms[i:])
    return {term: np.unique(np.concatenate(parts)) for term, parts in found.items()}


INDEX_FIELDS = ("begins array<bigint>, terms array<bigint>, impacts array<bigint>, blocked array<bigint>, "
                "list_ends array<bigint>, block_ends array<bigint>, members array<bigint>, summaries array<bigint>")


def blocked_index(packs: DataFrame, queries: Queries, asked: dict[int, np.ndarray], n_docs: int,
                  n_total: int) -> DataFrame:
    """A pack's vectors, and for each list of ``asked`` with more than a block its blocks, their members and summaries.

    ``blocked`` has the terms of these lists, ``list_ends`` the blocks up to each; a summary has the coordinates of
    ``asked`` in their order.
    """
    bits = mix(np.array([zlib.crc32(term.encode()) for term in queries.vocabulary], dtype=np.uint64) + np.uint64(1))
    signs = ((bits[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1
    kind = packs.schema["ids"].dataType.simpleString()

    def build(pack: dict) -> Iterator[pa.RecordBatch]:
        vectors = Vectors.of_pack(pack, queries, n_docs, n_total)
        near = vectors.projected(signs)
        place = np.full(len(queries.weights), -1)
        blocked, list_ends, block_ends, members, summaries = [], [], [], [], []
        n_members = 0
        for term, wanted in asked.items():
            docs = vectors.list_of(term)
            if len(docs) <= BLOCK:
                continue
            centres = docs[:: BLOCK]
            nearest = np.argmax(near[docs] @ near[centres].T, axis=1)
            order = np.argsort(nearest, kind="stable")
            used, block_of = np.unique(nearest[order], return_inverse=True)
            docs = docs[order]
            at = _spans(vectors.begins[docs], vectors.begins[docs + 1])
            place[wanted] = np.arange(len(wanted))
            column = place[vectors.terms[at]]
            line = np.repeat(block_of, np.diff(vectors.begins)[docs])
            summary = np.zeros(len(used) * len(wanted), dtype=np.int64)
            inside = column >= 0
            np.maximum.at(summary, line[inside] * len(wanted) + column[inside], vectors.impacts[at][inside])
            place[wanted] = -1
            blocked.append(term)
            block_ends.append(n_members + np.searchsorted(block_of, np.arange(len(used)), "right"))
            list_ends.append(sum(map(len, block_ends)))
            members.append(docs)
            n_members += len(docs)
            summaries.append(summary)
        flat = {name: np.concatenate(parts) if parts else [] for name, parts in
                (("block_ends", block_ends), ("members", members), ("summaries", summaries))}
        columns = {"begins": vectors.begins, "terms": vectors.terms, "impacts": vectors.impacts, "blocked": blocked,
                   "list_ends": list_ends, **flat}
        ids = pa.array(pack["ids"].tolist(), id_type(kind))
        yield pa.RecordBatch.from_pydict({
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            **{name: _list(values, pa.int64()) for name, values in columns.items()}})

    return packs.mapInArrow(_each_row(build), f"ids {kind}, {INDEX_FIELDS}")


def id_type(kind: str) -> pa.DataType:
    """The Arrow type of the elements of an array column of ids."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}
    return kinds[kind.removeprefix("array<").removesuffix(">")]


def search(index: DataFrame, queries: Queries, asked: dict[int, np.ndarray], beat: np.ndarray, top_k: int) -> DataFrame:
    """``(q, doc_id, score)``: from each pack the best documents of each query that reach its score to beat."""
    kind = index.schema["ids"].dataType.simpleString().removeprefix("array<").removesuffix(">")

    def find(row: dict) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(row["begins"], row["terms"], row["impacts"], len(queries.weights))
        number = {int(term): k for k, term in enumerate(row["blocked"])}
        firsts = np.concatenate([[0], row["list_ends"]]).astype(np.int64)
        edges = np.concatenate([[0], row["block_ends"]]).astype(np.int64)
        tops = np.cumsum([0, *((firsts[k + 1] - firsts[k]) * len(asked[t]) for t, k in number.items())])
        wanted, seen = np.zeros(len(queries.weights), dtype=np.int64), np.zeros(len(row["ids"]), dtype=bool)
        out: dict[str, list] = {"q": [], "doc_id": [], "score": []}
        for q in range(len(queries.items)):
            terms, uses = queries.query(q)
            left = np.cumsum((uses * vectors.most[terms])[::-1])[::-1]
            beaten, docs, scores = beat[q], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            if not len(left) or left[0] < beaten:
                continue
            wanted[terms] = uses
            rest = wanted.copy()  # the terms from the present list on
            for i, term in enumerate(terms):
                if left[i] < beaten:
                    break
                k = number.get(int(term))
                if k is None:
                    some = vectors.list_of(term)
                else:
                    bounds = row["summaries"][tops[k]: tops[k + 1]].reshape(-1, len(asked[term])) @ rest[asked[term]]
                    blocks = firsts[k] + np.flatnonzero(bounds >= beaten)
                    some = row["members"][_spans(edges[blocks], edges[blocks + 1])]
                rest[term] = 0
                some = some[~seen[some]]
                if len(some):
                    seen[some] = True
                    docs = np.concatenate([docs, some])
                    scores = np.concatenate([scores, vectors.scores(some, wanted)])
                    if len(scores) >= top_k:
                        beaten = max(beaten, np.partition(scores, len(scores) - top_k)[len(scores) - top_k])
            seen[docs], wanted[terms] = False, 0
            enough = np.flatnonzero(scores >= beaten)
            for k in _best(docs[enough], scores[enough], row["ids"], top_k):
                out["q"].append(q)
                out["doc_id"].append(row["ids"][docs[enough][k]])
                out["score"].append(int(scores[enough][k]))
        yield pa.RecordBatch.from_pydict({
            "q": pa.array(out["q"], pa.int64()), "doc_id": pa.array(out["doc_id"], id_type(kind)),
            "score": pa.array(out["score"], pa.int64())})

    return index.mapInArrow(_each_row(find), f"q bigint, doc_id {kind}, score bigint")


def ranked(docs: DataFrame, items: DataFrame, top_k: int = TOP_K, query_terms: int = QUERY_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each of ``items(item_id, text)`` its best of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    packs = written(forward_packs(docs), "packs", KEPT)
    sums = packs.agg(F.sum("some").alias("some"), F.sum("total").alias("total")).first()
    n_docs, n_total = sums["some"] or 0, sums["total"] or 0
    with one_by_one(spark):
        asked_terms, n_rows = counted(weighted_queries(packs, items, n_docs), "queries")
    parts = max(1, -(-n_rows // query_terms))
    kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, q bigint"
    found = []
    for part in range(parts):
        rows = asked_terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        if not rows:
            continue
        queries = Queries.of(rows)
        beat, most = first_scores(packs, queries, n_docs, n_total, top_k)
        asked = coordinates(queries, beat, most)
        with one_by_one(spark):
            index = written(blocked_index(packs, queries, asked, n_docs, n_total), "blocked-index", KEPT)
        hits = top_per_group(search(index, queries, asked, beat, top_k), "q",
                             [F.desc("score"), F.asc_nulls_last("doc_id")], top_k)
        names = spark.createDataFrame([(item, q) for q, item in enumerate(queries.items)], kinds)
        with one_by_one(spark):
            found.append(written(hits.join(names, "q").select("item_id", "rank", "doc_id", "score"), "hits"))
    if not found:
        kind = f"{kinds.split(',')[0]}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint"
        return spark.createDataFrame([], kind)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item its ten best documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = {
    "op12_ranked_search": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
        sums AS (SELECT count_if(len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_total FROM docs),
        tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term),
        held AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        asked AS (
            SELECT item_id, term, count(*) AS uses
            FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight
            FROM held, sums),
        sizes AS (
            SELECT r, doc_id, 100 - 75 + ((75 * CAST(len(w) AS BIGINT) * n_docs) // n_total) AS m FROM docs, sums
            WHERE len(w) > 0),
        scored AS (
            SELECT a.item_id, t.r, s.doc_id,
                   CAST(sum(a.uses * k.weight * ((1000000000 * t.tf) // (1000 * t.tf + 8 * s.m))) AS BIGINT) AS score
            FROM asked a JOIN weights k USING (term) JOIN tf t USING (term) JOIN sizes s USING (r)
            GROUP BY a.item_id, t.r, s.doc_id)
        SELECT item_id, CAST(row_number() OVER (
                   PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) <= {TOP_K}
    """,
}
