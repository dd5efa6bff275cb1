"""An inverted index of documents in blocks, and exact top-k search by word counts.

A block holds up to ``BLOCK_DOCUMENTS`` documents: their names, and for every term its postings (document and count) and
the largest of these counts. Blocks are rows of a table, so an index is built once, kept, and read by any number of
searches; texts are not read again. Documents of similar length share a block, since a long one may use any word often: so
blocks differ in what they can reach.

A search first scores the blocks with the longest documents for every question, which gives each a score to beat. A
document can reach it only if it has enough words, since a score is at most the words of a document times the largest use
of a question word. So questions are dealt into units by the length they need, and a unit travels to the tasks once and
passes over the blocks that are long enough. The documents of a block are scored for a question only if its bound, the sum
of the largest counts of the question's words, can reach the score to beat, which rises as a task sees more blocks. A task
emits its best ``top_k`` documents per question, and those of all tasks are ranked together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.text import tokens
from riskloom.operators.topk import top_per_group
from riskloom.session import setting, staged, staged_with

BLOCK_DOCUMENTS, BLOCK_POSTINGS = 128, 64_000  # a block is full at either
SORTED_POSTINGS = 300_000  # postings of the documents that a task orders by length at once
CLASSES = 8  # of documents, or of questions, by the length they have or need, for each doubling of it
SEED_BLOCKS = 16  # blocks that are scored for the first score to beat
QUESTIONS = 20_000  # questions that are scored at once
QUESTION_WORDS = 500_000  # and about how many words they may have together
HELD = 3_000_000  # terms of questions, once per question, that travel to the tasks at once
LOOKED_UP = 16  # blocks whose terms are looked up among those of the questions at once
SCORED = 500_000  # products of question words and documents that are held at once
# A block is a long row. Spark's reader holds the rows of a row group at once, and its writer checks the size of one after
# a hundred rows unless told otherwise.
KEPT = {"parquet.block.size": 4 * 1024 * 1024, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 8,
        "parquet.page.size.row.check.min": 1}
# A search scores one block after another, so its reader decodes few at a time and few travel to Python at once.
READ_BLOCKS, READ_BYTES = "8", str(1024 * 1024)

INDEX = ("sources array<string>, terms array<string>, most array<bigint>, ends array<int>, docs array<int>, "
         "uses array<bigint>, longest bigint")
# Lower-case words of digits, a to z and underscore; all other bytes separate.
WORD_BYTES = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c == 0x5F else 0x20 for c in range(256)
)


def _list(values, kind: pa.DataType) -> pa.Array:
    flat = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _block(sources: list, names: list, docs: list) -> pa.RecordBatch:
    """One block of documents, each with its terms by number and their counts; postings in the order of the terms."""
    terms = np.concatenate([t for t, _ in docs])
    counts = np.concatenate([n for _, n in docs])
    place, number = np.unique(terms, return_inverse=True)
    order = np.argsort(number, kind="stable")
    counts, owner = counts[order], np.repeat(np.arange(len(docs)), [len(t) for t, _ in docs])[order]
    edges = np.searchsorted(number[order], np.arange(len(place) + 1))
    return pa.RecordBatch.from_pydict({
        "sources": _list(sources, pa.string()), "terms": _list([names[t].decode() for t in place], pa.string()),
        "most": _list(np.maximum.reduceat(counts, edges[:-1]) if len(place) else counts, pa.int64()),
        "ends": _list(edges[1:], pa.int32()), "docs": _list(owner, pa.int32()), "uses": _list(counts, pa.int64()),
        "longest": pa.array([max(int(n.sum()) for _, n in docs)], pa.int64()),
    })


def _blocks(sources: list, names: list, docs: list, block: int) -> Iterator[pa.RecordBatch]:
    """Documents cut into blocks from the longest on."""
    order = sorted(range(len(docs)), key=lambda d: -int(docs[d][1].sum()))
    begin, held = 0, 0
    for k, d in enumerate(order, 1):
        held += len(docs[d][0])
        if k - begin >= block or held >= BLOCK_POSTINGS or k == len(order):
            some = order[begin:k]
            yield _block([sources[d] for d in some], names, [docs[d] for d in some])
            begin, held = k, 0


def _numbered(words: list, counts: list, ends: list) -> tuple[list, list]:
    """The distinct words, and for each document its terms by number and their counts."""
    terms = pa.array(words, pa.binary()).dictionary_encode()
    numbers, uses = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.array(counts, dtype=np.int64)
    return terms.dictionary.to_pylist(), [(numbers[a:b], uses[a:b]) for a, b in zip([0, *ends], ends)]


def keyword_blocks(corpus: DataFrame, block: int = BLOCK_DOCUMENTS) -> DataFrame:
    """The blocks of ``corpus(source, text)``, one row per source, in the columns ``INDEX``.

    Documents are dealt by length, so that those of all tasks that are as long share blocks.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, words, counts, ends = [], [], [], []
        for batch in batches:
            for source, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist()):
                found = Counter((text or "").encode().translate(WORD_BYTES).split())
                words.extend(found)
                counts.extend(found.values())
                sources.append(source)
                ends.append(len(words))
                if len(words) >= SORTED_POSTINGS:
                    yield from _blocks(sources, *_numbered(words, counts, ends), block)
                    sources, words, counts, ends = [], [], [], []
        if sources:
            yield from _blocks(sources, *_numbered(words, counts, ends), block)

    # Texts are lowered as the questions are.
    texts = corpus.select("source", F.lower("text").alias("text"))
    length = F.length("text")
    dealt = texts.withColumn("class", F.floor(F.log2(F.greatest(length, F.lit(1))) * CLASSES)).hint("rebalance", "class")
    return dealt.sortWithinPartitions(F.desc(length)).select("source", "text").mapInArrow(build, INDEX)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Write an index in row groups of few blocks, so that a task which reads it holds few at a time."""
    blocks.write.options(**KEPT).parquet(path)


def index_terms(index: DataFrame) -> DataFrame:
    """``(term, documents, uses, most)``: in how many documents a term occurs, how often in all and at most in one."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1) for k in range(batch.num_rows)):
                most, ends, uses = _arrays(row, "most", "ends", "uses")
                if len(ends):  # every term has a posting
                    begins = np.append(0, ends[:-1])
                    yield pa.RecordBatch.from_pydict({
                        "term": row.column("terms").flatten(), "documents": pa.array(ends - begins, pa.int64()),
                        "uses": pa.array(np.add.reduceat(uses, begins), pa.int64()), "most": pa.array(most, pa.int64())})

    each = index.select("terms", "most", "ends", "uses").mapInArrow(
        listed, "term string, documents bigint, uses bigint, most bigint")
    return each.groupBy("term").agg(
        F.sum("documents").alias("documents"), F.sum("uses").alias("uses"), F.max("most").alias("most"))


@dataclass
class _Asked:
    """Some questions: the terms of each, numbered, and how often it uses them.

    ``low`` is the words that a document needs to reach a question's score to beat, in ascending order.
    """

    questions: np.ndarray
    begins: np.ndarray
    terms: np.ndarray
    uses: np.ndarray
    vocabulary: pa.Array
    low: np.ndarray

    @classmethod
    def of(cls, rows: list) -> _Asked:
        vocabulary: dict[str, int] = {}
        counts = [Counter(row["words"]) for row in rows]
        sizes = [len(c) for c in counts]
        return cls(np.array([row["question"] for row in rows]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
                   np.array([vocabulary.setdefault(w, len(vocabulary)) for c in counts for w in c], dtype=np.int32),
                   np.array([n for c in counts for n in c.values()], dtype=np.int32),
                   pa.array(list(vocabulary), pa.string()), np.ones(len(rows), dtype=np.int64))

    @classmethod
    def of_seeded(cls, table: pa.Table) -> _Asked:
        """From rows of ``_seeded`` in the order of ``low``."""
        terms = table.column("terms").combine_chunks()
        numbered = terms.flatten().dictionary_encode()
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        return cls(table.column("question").to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
                   numbered.indices.to_numpy(zero_copy_only=False),
                   table.column("uses").combine_chunks().flatten().to_numpy(zero_copy_only=False), numbered.dictionary,
                   table.column("low").to_numpy())

    def per_question(self, values: np.ndarray, how: np.ufunc) -> np.ndarray:
        """Values of all question terms, folded by question; every question has a term."""
        return how.reduceat(values, self.begins[:-1])


def _arrays(row: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [row.column(name).flatten().to_numpy(zero_copy_only=False) for name in names]


def _stretches(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places from each begin up to its end."""
    sizes = ends - begins
    return np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1)


class _Block:
    """A row of an index as arrays, and the numbers of its terms among those of the questions, -1 for none."""

    def __init__(self, row: pa.RecordBatch, number: np.ndarray) -> None:
        self.most, self.ends, self.docs, self.uses = _arrays(row, "most", "ends", "docs", "uses")
        self.sources = row.column("sources").flatten()
        self.longest = row.column("longest")[0].as_py()
        self.number = number

    def counts(self, own: np.ndarray) -> np.ndarray:
        """Counts by some of the terms and document; a last row is of no term."""
        rows = np.zeros((len(own) + 1, len(self.sources)), dtype=np.int64)
        begins = np.where(own > 0, self.ends[own - 1], 0)
        places = _stretches(begins, self.ends[own])
        rows[np.repeat(np.arange(len(own)), self.ends[own] - begins), self.docs[places]] = self.uses[places]
        return rows


def _looked_up(rows: list[pa.RecordBatch], terms: pa.Array, asked: _Asked) -> Iterator[_Block]:
    """Blocks with the numbers of their ``terms``, which are one after another."""
    number = pc.fill_null(pc.index_in(terms, value_set=asked.vocabulary), -1).to_numpy(zero_copy_only=False)
    begin = 0
    for row in rows:
        end = begin + pc.list_value_length(row.column("terms"))[0].as_py()
        yield _Block(row, number[begin:end])
        begin = end


def _terms(rows: list[pa.RecordBatch]) -> pa.Array:
    return pa.concat_arrays([row.column("terms").flatten() for row in rows])


def _score_block(row: pa.RecordBatch, asked: _Asked, to_beat: np.ndarray, found: list, top_k: int) -> None:
    for block in _looked_up([row], _terms([row]), asked):
        _score(block, asked, to_beat, found, top_k)


def _score(block: _Block, asked: _Asked, to_beat: np.ndarray, found: list, top_k: int, part: int = QUESTIONS) -> None:
    """Adds a block's documents to the best ``(-score, source)`` of each question and raises its score to beat."""
    own = np.flatnonzero(block.number >= 0)
    line = np.full(len(asked.vocabulary), len(own), dtype=np.int32)
    line[block.number[own]] = np.arange(len(own), dtype=np.int32)
    highest = np.append(block.most[own], 0)
    rows = None
    reached = int(np.searchsorted(asked.low, block.longest, "right"))
    for first in range(0, reached, part):
        last = min(first + part, reached)
        begins = asked.begins[first: last + 1]
        of_terms = slice(begins[0], begins[-1])
        bounds = np.add.reduceat(asked.uses[of_terms] * highest[line[asked.terms[of_terms]]], begins[:-1] - begins[0])
        alive = first + np.flatnonzero(bounds >= to_beat[first: last])
        if not len(alive):
            continue
        rows = block.counts(own) if rows is None else rows
        sizes = asked.begins[alive + 1] - asked.begins[alive]
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) * rows.shape[1] // SCORED)) + 1
        for some, own_sizes in zip(np.split(alive, cuts), np.split(sizes, cuts)):
            at = _stretches(asked.begins[some], asked.begins[some + 1])
            scores = np.add.reduceat(rows[line[asked.terms[at]]] * asked.uses[at, None], np.cumsum(own_sizes) - own_sizes,
                                     axis=0)
            for k in np.flatnonzero((scores >= to_beat[some, None]).any(axis=1)):
                q, own_scores = some[k], scores[k]
                places = np.flatnonzero(own_scores >= to_beat[q])
                if len(places) > top_k:
                    cut = np.partition(own_scores[places], len(places) - top_k)[len(places) - top_k]
                    places = places[own_scores[places] >= cut]
                hits = [(-int(own_scores[d]), block.sources[int(d)].as_py()) for d in places]
                found[q] = sorted(found[q] + hits, key=lambda hit: (hit[0], hit[1] is not None, hit[1] or ""))[:top_k]
                if len(found[q]) == top_k:
                    to_beat[q] = max(to_beat[q], -found[q][-1][0])


def _longest_blocks(index: DataFrame) -> bytes:
    """Some blocks with the longest documents, from the longest on, as a compressed Arrow stream, empty without blocks.

    A slice of an Arrow table would travel to the tasks with the buffers of the whole table.
    """
    longest = [row[0] for row in index.select("longest").orderBy(F.desc("longest")).limit(SEED_BLOCKS).collect()]
    seeds = index.where(F.col("longest") >= min(longest, default=0)).limit(SEED_BLOCKS).toArrow()
    return _packed(seeds.sort_by([("longest", "descending")]).to_batches()) if seeds.num_rows else b""


def _packed(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for row in rows:
            out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _seeded(asked: DataFrame, seeds: bytes, top_k: int, part: int) -> DataFrame:
    """``asked(q, words)`` with the counted terms of each question, a score that ``top_k`` documents are known to reach, 1
    at least, and the words that a document needs to reach it."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        rows, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for row in batch.slice(at, 500).to_pylist():
                    rows.append({"question": row["q"], "words": row["words"]})
                    held += len(row["words"])
                    if len(rows) >= part or held >= QUESTION_WORDS:
                        yield rows
                        rows, held = [], 0
        if rows:
            yield rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = list(_rows(pa.ipc.open_stream(seeds)))
        terms = _terms(blocks)
        for rows in some(batches):
            unit = _Asked.of(rows)
            beat, found = np.ones(len(rows), dtype=np.int64), [[] for _ in rows]
            for block in _looked_up(blocks, terms, unit):
                _score(block, unit, beat, found, top_k)
            ends = pa.array(unit.begins, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "question": pa.array(unit.questions, pa.int64()),
                "terms": pa.ListArray.from_arrays(ends, unit.vocabulary.take(pa.array(unit.terms))),
                "uses": pa.ListArray.from_arrays(ends, pa.array(unit.uses)), "beat": pa.array(beat, pa.int64()),
                "low": pa.array(-(-beat // unit.per_question(unit.uses, np.maximum)), pa.int64())})

    return asked.select("q", "words").mapInArrow(
        task, "question bigint, terms array<string>, uses array<int>, beat bigint, low bigint")


def _units(seeded: DataFrame) -> list[DataFrame]:
    """Questions in units of about ``HELD`` terms, by the words that a document needs for them."""
    size = F.floor(F.log2("low") * CLASSES)
    classes = seeded.groupBy(size.alias("class")).agg(F.sum(F.size("terms")).alias("held")).orderBy(F.desc("class")).collect()
    units, some, held = [], [], 0
    for k, row in enumerate(classes):
        some.append(row["class"])
        held += row["held"]
        if k + 1 == len(classes) or held + classes[k + 1]["held"] > HELD:
            parts = -(-held // HELD)
            units += [seeded.where(size.isin(some) & (F.pmod(F.xxhash64("question"), F.lit(parts)) == n)) for n in range(parts)]
            some, held = [], 0
    return units


def _search(index: DataFrame, asked: _Asked, beat: np.ndarray, top_k: int, part: int) -> DataFrame:
    """``(q, source, score)``: the best documents of each task for every question."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_beat, found = beat.copy(), [[] for _ in asked.questions]
        rows = _rows(batches)
        while some := list(islice(rows, LOOKED_UP)):
            for block in _looked_up(some, _terms(some), asked):
                _score(block, asked, to_beat, found, top_k, part)
        hits = [(int(q), source, -score) for q, best in zip(asked.questions, found) for score, source in best]
        for at in range(0, len(hits), 50_000):
            q, source, score = zip(*hits[at: at + 50_000])
            yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int64()), "source": pa.array(source, pa.string()),
                                              "score": pa.array(score, pa.int64())})

    return index.where(F.col("longest") >= int(asked.low[0])).mapInArrow(task, "q bigint, source string, score bigint")


def search_keywords(questions: DataFrame, index: DataFrame, top_k: int = 4, part: int = QUESTIONS) -> DataFrame:
    """``(question, source, score, rank)``: per distinct question its best documents, by score and then source.

    The score counts the occurrences of each question word, once per use in the question. ``index`` is a table of
    ``keyword_blocks``; ``part`` questions are scored at once.
    """
    spark = index.sparkSession
    words = questions.select("question").distinct().select("question", tokens(F.col("question")).alias("words"))
    asked = words.where(F.size("words") > 0).withColumn("q", F.monotonically_increasing_id())
    asked, sizes = staged_with(asked, "questions", F.count(F.lit(1)).alias("rows"))
    found = spark.createDataFrame([], "q bigint, source string, score bigint")
    with _few_blocks(spark):
        seeds = _longest_blocks(index) if sizes["rows"] else b""
    if seeds:
        seeded, _ = staged_with(_seeded(asked, seeds, top_k, part), "seeded", F.count(F.lit(1)).alias("rows"))
        hits = [_hits(index, unit.toArrow().sort_by("low"), top_k, part) for unit in _units(seeded)]
        found = reduce(DataFrame.unionByName, [df for df in hits if df is not None])
    best = top_per_group(found, "q", [F.desc("score"), F.asc("source")], top_k)
    return best.join(asked.select("q", "question"), "q").select("question", "source", "score", "rank")


@contextmanager
def _few_blocks(spark: SparkSession) -> Iterator[None]:
    with (setting(spark, "spark.sql.parquet.columnarReaderBatchSize", READ_BLOCKS),
          setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", READ_BYTES)):
        yield


def _hits(index: DataFrame, unit: pa.Table, top_k: int, part: int) -> DataFrame | None:
    """What ``_search`` finds for a unit of questions, written, since the settings for blocks hold until then."""
    if not unit.num_rows:
        return None
    with _few_blocks(index.sparkSession):
        return staged(_search(index, _Asked.of_seeded(unit), unit.column("beat").to_numpy(), top_k, part), "keyword-hits")
