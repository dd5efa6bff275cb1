"""Substring deduplication by seed and extend on winnowed anchors.

A repeat is a run of at least ``WINDOW`` words that also stands in a document with a smaller id. Seeds are found by
winnowing: of the word groups of ``SEED`` words in every window of ``WINDOW`` words, the one with the smallest hash is
the window's anchor, so equal windows have the same anchor at the same place. An anchor stands for the run of
consecutive windows that chose it.

1. Anchors that occur in one document only are dropped; the minimum and maximum id of each are taken before the shuffle.
2. Each occurrence of a shared anchor is extended both ways over all its windows. Occurrences with equal extensions
   repeat each other in full: all but those of the smallest id are repeats.
3. Where an anchor has several extensions, matches end somewhere inside. There the smallest occurrence of each extension
   is compared window by window: the smallest id of each window decides.
4. Matches that overlap are joined to maximal repeats, and their words are removed.

Every step works on minima by key, never on pairs, so a passage that a third of all documents share costs each document
its own rows only; joins on a key have two written sides, which Spark splits where they are skewed. Texts are moved
twice, by document. Windows are compared by 128 bits of hash over 64-bit word hashes.

Nulls: a null text has no words; a document without an id is neither shortened nor a reason to shorten another. Rows
that share an id never shorten each other. Repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.frames import lean, table, written
from riskloom.llm.text import BASE, blocks, hashed, mix

WINDOW = 13
SEED = 5
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hash of the ``size`` words from every word on; meaningless near the end."""
    value = words.copy()
    for k in range(1, size):
        value[:-k] = value[:-k] * base + words[k:] if k < len(words) else value[:-k]
    return mix(value)


def _left(first: np.ndarray) -> np.ndarray:
    """Words from each word to the end of its text."""
    counts = np.diff(first)
    return np.repeat(first[1:], counts) - np.arange(int(first[-1]))


def anchors(words: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple:
    """``(anchor, text, begin, n, extension)`` of every anchor: its hash, the text it is in, the place of its first
    window there, how many windows chose it, and the hash of them all."""
    starts = np.flatnonzero(_left(first) >= window)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    grams = _grams(words, seed, BASE)
    best, place = grams[starts], np.zeros(len(starts), dtype=np.int64)
    for k in range(1, window - seed + 1):
        other = grams[starts + k]
        less = other < best
        best = np.where(less, other, best)
        place[less] = k
    place += starts
    text = np.searchsorted(first, starts, "right") - 1
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(fresh)
    n = np.diff(np.append(head, len(starts)))
    whole = _grams(words, window, SECOND)[starts]
    turn = np.arange(len(starts)) - np.repeat(head, n)
    extension = mix(np.add.reduceat(mix(whole + turn.astype(np.uint64)), head) + n.astype(np.uint64))
    # The anchor's place within the first window is part of what equal extensions share.
    extension = mix(extension ^ (place[head] - starts[head]).astype(np.uint64))
    return best[head], text[head], starts[head] - first[text[head]], n, extension


def _signed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.hash("text").alias("sign"), "text")


def _seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """``(anchor, doc_id)`` of every anchor."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            anchor, text, *_ = anchors(*hashed(batch.column("text")), window, seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), batch.column("doc_id").take(pa.array(text))], names=["anchor", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(found, f"anchor long, doc_id {kind}")


def _extended(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """``(anchor, extension, doc_id, sign, run)``: every anchor with its windows, ``run`` = first * 256 + number."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            anchor, text, begin, n, extension = anchors(*hashed(batch.column("text")), window, seed)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(extension.view(np.int64)),
                 batch.column("doc_id").take(at), batch.column("sign").take(at), pa.array(begin * 256 + n)],
                names=["anchor", "extension", "doc_id", "sign", "run"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(found, f"anchor long, extension long, doc_id {kind}, sign int, run long")


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window and number of windows of every run in a column of run lists."""
    lists = column.to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(x) if x else 0 for x in lists])
    run = np.array([r for x in lists for r in (x or ())], dtype=np.int64)
    return row, run // 256, run % 256


def _windows(spots: DataFrame, window: int) -> DataFrame:
    """``(high, low, doc_id, sign, run)``: every window of the runs of ``spots(doc_id, sign, text, runs)``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words, first = hashed(batch.column("text"))
            row, begin, n = _runs(batch.column("runs"))
            turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            row, begin = np.repeat(row, n), np.repeat(begin, n) + turn
            at = first[row] + begin
            high, low = _grams(words, window, BASE)[at], _grams(words, window, SECOND)[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)),
                 batch.column("doc_id").take(pa.array(row)), batch.column("sign").take(pa.array(row)),
                 pa.array(begin * 256 + 1)], names=["high", "low", "doc_id", "sign", "run"])

    kind = spots.schema["doc_id"].dataType.simpleString()
    return spots.mapInArrow(found, f"high long, low long, doc_id {kind}, sign int, run long")


def _per_document(runs: DataFrame) -> DataFrame:
    grouped = runs.groupBy("doc_id", "sign").agg(F.collect_list("run").alias("runs"))
    return grouped.select(F.col("doc_id").alias("run_id"), F.col("sign").alias("run_sign"), "runs")


def _with_text(docs: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    same = docs["doc_id"].eqNullSafe(runs["run_id"]) & (docs["sign"] == runs["run_sign"])
    return docs.join(runs, same, how).select("doc_id", "sign", "text", "runs")


def repeats(documents: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``(doc_id, sign, run)``: the windows of ``documents(doc_id, text)`` that stand in a smaller document."""
    docs = _signed(documents).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    seen = _seeds(docs.select("doc_id", "text"), window, seed).groupBy("anchor").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = written(seen.where("low < high").select("anchor"), "anchors-shared")
    hits = written(_extended(docs, window, seed).join(shared, "anchor"), "anchors-extended")
    classes = hits.groupBy("anchor", "extension").agg(F.min("doc_id").alias("least"))
    classes = written(classes, "extensions")
    mixed = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "anchor", F.lit(True).alias("mixed"))
    classes = written(classes.join(mixed, "anchor", "left"), "extensions-marked")
    judged = hits.join(classes, ["anchor", "extension"])
    judged = written(judged.select("doc_id", "sign", "run", "least", "mixed").where("doc_id > least or mixed"),
                     "anchors-judged")
    full = judged.where("doc_id > least").select("doc_id", "sign", "run")
    # Extensions that differ: the smallest document of each, window by window.
    edges = written(_per_document(judged.where("doc_id = least and mixed")), "anchors-mixed")
    rows = written(_windows(_with_text(docs, edges, "inner"), window), "windows")
    least = rows.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = written(least.where("least < most").select("high", "low", "least"), "windows-least")
    partial = rows.join(least, ["high", "low"]).where("doc_id > least").select("doc_id", "sign", "run")
    return full.unionByName(partial)


def without_repeats(documents: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept, repeats)``, one row per row of ``documents(doc_id, text)``.

    ``kept`` are the words that stay, joined by one space; ``repeats`` the maximal repeats as word intervals.
    """
    lean(documents.sparkSession)
    runs = written(_per_document(repeats(documents, window, seed)), "repeat-runs")
    met = _with_text(_signed(documents), runs, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in blocks(batches):
            total, removed, digests, kept, spans = [], [], [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = text.encode("utf-8").split() if text else []
                total.append(len(words))
                found = []
                if own:
                    run = np.array(own, dtype=np.int64)
                    edge = np.bincount(run // 256, minlength=len(words) + 1)[: len(words) + 1]
                    edge = edge - np.bincount(run // 256 + run % 256 - 1 + window, minlength=len(words) + 1)
                    change = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]])))
                    found = change.reshape(-1, 2).tolist()
                stay, done = [], 0
                for first, last in found:
                    stay += words[done:first]
                    done = last
                text = b" ".join(stay + words[done:])
                removed.append(sum(last - first for first, last in found))
                spans.append([{"first": first, "last": last} for first, last in found])
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(kept, pa.string()), pa.array(spans, kind)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "repeats"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept string, "
                               "repeats array<struct<first:bigint,last:bigint>>")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stay after its repeats are removed: counts and digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = {
    "op1_substring_dedup": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        windows AS (
            SELECT r, doc_id, i, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS s
            FROM (SELECT *, unnest(range(len(w) - {WINDOW} + 1)) AS i FROM docs WHERE len(w) >= {WINDOW})),
        least AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s HAVING count(*) > 1),
        gone AS (
            SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS spot
            FROM windows JOIN least USING (s) WHERE doc_id > least),
        spots AS (SELECT r, list(spot) AS spots FROM gone GROUP BY r),
        stays AS (
            SELECT d.r, string_agg(d.word, ' ' ORDER BY d.i) AS kept
            FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs) d
            LEFT JOIN gone g ON g.r = d.r AND g.spot = d.i WHERE g.r IS NULL GROUP BY d.r)
        SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(spots), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM docs LEFT JOIN spots USING (r) LEFT JOIN stays USING (r)
    """,
}
