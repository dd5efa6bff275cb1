"""Document fingerprints from the phrases of a Lempel-Ziv parse.

A text is parsed from left to right into phrases, each the shortest stretch that is not yet a phrase, so the phrase set
is what a dictionary compressor would learn from it. Texts that compress each other share phrases. The set is hashed and
kept as a signature of the minimum hash in each of ``SLOTS`` slots (the hash's last bits name the slot); the likeness of
two signatures is the share of equal slots among those that either uses. Equal texts have equal signatures, and the
likeness of two empty texts is 1.

To compare neighbours, documents are dealt into ranges of the id, each with a copy of the first document of the next
range, so a text is moved once, and a task reads its ranges in order with one document in hand. Ids that are all equal
can't be cut into ranges; such a run is one range, read as a stream.

Nulls: a null text is empty; a null id comes after all others. Rows with the same id come in order of their texts. An
empty table gives an empty result; the only document is its own neighbour.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.frames import lean, table, written
from riskloom.llm.text import BASE, blocks, mix, powers

SLOTS = 128
DIGITS = 24  # bits of a hash that a signature keeps
RANGE_ROWS, RANGES = 1_000, 1_000  # documents of a range, about, and ranges at most; a task sorts and streams its own
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def phrase_ends(text: str, begin: int, phrases: set) -> list[int]:
    """Where the phrases of ``text`` from ``begin`` on end, given the ``phrases`` before it, which are added to.

    A last stretch that is a phrase already is not closed: it adds nothing to the set, and the parse of a longer text
    goes on from the end of the last phrase.
    """
    ends, stretch = [], ""
    add, end = phrases.add, ends.append
    for at, letter in enumerate(text[begin:] if begin else text, begin + 1):
        stretch += letter
        if stretch not in phrases:
            add(stretch)
            end(at)
            stretch = ""
    return ends


class Hasher:
    """Hashes stretches of a text by their content, wherever they stand."""

    def __init__(self):
        self.up, self.down = powers(BASE, 1 << 12), powers(INVERSE, 1 << 12)

    def __call__(self, text: str, ends: np.ndarray) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        if len(codes) >= len(self.up):
            size = 1 << int(len(codes)).bit_length()
            self.up, self.down = powers(BASE, size), powers(INVERSE, size)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.up[: len(codes)], out=sums[1:])
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return mix((sums[ends] - sums[begins]) * self.down[begins] + (ends - begins).astype(np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash in each slot; the largest value marks a slot without a phrase."""
    out = np.full(SLOTS, (1 << DIGITS) - 1, dtype=np.int64)
    value = (hashes >> np.uint64(64 - DIGITS)).astype(np.int64)
    np.minimum.at(out, (hashes % np.uint64(SLOTS)).astype(np.int64), np.minimum(value, (1 << DIGITS) - 2))
    return out


def spelled(own: np.ndarray) -> str:
    """A signature as text."""
    return b64encode(own.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()).decode()


def read(text: str) -> np.ndarray:
    """The signature that was spelled."""
    parts = np.frombuffer(b64decode(text), dtype=np.uint8).reshape(-1, 3).astype(np.int64)
    return parts[:, 0] * 65536 + parts[:, 1] * 256 + parts[:, 2]


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Share of equal slots among those used by either signature."""
    used = (one != (1 << DIGITS) - 1) | (two != (1 << DIGITS) - 1)
    return float((one == two)[used].mean()) if used.any() else 1.0


def fingerprint(text: str | None) -> np.ndarray:
    """The signature of a text."""
    text = text or ""
    return signature(Hasher()(text, np.array(phrase_ends(text, 0, set()), dtype=np.int64)))


def _ranges(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with its ``range``, highest ids first, and copies of the row that follows each range."""
    ids = docs.select("doc_id")
    rows = ids.count()
    parts = min(max(1, rows // RANGE_ROWS), RANGES)
    cuts = sorted(set(ids.where("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)],
                                                                     0.2 / parts))) if parts > 1 else []
    low = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    known = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    place = F.lit(len(cuts)) - F.size(F.filter(known, lambda c: c <= low))
    dealt = docs.withColumn("range", place).withColumn("guest", F.lit(False))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.xxhash64("text").alias("sign"))
    heads = written(dealt.groupBy("range").agg(F.max(order).alias("head")), "range-heads")
    # A range's rows are followed by the head of the next range that has rows; the last one by the first one's.
    found = heads.orderBy("range").collect()
    if not found:
        return dealt
    follows = [(a["range"], b["head"]) for a, b in zip(found, found[1:] + found[:1])]
    guests = docs.sparkSession.createDataFrame(
        [(k, h["doc_id"], h["sign"]) for k, h in follows],
        f"range int, head_id {docs.schema['doc_id'].dataType.simpleString()}, head_sign long")
    same = docs["doc_id"].eqNullSafe(guests["head_id"]) & (F.xxhash64(docs["text"]) == guests["head_sign"])
    copies = docs.join(F.broadcast(guests), same).select("doc_id", "text", "range", F.lit(True).alias("guest"))
    return dealt.unionByName(copies)


def neighbours(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    ``docs(doc_id, text)`` is read in descending order of the id, an integer. The edited text of a document has its second half
    replaced with as much of the next document's beginning.
    """
    lean(docs.sparkSession)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = Hasher(), None

        def signed(text: str, ends: list[int]) -> np.ndarray:
            return signature(hasher(text, np.array(ends, dtype=np.int64)))

        def prepared(doc_id, text: str | None) -> dict:
            text = text or ""
            phrases: set = set()
            head = phrase_ends(text[: len(text) - len(text) // 2], 0, phrases)
            ends = head + phrase_ends(text, head[-1] if head else 0, set(phrases))
            return {"id": doc_id, "text": text, "head": head, "phrases": phrases, "own": signed(text, ends)}

        def row(one: dict, two: dict) -> dict:
            text, head = one["text"], one["head"]
            edited = text[: len(text) - len(text) // 2] + two["text"][: len(text) // 2]
            other = signed(edited, head + phrase_ends(edited, head[-1] if head else 0, one["phrases"]))
            return {"doc_id": one["id"], "n_chars": len(text),
                    "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                    "fingerprint": spelled(one["own"]), "edited_fingerprint": spelled(other),
                    "near_edited": likeness(one["own"], other), "near_next": likeness(one["own"], two["own"])}

        names = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()),
                           ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                           ("near_next", pa.float64())])
        for batch in blocks(batches):
            out = []
            for doc_id, text, part, guest in zip(*(batch.column(c).to_pylist()
                                                   for c in ("doc_id", "text", "range", "guest"))):
                new = (part, guest, prepared(doc_id, text))
                if held and held[0] == part and not held[1]:
                    out.append(row(held[2], new[2]))
                held = new
            yield pa.RecordBatch.from_pylist(out, schema=names)

    dealt = _ranges(docs.select(F.col("doc_id").cast("long"), "text"))
    ordered = dealt.withColumn("sign", F.xxhash64("text")).repartition("range").sortWithinPartitions(
        "range", "guest", F.desc_nulls_last("doc_id"), F.desc("sign"))
    return ordered.select("doc_id", "text", "range", "guest").mapInArrow(
        compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                  "near_edited double, near_next double")


def op8_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how like they and its neighbour are."""
    return neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
