"""Quality by perplexity under an interpolated, modified Kneser-Ney model of the words of trusted text.

The models are of word pairs, two per language: documents fall in two halves by a checksum of their id, and one half is
scored by the model that counts all trusted documents of the other. So no model knows the texts that it scores, and the
thresholds hold for trusted and other documents alike. Continuation counts, context totals and the three discounts of
each order follow by grouping and joining the count tables on their words. Below single
words stands a spelling model, so that unseen words have a probability: Kneser-Ney of order ``ORDER`` over 32 classes of
bytes (a to z, upper case, digits, white space, stops, bytes beyond ASCII, others), even within a class.

The log probability of a text is a sum of weights of its words and pairs: what a pair adds to its unseen case, what a
word adds to its spelling, and the spellings. Documents are taken in bundles; a bundle sends each distinct word and pair
with its documents to the shard of its hash, where it meets the weights, and sums by document come back to the bundle.
Both sides of that join grow with the input, and a frequent pair is one entry per bundle. Pairs are told apart by 56 bits
of a hash. Only the spelling model, of at most 32**ORDER n-grams and 4 MB per language, is broadcast.

Disk is bounded by doing this in parts: pairs are counted and weighed in ``SLICES`` of their second word's hash, each
dropped when its weights are packed, and documents are scored in ``PASSES`` of the hash of their id, whose shuffle files go
before the next. Every pair and document is in one of them; trusted texts are joined with their labels once.

Perplexity is per byte. A document is kept when it is at most the ``QUANTILE`` of its language's trusted documents, taken
from exact counts of perplexities to three digits of the logarithm. A language without trusted documents takes the
models and the threshold of all, which are built if there is such a document; where the other half has no trusted
document, a half takes its own model.

Nulls: a null or empty text has no perplexity and is not kept. A null language counts as one without trusted documents.
Labels that are null, or for no document, are not used; several labels of a document trust it if one does. Without
trusted text there is neither perplexity nor threshold. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.frames import dropped, lean, table, written
from riskloom.llm.text import BASE, blocks, flat, mix, word_hashes, word_spans
from riskloom.session import setting

ORDER = 4
BITS = 5
SIZE = 1 << (BITS * ORDER)
QUANTILE = 0.99
HELD_LANGUAGES = 8  # count tables that a task holds at once
EVERY = ""  # the model of all languages
BUNDLE_WORDS = 3_000_000
BUNDLE_DOCS = 60_000  # places of documents in a bundle take two bytes
SLICES = 4  # a power of two
PASSES = 8
SMALL_TEXT = 16 * 1024 * 1024  # bytes of text that are taken as one slice and in one pass
PACKED_ROWS = 1_000_000  # weights that a task packs at once
SHARDS = 16
SHARD_TEXT = 256 * 1024 * 1024  # bytes of text for a shard, if that makes more than SHARDS
BEGIN, END = np.uint64(1), np.uint64(2)

CLASS = np.full(256, 31, dtype=np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = 0
CLASS[0x61:0x7B] = np.arange(1, 27)
CLASS[0x41:0x5B] = 27
CLASS[0x30:0x3A] = 28
CLASS[0x80:] = 29
CLASS[[ord(c) for c in ".,;:!?"]] = 30
EVEN = -np.log(np.bincount(CLASS, minlength=1 << BITS))  # of a byte within its class


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at every byte of the texts, and where each text begins; white space comes before it."""
    content, offsets = flat(texts)
    value = CLASS[content].astype(np.int32)
    out = value.copy()
    place = np.arange(len(content)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER):
        before = np.zeros_like(value)
        before[k:] = value[:-k] if k < len(value) else 0
        out |= np.where(place >= k, before, 0) << (BITS * k)
    return out, offsets


def gram_counts(trusted: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` of ``trusted(lang, text)``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, counts in sorted(held.items()):
                seen = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(seen), "gram": seen.astype(np.int32),
                                                  "n": counts[seen]})
            held.clear()

        for batch in blocks(batches):
            found, offsets = grams(batch.column("text"))
            names = batch.column("lang").to_pylist()
            for lang in sorted({n or EVERY for n in names}):
                if lang not in held and len(held) >= HELD_LANGUAGES:
                    yield from emit()
                own = np.repeat(np.array([(n or EVERY) == lang for n in names]), np.diff(offsets))
                seen = np.bincount(found[own], minlength=SIZE)
                held[lang] = held[lang] + seen if lang in held else seen
        yield from emit()

    counts = trusted.mapInArrow(counted, "lang string, gram int, n long")
    counts = written(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "quality-counts")
    every = counts.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(EVERY).alias("lang"), "gram", "n")
    return counts.where(F.col("lang") != EVERY).unionByName(every)


def _discount(n: str) -> Column:
    """What modified Kneser-Ney takes off a count."""
    return F.when(F.col(n) == 1, F.col("d1")).when(F.col(n) == 2, F.col("d2")).otherwise(F.col("d3"))


def smoothed(counts: DataFrame) -> list[DataFrame]:
    """``(lang, gram, p, rest)`` for every width from ``ORDER`` to 1.

    Rows with ``p`` are n-grams with their discounted share; rows with ``rest`` are contexts with the share that goes to
    the next shorter n-gram.
    """
    parts = []
    for width in range(ORDER, 0, -1):
        spread = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
        tally = counts.groupBy("lang").agg(*spread)
        y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))

        def off(k: int, y: Column = y) -> Column:
            plain = F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
            return F.when(F.col(f"n{k}") > 0, F.greatest(F.least(plain, F.lit(float(k))), F.lit(0.1))).otherwise(
                F.lit(0.5))

        tally = tally.select("lang", off(1).alias("d1"), off(2).alias("d2"), off(3).alias("d3"))
        known = counts.join(tally, "lang").withColumn("off", _discount("n"))
        known = known.withColumn("context", F.shiftright("gram", BITS))
        totals = known.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("mass"))
        totals = written(totals, f"quality-contexts-{width}")
        shares = known.join(totals, ["lang", "context"]).select(
            "lang", "gram", ((F.col("n") - F.col("off")) / F.col("total")).alias("p"),
            F.lit(None).cast("double").alias("rest"))
        rests = totals.select("lang", F.col("context").alias("gram"),
                              F.lit(None).cast("double").alias("p"), (F.col("mass") / F.col("total")).alias("rest"))
        parts.append(shares.unionByName(rests))
        lower = F.col("gram").bitwiseAND((1 << (BITS * (width - 1))) - 1)
        counts = counts.groupBy("lang", lower.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        counts = written(counts, f"quality-counts-{width - 1}")
    return parts


def dense(parts: list[DataFrame]) -> dict[str, np.ndarray]:
    """Log probability of every n-gram by language. The rows are bounded by the classes and the order."""
    models: dict[str, np.ndarray] = {}
    for k, part in enumerate(reversed(parts), 1):
        with setting(part.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            found = part.toArrow()
        every = np.arange(1 << (BITS * k))
        for name in sorted(found.column("lang").unique().to_pylist()):
            own = found.filter(pc.equal(found.column("lang"), name))
            gram, p, rest = (own.column(c).to_numpy() for c in ("gram", "p", "rest"))
            share, left = np.zeros(len(every)), np.ones(len(every) >> BITS)
            share[gram[~np.isnan(p)]] = p[~np.isnan(p)]
            left[gram[~np.isnan(rest)]] = rest[~np.isnan(rest)]
            lower = models.get(name, np.full(1, 1.0 / (1 << BITS)))
            models[name] = share + left[every >> BITS] * lower[every & (len(lower) - 1)]
    return {name: np.log(chances).astype(np.float32) for name, chances in models.items()}


def spelling(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Byte models of the trusted rows of ``docs(doc_id, lang, text)``: those that ``labels(doc_id, quality)`` call 1."""
    return dense(smoothed(gram_counts(trusted_rows(docs, labels).select("lang", "text"))))


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that a label calls good. The labels grow with the documents, so they are joined by shuffle."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(good.hint("merge"), "doc_id", "left_semi")


def spelled(content: np.ndarray, begins: np.ndarray, ends: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Log probability of the bytes of each word and of the white space that ends it."""
    sizes = ends - begins + 1
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    value = CLASS[np.append(content, np.uint8(32))[np.minimum(np.repeat(begins, sizes) + place, len(content))]]
    value = value.astype(np.int32)
    value[first + sizes - 1] = 0
    found = value.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(value)
        before[k:] = value[:-k]
        found |= np.where(place >= k, before, 0) << (BITS * k)
    return np.add.reduceat(chances[found].astype(np.float64) + np.where(value == 0, 0.0, EVEN[value]), first)


def _salt(name: str) -> np.uint64:
    """Keeps the words of one model apart from those of others."""
    return mix(np.array([zlib.crc32(name.encode()) + (len(name.encode()) << 32)], dtype=np.uint64))[0]


def _marked(texts: pa.Array, salt: np.ndarray, chances: list[np.ndarray], kind: np.ndarray,
            wanted: Callable | None = None) -> tuple:
    """Words of non-empty texts between marks of begin and end: their hashes, text, and spelling (marks included).

    Only ``wanted`` words are spelled.
    """
    content, offsets = flat(texts)
    begins, ends, first = word_spans(content, offsets)
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes + 2)
    at = np.arange(len(begins)) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1
    words = np.empty(len(text), dtype=np.uint64)
    stop = np.cumsum(sizes + 2) - 1
    words[stop], words[stop - sizes - 1] = END, BEGIN
    words[at] = word_hashes(content, begins, ends)
    words = mix(words ^ salt[text])
    spans = np.zeros((2, len(text)), dtype=np.int64)
    spans[0, at], spans[1, at] = begins, ends
    # each different word is spelled once
    _, some, every = np.unique(words, return_index=True, return_inverse=True)
    worth = np.zeros(len(some))
    for k in np.unique(kind):
        own = np.flatnonzero((kind[text[some]] == k) & (wanted(words[some]) if wanted else True))
        if len(own):
            worth[own] = spelled(content, spans[0, some[own]], spans[1, some[own]], chances[k])
    worth = worth[every]
    worth[stop - sizes - 1] = 0.0
    return words, text, worth, stop


def pair_counts(trusted: DataFrame, names: list[str], spell: dict[str, np.ndarray], slices: int) -> list[DataFrame]:
    """``(model, v, w, n, spell)``: pairs with their counts, and every word once with its spelling, ``v`` 0 and no count.

    A table for each of the ``slices`` of ``w``.
    ``model`` is the place in ``names``, which are the half and the language; the models of all languages count every
    text of ``trusted(lang, half, text)``.
    """
    shared = trusted.sparkSession.sparkContext.broadcast(spell)
    place, salts = {n: k for k, n in enumerate(names)}, np.array([_salt(n) for n in names], dtype=np.uint64)

    def counted(only: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chances = [shared.value[n[1:]] for n in names]
        held: list = []

        def wanted(words: np.ndarray) -> np.ndarray:
            return words % np.uint64(slices) == only

        def emit() -> Iterator[pa.RecordBatch]:
            model, v, w, n, worth = (np.concatenate(c) for c in zip(*held))
            held.clear()
            if not len(model):
                return
            order = np.lexsort((w, v, model))
            model, v, w, n, worth = (c[order] for c in (model, v, w, n, worth))
            new = np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (model[1:] != model[:-1]))
            at = np.flatnonzero(new)
            n = np.add.reduceat(n, at)
            for k in range(0, len(at), 200_000):
                own = at[k: k + 200_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(model[own], pa.int32()), pa.array(v[own].view(np.int64)),
                     pa.array(w[own].view(np.int64)), pa.array(n[k: k + 200_000]),
                     pa.array(worth[own], pa.float64(), from_pandas=True)], names=["model", "v", "w", "n", "spell"])

        size = 0
        for batch in blocks(batches):
            full = batch.filter(pc.greater(pc.fill_null(pc.binary_length(batch.column("text")), 0), 0))
            found = list(zip(full.column("half").to_pylist(), full.column("lang").to_pylist()))
            for kind in ([place[f"{h}{n}"] if n else -1 for h, n in found], [place.get(f"{h}", -1) for h, _ in found]):
                kind = np.array(kind, dtype=np.int64)
                rows = np.flatnonzero(kind >= 0)
                if not len(rows):
                    continue
                words, text, worth, stop = _marked(full.column("text").take(pa.array(rows)), salts[kind[rows]],
                                                   chances, kind[rows], wanted)
                model = kind[rows][text].astype(np.int32)
                inner = np.ones(len(words), dtype=bool)
                inner[stop] = False
                left = np.flatnonzero(inner)
                left = left[wanted(words[left + 1])]
                held.append((model[left], words[left], words[left + 1], np.ones(len(left), np.int64),
                             np.full(len(left), np.nan)))
                own = np.flatnonzero(wanted(words))
                some = own[np.unique(words[own], return_index=True)[1]]
                held.append((model[some], np.zeros(len(some), np.uint64), words[some],
                             np.zeros(len(some), np.int64), worth[some]))
                size += len(left)
            if size > BUNDLE_WORDS:
                yield from emit()
                size = 0
        if held:
            yield from emit()

    tables = []
    for only in range(slices):
        counts = trusted.mapInArrow(partial(counted, only), "model int, v long, w long, n long, spell double")
        counts = counts.groupBy("model", "v", "w").agg(F.sum("n").alias("n"), F.max("spell").alias("spell"))
        # equal words side by side take little room
        with setting(trusted.sparkSession, "spark.sql.parquet.compression.codec", "zstd"):
            tables.append(written(counts.sortWithinPartitions("v", "w"), "quality-pairs"))
    return tables


def _discounts(counts: DataFrame) -> DataFrame:
    """``(model, d1, d2, d3)`` of ``counts(model, n)``."""
    spread = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))

    def off(k: int) -> Column:
        plain = F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        return F.when(F.col(f"n{k}") > 0, F.greatest(F.least(plain, F.lit(float(k))), F.lit(0.1))).otherwise(F.lit(0.5))

    return counts.groupBy("model").agg(*spread).select("model", *[off(k).alias(f"d{k}") for k in (1, 2, 3)])


def weights(slices: list[DataFrame], shards: int) -> tuple[DataFrame, dict[int, float]]:
    """``packed`` weights of the pairs and words of ``slices``, which are dropped; and per model the log share that is left
    to spelling."""
    counts = reduce(DataFrame.unionByName, slices)
    pairs = counts.where("n > 0").select("model", "v", "w", "n")
    discounts = written(_discounts(pairs), "quality-discounts")

    def off(pairs: DataFrame) -> DataFrame:
        return pairs.join(F.broadcast(discounts), "model").withColumn("off", _discount("n"))

    known = off(pairs)
    contexts = known.groupBy("model", "v").agg(F.sum("n").alias("total"), F.sum("off").alias("mass"))
    contexts = written(contexts, "quality-word-contexts")
    kinds = written(pairs.groupBy("model", "w").agg(F.count(F.lit(1)).alias("n")), "quality-word-kinds")
    single = kinds.join(F.broadcast(_discounts(kinds)), "model").withColumn("off", _discount("n"))
    whole = written(single.groupBy("model").agg(F.sum("n").alias("all"), F.sum("off").alias("lost")), "quality-whole")
    left = {r["model"]: float(np.log(r["lost"] / r["all"])) for r in whole.collect()}
    spells = counts.where("v = 0").select("model", "w", "spell")
    words = spells.join(single, ["model", "w"], "left").join(F.broadcast(whole), "model")
    words = words.join(contexts.select("model", F.col("v").alias("w"), (F.col("mass") / F.col("total")).alias("rest")),
                       ["model", "w"], "left")
    low = F.log(F.col("lost") / F.col("all")) + F.col("spell")
    chance = (F.col("n") - F.col("off")) / F.col("all") + F.exp(low)
    words = written(words.select("model", "w", chance.alias("p"), F.coalesce("rest", F.lit(1.0)).alias("rest"),
                                 low.alias("low")), "quality-words")
    dropped(kinds)
    one = words.select(F.lit(0).cast("long").alias("v"), "w", (
        F.log("rest") + F.coalesce(F.log("p") - F.col("low"), F.lit(0.0))).alias("weight"))
    rests = contexts.select("model", "v", "total", (F.col("mass") / F.col("total")).alias("rest"))
    parts = [written(packed(one, shards), "quality-weights")]
    for k, counts in enumerate(slices):
        known = off(counts.where("n > 0").select("model", "v", "w", "n"))
        known = known.select("model", "v", "w", (F.col("n") - F.col("off")).alias("kept"))
        shares = known.join(rests, ["model", "v"]).select(
            "model", "v", "w", (F.col("kept") / F.col("total") / F.col("rest")).alias("share"))
        own = words.where(F.pmod("w", F.lit(len(slices))) == k).select("model", "w", "p")
        two = shares.join(own, ["model", "w"]).select("v", "w", F.log1p(F.col("share") / F.col("p")).alias("weight"))
        parts.append(written(packed(two, shards), "quality-weights"))
        dropped(counts)
    dropped(contexts, words)
    return reduce(DataFrame.unionByName, parts), left


def _keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """56 bits for a pair, or for a word if ``v`` is 0."""
    return mix(v * BASE + w) >> np.uint64(8)


def _packed(values: np.ndarray) -> bytes:
    """Values by byte planes, compressed."""
    data = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, kind)
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def packed(learned: DataFrame, shards: int) -> DataFrame:
    """``(shard, keys, weights)`` of ``learned(v, w, weight)``, weights in four bytes."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def emit() -> Iterator[pa.RecordBatch]:
            key, weight = (np.concatenate(c) for c in zip(*held))
            held.clear()
            shard = (key % np.uint64(shards)).astype(np.int64)
            for k in np.unique(shard):
                own = np.flatnonzero(shard == k)
                own = own[np.argsort(key[own])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([_packed(np.diff(key[own], prepend=np.uint64(0)))], pa.binary()),
                     pa.array([_packed(weight[own])], pa.binary())], names=["shard", "keys", "weights"])

        size = 0
        for batch in batches:
            v, w = (batch.column(c).to_numpy().view(np.uint64) for c in ("v", "w"))
            held.append((_keys(v, w), batch.column("weight").to_numpy().astype(np.float32)))
            size += len(v)
            if size >= PACKED_ROWS:
                yield from emit()
                size = 0
        if size:
            yield from emit()

    return learned.mapInArrow(dealt, "shard int, keys binary, weights binary")


def perplexity(docs: DataFrame, names: list[str], spell: dict[str, np.ndarray], learned: DataFrame,
               left: dict[int, float], shards: int, passes: int) -> DataFrame:
    """``(doc_id, lang, perplexity)`` of ``docs(doc_id, lang, text)``, with ``learned`` weights as ``packed``."""
    shared = docs.sparkSession.sparkContext.broadcast(spell)
    place, salts = {n: k for k, n in enumerate(names)}, np.array([_salt(n) for n in names], dtype=np.uint64)
    rest = np.array([left[k] for k in range(len(names))])
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()

    def model_of(half: int, lang: str | None) -> int:
        options = (f"{1 - half}{lang or EVERY}", f"{half}{lang or EVERY}", f"{1 - half}", f"{half}")
        return next((place[x] for x in options if x in place), -1)

    def asked(turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chances = [shared.value[n[1:]] for n in names]
        keys, at, rows, count, words_held, part = [], [], [], 0, 0, 0

        def emit() -> Iterator[pa.RecordBatch]:
            bundle = f"{turn}-{TaskContext.get().partitionId()}-{part}"
            table_ = pa.Table.from_batches(rows).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table_.schema) as out:
                out.write_table(table_)
            yield row(zlib.crc32(bundle.encode()) % shards, bundle, None, None, None, sink.getvalue().to_pybytes())
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            doc = np.concatenate(at) if at else np.zeros(0, np.uint16)
            shard = (key % np.uint64(shards)).astype(np.int64)
            for k in range(shards):
                own = np.flatnonzero(shard == k)
                if len(own):
                    own = own[np.argsort(key[own], kind="stable")]
                    sorted_ = key[own]
                    begin = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
                    yield row(k, bundle, _packed(np.diff(sorted_[begin], prepend=np.uint64(0))),
                              _packed(np.diff(begin, append=len(own)).astype(np.uint32)), _packed(doc[own]), None)

        def row(*values) -> pa.RecordBatch:
            types = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)],
                                              names=["shard", "bundle", "keys", "uses", "docs", "rows"])

        for batch in blocks(batches):
            for cut in range(0, batch.num_rows, BUNDLE_DOCS):
                some = batch.slice(cut, BUNDLE_DOCS)
                if rows and (words_held > BUNDLE_WORDS or count + some.num_rows > BUNDLE_DOCS):
                    yield from emit()
                    keys, at, rows, count, words_held, part = [], [], [], 0, 0, part + 1
                size = pc.fill_null(pc.binary_length(some.column("text")), 0).to_numpy(zero_copy_only=False)
                kind = np.array([model_of(h, n) for h, n in zip(some.column("half").to_pylist(),
                                                                some.column("lang").to_pylist())], dtype=np.int64)
                own = np.flatnonzero((size > 0) & (kind >= 0))
                low = np.full(some.num_rows, np.nan)
                if len(own):
                    words, text, worth, stop = _marked(some.column("text").take(pa.array(own)), salts[kind[own]],
                                                       chances, kind[own])
                    low[own] = np.bincount(text, worth) + (np.bincount(text) - 1) * rest[kind[own]]
                    inner = np.ones(len(words), dtype=bool)
                    inner[stop] = False
                    pair = np.flatnonzero(inner)
                    keys += [_keys(np.zeros(len(words), np.uint64), words), _keys(words[pair], words[pair + 1])]
                    doc = (own[text] + count).astype(np.uint16)
                    at += [doc, doc[pair]]
                    words_held += len(words)
                rows.append(pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("lang"), pa.array(low), pa.array(size)],
                    names=["doc_id", "lang", "low", "size"]))
                count += some.num_rows
        if rows:
            yield from emit()

    def met(questions: pa.Table, answers: pa.Table) -> pa.Table:
        key = [np.cumsum(_unpacked(k, np.uint64), dtype=np.uint64) for k in answers.column("keys").to_pylist()]
        key = np.append(np.concatenate(key or [np.zeros(0, np.uint64)]), np.uint64(1 << 63))
        weight = [_unpacked(x, np.float32) for x in answers.column("weights").to_pylist()]
        weight = np.append(np.concatenate(weight or [np.zeros(0, np.float32)]), np.float32(0))
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        sums, whole = [], questions.column("rows").to_pylist()
        for k, listed in enumerate(whole):
            if listed is not None:
                sums.append(None)
                continue
            own, uses, doc = (_unpacked(questions.column(c)[k].as_py(), t) for c, t in (
                ("keys", np.uint64), ("uses", np.uint32), ("docs", np.uint16)))
            own = np.cumsum(own, dtype=np.uint64)
            place_ = np.searchsorted(key, own)
            gain = np.where(key[place_] == own, weight[place_], 0).astype(np.float64)
            sums.append(_packed(np.bincount(doc, np.repeat(gain, uses)).astype(np.float64)))
        return pa.Table.from_arrays([questions.column("bundle").cast(pa.string()), pa.array(sums, pa.binary()),
                                     pa.array(whole, pa.binary())], names=["bundle", "sums", "rows"])

    def summed(parts: pa.Table) -> pa.Table:
        listed = next(x for x in parts.column("rows").to_pylist() if x is not None)
        rows = pa.ipc.open_stream(listed).read_all()
        total, size = rows.column("low").to_numpy().copy(), rows.column("size").to_numpy()
        for x in sorted(x for x in parts.column("sums").to_pylist() if x is not None):
            found = _unpacked(x, np.float64)
            total[: len(found)] += found
        value = np.exp(np.minimum(-total / np.maximum(size, 1), 700.0))
        return pa.Table.from_arrays(
            [rows.column("doc_id"), rows.column("lang"), pa.array(value, pa.float64(), from_pandas=True)],
            names=["doc_id", "lang", "perplexity"])

    sums = []
    for turn in range(passes):
        own = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == turn).select("doc_id", "lang", half(), "text")
        questions = own.mapInArrow(
            partial(asked, turn), "shard int, bundle string, keys binary, uses binary, docs binary, rows binary")
        found = questions.groupBy("shard").cogroup(learned.groupBy("shard")).applyInArrow(
            met, "bundle string, sums binary, rows binary")
        sums.append(written(found, "quality-sums"))
    dropped(learned)
    return reduce(DataFrame.unionByName, sums).groupBy("bundle").applyInArrow(
        summed, f"doc_id {kind_of_id}, lang string, perplexity double")


def half() -> Column:
    """The half that a document belongs to."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2, F.lit(0)).cast("int").alias("half")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, lang, perplexity)`` of ``docs(doc_id, lang, text)`` under the models of its trusted rows."""
    trusted = written(trusted_rows(docs, labels).select("lang", half(), "text"), "quality-trusted")
    spell = dense(smoothed(gram_counts(trusted.select("lang", "text"))))
    if not spell:
        return docs.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"))
    text = docs.where(F.octet_length("text") > 0).select("lang")
    seen = trusted.where(F.octet_length("text") > 0).select("half", "lang").distinct().collect()
    seen = [(r["half"], r["lang"]) for r in seen]
    own = sorted({n for _, n in seen if n})
    others = text.where(~F.coalesce(F.col("lang").isin(own), F.lit(False)))
    names = sorted({f"{h}{n}" for h, n in seen if n}) + [f"{h}" for h in sorted({h for h, _ in seen})
                                                        if not others.isEmpty()]
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(SHARDS, -(-size // SHARD_TEXT))
    slices, passes = (SLICES, PASSES) if size > SMALL_TEXT else (1, 1)
    slices = pair_counts(trusted, names, spell, slices)
    dropped(trusted)
    learned, left = weights(slices, shards)
    return perplexity(docs, names, spell, learned, left, shards, passes)


def thresholds(scores: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``(lang, threshold)``: the quantile of ``scores(lang, perplexity)`` per language and of all (``EVERY``)."""
    step = F.ceil(F.log("perplexity") * 1000).cast("long")
    counts = scores.where("perplexity is not null").groupBy("lang", step.alias("step")).agg(
        F.count(F.lit(1)).alias("n"))
    every = counts.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(EVERY).alias("lang"), "step", "n")
    counts = counts.where("lang is not null").unionByName(every)
    upward = Window.partitionBy("lang").orderBy("step")
    placed = counts.select("lang", "step", F.sum("n").over(upward).alias("upto"),
                           F.sum("n").over(Window.partitionBy("lang")).alias("total"))
    reached = placed.where(F.col("upto") >= F.col("total") * quantile)
    return reached.groupBy("lang").agg(F.exp(F.min("step") / 1000).alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``(doc_id, lang, perplexity, threshold, keep)`` of every row of ``docs(doc_id, lang, text)``."""
    lean(docs.sparkSession)
    scores = written(scored(docs, labels), "quality-scores")
    limits = written(thresholds(trusted_rows(scores, labels), quantile), "quality-limits")
    own = limits.where(F.col("lang") != EVERY).withColumnRenamed("lang", "own_lang")
    every = limits.where(F.col("lang") == EVERY).select(F.col("threshold").alias("every")).groupBy().agg(
        F.max("every").alias("every"))
    every = every.first()["every"]
    met = scores.join(own, F.col("lang") == F.col("own_lang"), "left")
    limit = F.coalesce("threshold", F.lit(every).cast("double"))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return met.select("doc_id", "lang", "perplexity", limit.alias("threshold"), keep.alias("keep"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether it is kept, by the documents that ``labels.quality`` calls 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
