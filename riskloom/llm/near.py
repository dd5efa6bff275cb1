"""Near-duplicate groups by SetSketch registers.

A document's set has its distinct word shingles. Register i of its sketch is the smallest of exponentially distributed
hashes of the set's members, on a logarithmic scale of base ``SCALE``, cut to 16 bits: registers of a union are the
larger ones of its parts, and two sets agree in a register with a probability close to their Jaccard similarity.

Documents of equal sets form a class, which is linked as a whole. Classes that agree in all registers of one of ``BANDS``
bands share a bucket; at similarity 0.8 a pair misses all of them with probability 1.4e-7. Within a bucket, pairs are
not enumerated: the first member is a pivot, which is compared with all members, and members that thereby come into one
component need no link of their own. Members of buckets that still hold several components, such as texts with a
frequent passage in common or the many copies of one text that differ here and there, are dealt into new buckets by the
rare differences from their pivot that linked sets must share, and pivots are taken there, those of small components
first and ``PIVOTS`` times as many each round, until every pair of a bucket is compared or lies in one component. A pair's
similarity is estimated from both sketches by the likelihood of its larger, smaller and equal registers; pairs that it
leaves possible are confirmed on the full sets.

No bucket, class or component is gathered: classes and components are minima taken before the shuffle, pivots are the
first rows of a bucket and are cut in every task, and joins on a bucket, class or text have two written sides, which
Spark splits where they are skewed. Tables of ids and labels of at most ``PART_ROWS`` rows, whatever the number of shuffle
partitions, are read as one part and so are joined and grouped without a shuffle.

Nulls: a null text is empty. A document without words is linked with nothing. A null id is linked with nothing, has a
null component and is kept. Rows that share an id are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.frames import counted, lean, table, written
from riskloom.llm.text import blocks, hashed, mix

SHINGLE = 2  # words; the pipeline takes 5
SIMILARITY = 80  # percent
BANDS, ROWS = 30, 4
SCALE = 1.001
LIMIT = 2**16 - 1
RATE = 20.0
DOUBT = 30.0  # twice the log-likelihood by which a pair may fall short of the threshold and still be confirmed
GRID = 200
PART_ROWS = 200_000  # ids, of a few bytes each, that one task joins and groups sooner than a shuffle is dealt out
PIVOTS = 16  # of a dealt bucket, and by how much they grow each round
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin (with the end)."""
    words, first = hashed(texts, lower=True)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(first[1:], counts) - np.arange(len(words))  # words from here to the end of the text
    value = words.copy()
    for k in range(1, size):
        step = np.zeros_like(words)
        if k < len(words):
            step[:-k] = words[k:]
        inside = left > k
        value = np.where(inside, mix(value + np.uint64(k)) + step, value)
    # A whole shingle begins here, or the text is shorter than one and begins here.
    begins = (left >= size) | ((np.repeat(counts, counts) < size) & (left == np.repeat(counts, counts)))
    value, owner = mix(value[begins]), owner[begins]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def registers(smallest: np.ndarray) -> np.ndarray:
    """Registers of the smallest uniform hashes: the exponential quantile, on the logarithmic scale."""
    uniform = (smallest.astype(np.float64) + 0.5) / 2.0**64
    waiting = -np.log1p(-np.minimum(uniform, 1.0 - 2.0**-53)) / RATE
    return np.clip(np.floor(1.0 - np.log(waiting) / np.log(SCALE)), 0, LIMIT).astype(np.uint16)


def sketch(documents: DataFrame, size: int) -> DataFrame:
    """``(doc_id, sign, n, cid, registers)`` of ``documents(doc_id, sign, text)``; ``cid`` names the set."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            value, first = shingle_sets(batch.column("text"), size)
            n = np.diff(first)
            some = np.flatnonzero(n)
            starts = first[:-1][some]
            names, out = np.zeros(len(n), dtype=np.uint64), np.zeros((len(n), len(FACTORS)), dtype=np.uint16)
            if len(some):
                names[some] = mix(np.add.reduceat(mix(value ^ FACTORS[0]), starts) + n[some].astype(np.uint64))
                for k, factor in enumerate(FACTORS):
                    out[some, k] = registers(np.minimum.reduceat(value * factor, starts))
            width = len(FACTORS) * 2
            data = pa.Array.from_buffers(pa.binary(width), len(n), [None, pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sign"), pa.array(n, pa.int64()),
                 pa.array(names.view(np.int64)), data.cast(pa.binary())],
                names=["doc_id", "sign", "n", "cid", "registers"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(sketched, f"doc_id {kind}, sign long, n long, cid long, registers binary")


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint16).reshape(len(rows), -1)


def buckets(classes: DataFrame) -> DataFrame:
    """``(bucket, cid)``: a row per class and band."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch.column("registers")).reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
                value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), own.shape[:2])
                for k in range(ROWS):
                    value = mix(value * FACTORS[k] + own[:, :, k])
                names = np.repeat(batch.column("cid").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(value.ravel().view(np.int64)), pa.array(names)],
                                                 names=["bucket", "cid"])

    return classes.select("cid", "registers").mapInArrow(banded, "bucket long, cid long")


def likelihoods(more: np.ndarray, less: np.ndarray, same: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
    """The likeliest similarity of each pair, and by how much the threshold's log-likelihood falls short of it.

    ``more``, ``less`` and ``same`` count the registers of the first set that are larger, smaller and equal; ``a`` and
    ``b`` are the sizes of the sets.
    """
    u, v = a / (a + b), b / (a + b)
    top = np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (SCALE - 1.0) / SCALE) / np.log(SCALE)

    def logs(similarity: np.ndarray) -> np.ndarray:
        above = np.clip(chance(u[:, None] - v[:, None] * similarity), 1e-12, 1.0)
        below = np.clip(chance(v[:, None] - u[:, None] * similarity), 1e-12, 1.0)
        equal = np.clip(1.0 - above - below, 1e-12, 1.0)
        return more[:, None] * np.log(above) + less[:, None] * np.log(below) + same[:, None] * np.log(equal)

    grid = top[:, None] * (np.arange(GRID + 1) / GRID)
    found = logs(grid)
    best = found.argmax(axis=1)
    at = np.minimum(SIMILARITY / 100, top)[:, None]
    return grid[np.arange(len(best)), best], found.max(axis=1) - logs(at)[:, 0]


def plausible(pairs: DataFrame) -> DataFrame:
    """The ``pairs(a, b, n_a, n_b, sketch_a, sketch_b)`` whose sketches leave the threshold possible, as ``(a, b)``."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                x, y = _matrix(part.column("sketch_a")), _matrix(part.column("sketch_b"))
                a, b = (part.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                estimate, short = likelihoods((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), a, b)
                keep = pa.array((estimate >= SIMILARITY / 100) | (2.0 * short <= DOUBT))
                yield part.select(["a", "b"]).filter(keep)

    return pairs.mapInArrow(judged, "a long, b long")


def confirmed(pairs: DataFrame, size: int) -> DataFrame:
    """The ``pairs(a, b, text_a, text_b)`` that reach the similarity on their full sets, as ``(a, b)``."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text_a"):
            x, first_x = shingle_sets(batch.column("text_a"), size)
            y, first_y = shingle_sets(batch.column("text_b"), size)
            rows = np.arange(batch.num_rows)
            n_x, n_y = np.diff(first_x), np.diff(first_y)
            value = np.concatenate([x, y])
            owner = np.concatenate([np.repeat(rows, n_x), np.repeat(rows, n_y)])
            order = np.lexsort((value, owner))
            value, owner = value[order], owner[order]
            twice = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
            common = np.bincount(owner[1:][twice], minlength=len(rows))
            keep = 100 * common >= SIMILARITY * (n_x + n_y - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(judged, "a long, b long")


def _part(df: DataFrame, rows: int | None) -> DataFrame:
    """``df``, in one part if its rows are few; ``None`` if their number is not known."""
    return df if rows is None or rows > PART_ROWS else df.coalesce(1)


def components(edges: DataFrame, links: int | None = None) -> DataFrame:
    """``(cid, comp)`` of every class on an edge: the smallest class that it reaches. ``links`` is the number of edges.

    Each round takes the smallest label among the neighbours and then the label of that label; a written table ends it.
    """
    ends = None if links is None else 2 * links
    both = _part(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), ends)
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp"))
                     .withColumnRenamed("a", "cid"), "near-labels")
    while True:
        labels = _part(labels, ends)
        named = labels.withColumnRenamed("comp", "next")
        near = both.join(named, both["b"] == named["cid"]).groupBy("a").agg(F.min("next").alias("next"))
        step = labels.join(near, labels["cid"] == near["a"]).select(
            "cid", F.col("comp").alias("old"), F.least("comp", "next").alias("comp"))
        jump = labels.select(F.col("cid").alias("at"), F.col("comp").alias("beyond"))
        moved = step.join(jump, step["comp"] == jump["at"], "left").select(
            "cid", "old", F.least("comp", F.coalesce("beyond", "comp")).alias("comp"))
        moved, changed = counted(moved, "near-labels", "comp <> old")
        labels = moved.select("cid", "comp")
        if not changed:
            return _part(labels, ends)


def differences(pairs: DataFrame, size: int) -> DataFrame:
    """``(bucket, base, cid, n, others, reach, cost)``: a row per shingle that one of ``pairs(base, cid, text_a, text_b)`` lacks.

    ``text_a`` is the base's. Two sets that lack ``r`` and ``s`` shingles of a base of ``p`` and add ``a`` and ``b`` reach
    the similarity exactly if ``(100 + SIMILARITY) * q >= 100 * (r + s) + SIMILARITY * (a + b) - (100 - SIMILARITY) * p``,
    where ``q`` counts the differences that they share; ``cost`` is twice a set's part of the right side. A set that is
    linked with the base needs partners that are not, whose part is larger; any other needs partners that have at least
    ``q`` differences. That bounds ``q`` from below by a set alone: it shares one of its first ``reach`` differences, in
    whatever order all have, with each partner.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text_a"):
            x, first_x = shingle_sets(batch.column("text_a"), size)
            y, first_y = shingle_sets(batch.column("text_b"), size)
            rows = np.arange(batch.num_rows)
            n_x, n_y = np.diff(first_x), np.diff(first_y)
            value = np.concatenate([x, y])
            owner = np.concatenate([np.repeat(rows, n_x), np.repeat(rows, n_y)])
            order = np.lexsort((value, owner))
            value, owner, added = value[order], owner[order], order >= len(x)
            twice = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
            once = ~(np.append(twice, False) | np.append(False, twice))
            value, owner, added = value[once], owner[once], added[once]
            others = np.bincount(owner, minlength=len(rows))
            more = np.bincount(owner[added], minlength=len(rows))
            worth, free = 100 * (others - more) + SIMILARITY * more, (100 - SIMILARITY) * n_x
            least = np.where(worth <= free, worth // (100 + SIMILARITY) + 1, -((free - worth) // 100))
            reach, cost = others - least + 1, 2 * worth - free
            own = np.flatnonzero(reach[owner] > 0)
            value, owner = value[own], owner[own]
            base = batch.column("base").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(value + mix(base[owner])).view(np.int64)), batch.column("base").take(pa.array(owner)),
                 batch.column("cid").take(pa.array(owner)), pa.array(n_y[owner]), pa.array(others[owner]),
                 pa.array(reach[owner]), pa.array(cost[owner])],
                names=["bucket", "base", "cid", "n", "others", "reach", "cost"])

    return pairs.mapInArrow(listed, "bucket long, base long, cid long, n long, others long, reach long, cost long")


def rare_differences(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``(bucket, cid, n, follow, cost)``: the classes of ``members(pivot, cid)`` anew, by what they differ in from a pivot.

    With the differences of a pivot's classes ordered by how many of the classes have them, two that are linked share one
    of the first ``reach`` of each. Those are the rare ones, and a class that resembles the pivot has few, so these buckets
    hold few pairs that fail, also among the near copies of one text. ``follow`` counts the differences behind that one.
    """
    bases = written(members.select(F.col("pivot").alias("base"), "cid").distinct(), "near-bases")
    one = bases.join(texts.select(F.col("cid").alias("base"), F.col("text").alias("text_a")), "base")
    two = one.join(texts.select("cid", F.col("text").alias("text_b")), "cid")
    rows = written(differences(two.select("base", "cid", "text_a", "text_b"), size), "near-differences")
    counts = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes")), "near-difference-counts")
    order = Window.partitionBy("base", "cid").orderBy("classes", "bucket")
    placed = rows.join(counts, "bucket").withColumn("place", F.row_number().over(order))
    kept = placed.where((F.col("place") <= F.col("reach")) & (F.col("classes") > 1))
    return kept.select("bucket", "cid", "n", (F.col("others") - F.col("place")).alias("follow"), "cost")


def _pivots(members: DataFrame, n: int, rows: int) -> DataFrame:
    """``(bucket, pivot, ...)``: ``n`` members of each bucket, those of the smallest components first."""
    sizes = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"))
    sized = members.join(_part(written(sizes, "near-sizes"), rows), ["bucket", "comp"])
    order = Window.partitionBy("bucket").orderBy("size", "cid")
    first = sized.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return first.select("bucket", "cid", "comp", "n", "follow", "cost")


def _pairs(members: DataFrame, pivots: DataFrame) -> tuple[DataFrame, int]:
    """``(a, b)``, and their number: pivots with the members of their buckets that lie in other components and may be similar enough.

    The sizes of two linked sets differ little; and where a bucket's difference is the first that a pair has in common, no
    more can be common than what follows it in either set.
    """
    x, y = members.alias("x"), pivots.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    sizes = 100 * F.least(n, m) >= SIMILARITY * F.greatest(n, m)
    common = 1 + F.least("x.follow", "y.follow")
    enough = 2 * (100 + SIMILARITY) * common >= F.col("x.cost") + F.col("y.cost")
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") != F.col("y.comp")) & sizes & enough
    pairs = x.join(y, apart).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))
    return counted(pairs.distinct(), "near-pairs")


def near_links(documents: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, sign, n, cid)`` of every row of ``documents(doc_id, text)``, and ``(cid, comp)`` of linked classes."""
    lean(documents.sparkSession)
    signed = documents.select("doc_id", F.xxhash64("text").alias("sign"), "text")
    sketches = written(sketch(signed, size), "near-sketches")
    linked = sketches.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = linked.groupBy("cid").agg(F.min(F.struct("doc_id", "sign")).alias("example"), F.first("n").alias("n"),
                                        F.first("registers").alias("registers"))
    classes = written(classes, "near-classes")
    spread = written(buckets(classes), "near-buckets")
    pivots = spread.groupBy("bucket").agg(F.min("cid").alias("pivot"), F.count(F.lit(1)).alias("size"))
    pivots = written(pivots.where("size > 1").select("bucket", "pivot"), "near-pivots")
    members = written(spread.join(pivots, "bucket"), "near-members")
    texts = _class_texts(classes, members, signed)
    slim = classes.select("cid", "n", "registers")
    pairs = members.where("cid <> pivot").select(
        F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
    found, links = _linked(pairs, slim, texts, size)
    edges = written(_part(found, links), "near-edges")
    labels = components(edges, links) if links else documents.sparkSession.createDataFrame([], "cid long, comp long")
    members, rows = _open(members.where("cid <> pivot").select("bucket", "cid", "pivot"), labels)
    if rows:
        members, rows = _open(written(rare_differences(members, texts, size), "near-refined"), labels)
    pivots_per_bucket = PIVOTS
    while rows:
        members = _part(members, rows)
        pivots = _part(written(_pivots(members, pivots_per_bucket, rows), "near-pivots"), rows)
        pairs, few = _pairs(members, pivots)
        found, more = _linked(F.broadcast(pairs) if few <= PART_ROWS else pairs, slim, texts, size)
        if more:
            edges, links = edges.unionByName(written(_part(found, more), "near-edges")), links + more
            labels = components(edges, links)
        # Pivots have met all members of their buckets; what is left matters where it lies in several components.
        left = members.join(pivots.select("bucket", "cid"), ["bucket", "cid"], "left_anti")
        members, rows = _open(left.select("bucket", "cid", "n", "follow", "cost"), labels)
        pivots_per_bucket *= PIVOTS
    return sketches.select("doc_id", "sign", "n", "cid"), labels


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with their component; a class without links is one of its own."""
    return members.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def _open(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """The members, with their components, of buckets that hold several components, and how many there are."""
    named = _named(members, labels)
    spans = named.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    spans = written(spans.where("low < high").select("bucket"), "near-open")
    return counted(named.join(spans, "bucket"), "near-open-members")


def _linked(pairs: DataFrame, slim: DataFrame, texts: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The ``pairs(a, b)`` that reach the similarity, by their sketches and then on their full sets, and their number."""
    pairs = pairs.join(slim.select(F.col("cid").alias("a"), F.col("n").alias("n_a"),
                                   F.col("registers").alias("sketch_a")), "a")
    pairs = pairs.join(slim.select(F.col("cid").alias("b"), F.col("n").alias("n_b"),
                                   F.col("registers").alias("sketch_b")), "b")
    sizes = 100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")
    likely = written(plausible(pairs.where(sizes)), "near-likely")
    one = likely.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
    return counted(confirmed(two.select("a", "b", "text_a", "text_b"), size), "near-links")


def _class_texts(classes: DataFrame, members: DataFrame, signed: DataFrame) -> DataFrame:
    """``(cid, text)``: a text of every class that shares a bucket. Texts are moved once, whatever their number."""
    needed = classes.join(members.select("cid").distinct(), "cid").select(
        "cid", "example.doc_id", F.col("example.sign").alias("sign"))
    needed = needed.hint("merge")
    texts = signed.withColumnRenamed("doc_id", "id").withColumnRenamed("sign", "id_sign")
    same = (texts["id"] == needed["doc_id"]) & (texts["id_sign"] == needed["sign"])
    return written(texts.join(needed, same).groupBy("cid").agg(F.first("text").alias("text")), "near-texts")


def near_groups(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, sign, n_shingles, component_id, kept)``, one row per row of ``documents(doc_id, text)``."""
    rows, labels = near_links(documents, size)
    named = rows.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    named = written(named.select("doc_id", "sign", "n", F.when(~alone, F.col("comp")).alias("comp")), "near-named")
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    least = written(least, "near-least")
    out = named.join(least, "comp", "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", "sign", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: ``doc_id, n_shingles, component_id, kept``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(docs).select("doc_id", "n_shingles", "component_id", "kept")


def near_stage(docs: DataFrame, size: int = 5) -> DataFrame:
    """One document of each near-duplicate group, in the columns of ``docs``: the one with the smallest id.

    Rows that share that id are the same document and stay together."""
    groups = near_groups(docs.select("doc_id", "text"), size)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("sign").alias("gone_sign"))
    gone = written(gone.distinct(), "near-gone").hint("merge")
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_sign"])
    return docs.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = {
    "op10_near_groups": f"""
        WITH RECURSIVE words AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT r, array_to_string(w[i + 1:i + 2], ' ') AS s
            FROM (SELECT r, w, unnest(range(greatest(len(w) - 1, 1))) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
        pairs AS (
            SELECT x.r AS a, y.r AS b, count(*) AS common
            FROM shingles x JOIN shingles y ON x.s = y.s AND x.r < y.r GROUP BY x.r, y.r),
        links AS (
            SELECT a, b FROM pairs JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b
            WHERE 100 * common >= {SIMILARITY} * (p.n + q.n - common)),
        edges AS (
            SELECT w.doc_id AS u, x.doc_id AS v FROM links JOIN words w ON w.r = a JOIN words x ON x.r = b
            UNION ALL
            SELECT x.doc_id, w.doc_id FROM links JOIN words w ON w.r = a JOIN words x ON x.r = b),
        reach(u, v) AS (
            SELECT DISTINCT doc_id, doc_id FROM words
            UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u),
        least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
        SELECT words.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, least.component_id,
               words.doc_id = least.component_id AS kept
        FROM words LEFT JOIN sizes USING (r) JOIN least ON least.u = words.doc_id
    """,
}
