"""An index of vectors in cells, and exact top-k search by cosine.

Vectors are scaled to length 1 and dealt to the nearest of some centres, which are vectors of a bounded sample. Within a
cell they are ordered by their distance from the centre and packed, so that a pack is a shell: its vectors lie between
two distances from the centre. By the triangle inequality no vector of a pack is nearer to a query than the query's
distance from the centre is outside that interval, and a pack is scored for a query only if that leaves a cosine which
can reach the one to beat. Results are those of comparing every query with every vector, whatever the cells.

A search takes its queries in parts of bounded size, each of which travels to the tasks once and passes over the packs
once. The cosine to beat starts as the ``top_k``-th best of the packs' first vectors and rises as a task sees more packs.

All vectors have the queries' width and finite elements; any other is an error that names it. Vectors of zeros have the
cosine 0 with everything and a cell of their own, which is never skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.topk import top_per_group
from riskloom.session import staged, staged_with

PACK_VECTORS = 2_048
QUERY_VALUES = 4_000_000  # elements of the query vectors that travel to the tasks at once
CELLS = 1_024  # centres at most
CELL_VECTORS = 4_096  # vectors of a cell on average, below that many cells
DIGITS = 6  # of the cosine, so that copies of a vector tie
SLACK = 2e-6  # what rounding may add to a cosine or take from a bound
NO_DIRECTION = -1  # the cell of zero vectors


def checked(vectors: DataFrame, key: str, what: str) -> DataFrame:
    """``(<key>, vector)`` as doubles; a row without its id or vector, or with a null or unlimited element, is an error."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    told = F.concat(F.lit(f"a {what} has an element that is not a number: "), F.col(key).cast("string"))
    return vectors.select(
        F.coalesce(F.col(key), F.raise_error(F.lit(f"a {what} lacks its id or vector"))).alias(key),
        F.when(F.col("vector").isNull() | F.col(key).isNull(), F.raise_error(F.lit(f"a {what} lacks its id or vector")))
        .when(~bad, F.col("vector")).otherwise(F.raise_error(told)).cast("array<double>").alias("vector"),
    )


def _scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros stay."""
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths > 0, lengths, 1.0)


def _centres(vectors: DataFrame, cells: int) -> np.ndarray:
    """Directions of some vectors, chosen by a hash of their values, so that reruns agree; none for an empty table."""
    hashed = vectors.select(F.xxhash64("vector").alias("hash"), "vector")
    least = hashed.groupBy(F.pmod("hash", F.lit(max(1, cells))).alias("part")).agg(F.min("hash").alias("hash"))
    picked = hashed.join(F.broadcast(least.select("hash")), "hash").groupBy("hash").agg(F.first("vector").alias("vector"))
    rows = [row["vector"] for row in sorted(picked.collect())]
    matrix = _scaled(np.array(rows, dtype="float64").reshape(len(rows), -1 if rows else 0))
    return matrix[np.linalg.norm(matrix, axis=1) > 0]


def vector_packs(corpus: DataFrame, cells: int | None = None) -> DataFrame:
    """``corpus(vec_id, vector)`` in packs: ``(cell, width, low, high, centre, ids, vectors)``; null vectors are left out.

    ``low`` and ``high`` are the least and largest distance of the pack's vectors from the cell's centre.
    """
    rows = checked(corpus.where("vector is not null"), "vec_id", "vector")
    vectors, sizes = staged_with(rows, "vectors", F.count(F.lit(1)).alias("rows"),
                                 F.max(F.size("vector")).alias("width"), F.min(F.size("vector")).alias("least"))
    if sizes["width"] != sizes["least"] or sizes["width"] == 0:
        raise ValueError(f"vectors of {sizes['least']} and of {sizes['width']} elements")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centres = _centres(vectors, min(CELLS, -(-sizes["rows"] // CELL_VECTORS)) if cells is None else cells)
    width = sizes["width"] or 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _scaled(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            cell, away = np.full(len(matrix), NO_DIRECTION), np.zeros(len(matrix))
            some = np.flatnonzero(matrix.any(axis=1))
            if len(some):
                cosines = matrix[some] @ centres.T
                cell[some] = cosines.argmax(axis=1)
                away[some] = np.linalg.norm(matrix[some] - centres[cell[some]], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * width, pa.int32()),
                                            pa.array(matrix.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(away), batch.column("vec_id"), flat],
                                             names=["cell", "away", "vec_id", "vector"])

    dealt = vectors.mapInArrow(deal, f"cell int, away double, vec_id {kind}, vector array<double>")
    order = ["cell", "away", "vec_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            changes = np.flatnonzero(np.diff(batch.column("cell").to_numpy())) + 1
            edges = [0, *changes.tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:]):
                while begin < end:
                    if held and held[0].column("cell")[0] != batch.column("cell")[begin]:
                        yield _packed(held, centres, width)
                        held = []
                    stop = min(end, begin + PACK_VECTORS - sum(b.num_rows for b in held))
                    held.append(batch.slice(begin, stop - begin))
                    begin = stop
                    if sum(b.num_rows for b in held) == PACK_VECTORS:
                        yield _packed(held, centres, width)
                        held = []
        if held:
            yield _packed(held, centres, width)

    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pack, f"cell int, width int, low double, high double, centre array<double>, ids array<{kind}>, "
        "vectors array<double>")


def _packed(held: list[pa.RecordBatch], centres: np.ndarray, width: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    cell, away = rows.column("cell")[0].as_py(), rows.column("away").to_numpy()
    flat, ids = rows.column("vector").flatten(), rows.column("vec_id")
    centre = np.zeros(width) if cell == NO_DIRECTION else centres[cell]
    whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays(
        [pa.array([cell], pa.int32()), pa.array([len(flat) // len(ids)], pa.int32()), pa.array([away.min()]),
         pa.array([away.max()]), whole(pa.array(centre)), whole(ids), whole(flat)],
        names=["cell", "width", "low", "high", "centre", "ids", "vectors"])


@dataclass
class _Asked:
    """A part of the queries: ids and directions, one row each."""

    ids: list
    matrix: np.ndarray

    @property
    def width(self) -> int:
        return self.matrix.shape[1]


def _better(found: dict, ids: list, cosines: np.ndarray, top_k: int) -> dict:
    """The best cosine of each id, for the ``top_k`` best ids, equal ones by id."""
    for name, cosine in zip(ids, cosines.tolist()):
        if cosine > found.get(name, -2.0):
            found[name] = cosine
    if len(found) > top_k:
        best = sorted(found.items(), key=lambda item: (-item[1], item[0]))[:top_k]
        found = dict(best)
    return found


def _search(packs: DataFrame, asked: _Asked, to_beat: np.ndarray, top_k: int, query_type, heads: bool) -> DataFrame:
    """``(query_id, vec_id, cosine)``: the best vectors of each task for every query; of ``heads`` the first of packs."""
    kind = packs.schema["ids"].dataType.elementType.simpleString()
    schema = f"query_id {query_type.simpleString()}, vec_id {kind}, cosine double"
    zero = ~asked.matrix.any(axis=1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beat, found, id_type = to_beat.copy(), [{} for _ in asked.ids], None
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                width = row.column("width")[0].as_py()
                if width != asked.width:
                    raise ValueError(f"an indexed vector has {width} elements where the query has {asked.width}")
                matrix = row.column("vectors").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                if heads or row.column("cell")[0].as_py() == NO_DIRECTION:
                    some = np.arange(len(asked.ids))
                else:
                    centre = row.column("centre").flatten().to_numpy(zero_copy_only=False)
                    away = np.linalg.norm(asked.matrix - centre, axis=1)
                    least = np.maximum(0, np.maximum(away - row.column("high")[0].as_py(),
                                                     row.column("low")[0].as_py() - away))
                    bound = np.where(zero, 0.0, 1 - least**2 / 2) + SLACK
                    some = np.flatnonzero(bound >= beat)
                if not len(some):
                    continue
                cosines, ids = np.round(matrix @ asked.matrix[some].T, DIGITS), row.column("ids").flatten()
                for column, q in enumerate(some):
                    places = np.flatnonzero(cosines[:, column] >= beat[q])
                    if len(places):
                        own = ids.take(pa.array(places)).to_pylist()
                        found[q] = _better(found[q], own, cosines[places, column], top_k)
                        if len(found[q]) == top_k:
                            beat[q] = max(beat[q], min(found[q].values()))
        hits = [(asked.ids[q], name, cosine) for q, best in enumerate(found) for name, cosine in best.items()]
        for at in range(0, len(hits), 50_000):
            query_id, vec_id, cosine = zip(*hits[at: at + 50_000])
            yield pa.RecordBatch.from_pydict({"query_id": list(query_id), "vec_id": pa.array(vec_id, id_type),
                                              "cosine": pa.array(cosine, pa.float64())})

    return packs.mapInArrow(task, schema)


def _ranked(hits: DataFrame, top_k: int) -> DataFrame:
    best = hits.groupBy("query_id", "vec_id").agg(F.max("cosine").alias("cosine"))
    return top_per_group(best, "query_id", [F.desc("cosine"), F.asc("vec_id")], top_k)


def _first_cosines(packs: DataFrame, asked: _Asked, top_k: int, query_type) -> np.ndarray:
    """For each query a cosine that ``top_k`` vectors are known to reach, -1 if the packs are too few to say."""
    first = packs.select("cell", "width", "low", "high", "centre", F.slice("ids", 1, 1).alias("ids"),
                         F.slice("vectors", F.lit(1), F.col("width")).alias("vectors"))
    least = np.full(len(asked.ids), -1.0)
    reached = _ranked(_search(first, asked, least, top_k, query_type, heads=True), top_k).where(F.col("rank") == top_k)
    place: dict = {}
    for k, name in enumerate(asked.ids):
        place.setdefault(name, []).append(k)
    for row in reached.select("query_id", "cosine").collect():
        if len(place[row["query_id"]]) == 1:  # an id of several vectors says nothing about each of them
            least[place[row["query_id"]]] = row["cosine"]
    return least


def search_vectors(queries: DataFrame, packs: DataFrame, top_k: int = 3, part: int | None = None) -> DataFrame:
    """``(query_id, vec_id, cosine, score, rank)``: per query its nearest vectors by cosine.

    A query without an id or a vector is an error; an id with several vectors takes the best cosine of them. The cosine is rounded to six digits before ranking, so
    copies of a vector tie and the smaller id wins. ``packs`` is a table of ``vector_packs``; ``part`` queries travel
    to the tasks at once.
    """
    spark, query_type = packs.sparkSession, queries.schema["query_id"].dataType
    asked, sizes = staged_with(
        checked(queries, "query_id", "query").distinct(), "queries", F.count(F.lit(1)).alias("rows"),
        F.max(F.size("vector")).alias("width"), F.min(F.size("vector")).alias("least"))
    if sizes["width"] != sizes["least"] or sizes["width"] == 0:
        raise ValueError(f"queries of {sizes['least']} and of {sizes['width']} elements")
    kind = packs.schema["ids"].dataType.elementType.simpleString()
    found = spark.createDataFrame([], f"query_id {query_type.simpleString()}, vec_id {kind}, cosine double")
    parts = -(-sizes["rows"] // (part or max(1, QUERY_VALUES // max(1, sizes["width"] or 1))))
    for k in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k).collect()
        if rows:
            matrix = np.array([row["vector"] for row in rows], dtype="float64")
            some = _Asked([row["query_id"] for row in rows], _scaled(matrix))
            to_beat = _first_cosines(packs, some, top_k, query_type)
            hits = _search(packs, some, to_beat, top_k, query_type, heads=False)
            found = hits if parts == 1 else found.unionByName(staged(hits, "vector-hits"))
    ranked = _ranked(found, top_k)
    return ranked.select("query_id", "vec_id", "cosine", (F.col("cosine") * 100).cast("int").alias("score"), "rank")
