"""The records of CSV files whose quoted fields may hold line breaks, read in parallel.

A line break ends a record if the quotes before it are even in number. The quotes of every block of a file (a split, as
Spark cuts it) are summed first; the sums before a block tell whether it begins inside a field. Each block is then cut
into records on its own. What lies before its first record end and after its last is a fragment, at most two of them
per block, and the fragments of a record are put together across blocks. So one file takes as many tasks as it has blocks.

Lines end with LF or CRLF, breaks within a field stay as they are, and quotes inside a field are doubled. A quote within an unquoted field counts as an opening
one, which makes the record ragged and thus an error for its reader; a field that is never closed is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators.sizing import fits
from riskloom.session import staged

QUOTE = '"'
UNCLOSED = "A quoted field is not closed in "
RECORDS = "file string, start bigint, place bigint, n bigint, header boolean, kind string, text string"
FLUSH_BYTES = 4 * 1024 * 1024


class _Block:
    """Cuts the lines of one block into records and fragments, in order."""

    def __init__(self, file: str, start: int, inside: bool) -> None:
        self.file, self.start, self.inside = file, start, inside
        self.pending: list[str] = []
        self.head = inside  # what is pending continues a record of an earlier block
        self.place, self.n = 0, 0
        self.header = start == 0

    def _given(self, kind: str, text: str) -> list:
        """A row; ``n`` counts the records that begin in this block, without the header."""
        starts = kind in ("whole", "tail")
        row = [self.file, self.start, self.place, self.n if starts and not self.header else None,
               starts and self.header, kind, text]
        self.place += 1
        if starts:
            self.n += not self.header
            self.header = False
        return row

    def add(self, lines: pa.Array) -> Iterator[list]:
        odd = pc.count_substring(lines, QUOTE).to_numpy(zero_copy_only=False) & 1
        open_after = (np.cumsum(odd) + int(self.inside)) & 1
        texts, begin = lines.to_pylist(), 0
        for end in np.flatnonzero(open_after == 0).tolist():
            text = "\n".join([*self.pending, *texts[begin: end + 1]]).removesuffix("\r")
            self.pending, begin = [], end + 1
            if text or self.head:
                yield self._given("head" if self.head else "whole", text)
            self.head = False
        self.pending += texts[begin:]
        if len(open_after):
            self.inside = bool(open_after[-1])

    def rest(self) -> Iterator[list]:
        if self.pending:
            yield self._given("through" if self.head else "tail", "\n".join(self.pending))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``RECORDS`` from ``(file, start, inside, value)`` of lines in order."""
    block, out, size = None, [], 0

    def flushed() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        names = [field.split()[0] for field in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("start").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            name = (batch.column("file")[begin].as_py(), int(start[begin]))
            if block is None or (block.file, block.start) != name:
                out += block.rest() if block else ()
                block = _Block(*name, batch.column("inside")[begin].as_py())
            given = list(block.add(batch.column("value").slice(begin, end - begin)))
            out += given
            size += sum(len(row[-1]) for row in given)
            if size >= FLUSH_BYTES:
                yield flushed()
                out, size = [], 0
    if block:
        out += block.rest()
    if out:
        yield flushed()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, place, n, header, text)``: every record that is not empty, written.

    ``start`` is the block in which a record begins, ``place`` its order there and ``n`` its number among the block's
    records, which is null for the ``header``, the first record of a file.
    """
    split = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.option("lineSep", "\n").text(path).select(*split, "value")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit(QUOTE), F.lit("")))
    blocks = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    begins = staged(blocks.select("file", "start", inside.alias("inside")), "csv-blocks")
    if fits(begins):
        placed = lines.join(F.broadcast(begins), ["file", "start"])
    else:
        numbered = lines.withColumn("_at", F.monotonically_increasing_id()).join(begins, ["file", "start"])
        placed = numbered.repartition("file", "start").sortWithinPartitions("file", "start", "_at")
    cut = staged(placed.select("file", "start", "inside", "value").mapInArrow(_cut, RECORDS), "csv-cut")

    parts = cut.where("kind <> 'whole'")
    in_order = Window.partitionBy("file").orderBy("start", "place")
    record = F.sum((F.col("kind") == "tail").cast("int")).over(in_order)
    each = F.array_sort(F.collect_list(F.struct("start", "place", "n", "header", "kind", "text")))
    met = parts.withColumn("record", record).groupBy("file", "record").agg(each.alias("parts"))
    first, last = F.element_at("parts", 1), F.element_at("parts", -1)
    text = F.array_join(F.transform("parts", lambda part: part["text"]), "\n")
    closed = F.when(last["kind"] == "head", text).otherwise(F.raise_error(F.concat(F.lit(UNCLOSED), "file")))
    stitched = met.select("file", first["start"].alias("start"), first["place"].alias("place"), first["n"].alias("n"),
                          first["header"].alias("header"), closed.alias("text"))
    whole = cut.where("kind = 'whole'").select("file", "start", "place", "n", "header", "text")
    return whole.unionByName(stitched)


def numbered_records(records: DataFrame, name: str) -> DataFrame:
    """The records but the headers, with their number over all files in path order, from 1."""
    rows = records.where("not header")
    blocks = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("_rows"))
    in_order = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "start", F.coalesce(F.sum("_rows").over(in_order), F.lit(0)).alias("_before"))
    if fits(offsets):
        offsets = F.broadcast(offsets)
    return rows.join(offsets, ["file", "start"]).withColumn(name, F.col("_before") + F.col("n") + 1).drop("_before")


def parsed_records(records: DataFrame, names: list[str], options: dict[str, str], *kept: str) -> DataFrame:
    """The fields of the records as text columns, beside the ``kept`` ones; a ragged record is an error."""
    fields = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    row = F.from_csv("text", fields, {**options, "mode": "FAILFAST"})
    return records.select(*kept, row.alias("_row")).select(*kept, *[F.col("_row").getField(name).alias(name) for name in names])
