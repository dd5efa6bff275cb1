"""Chat formatting with a prefix tree: turns that conversations share are emitted once.

Every turn is a piece of text, ``<turn ROLE>`` line, text, ``</turn>`` line. Inside roles and texts the template's
control characters are written as escapes (``\\`` as ``\\b``, ``<`` as ``\\l``, ``>`` as ``\\g``), so nothing in them can
open or close a turn and the texts come back unchanged.

A node of the tree is a turn with all turns before it, named by a chained digest. Conversations are sorted by the names
on their path, which is depth-first order; each then emits the nodes that no earlier one emitted, as one segment.
A segment has the place of its first token in the emitted sequence, the position id of its first token (tokens on the
path before it; later tokens count on), the spans of its tokens under the loss mask, and the intervals of the emitted
sequence that hold its ancestors, to which its tokens attend beside the segment's own earlier ones. Tokens are code
points, which every tokenizer's offsets refer to.

Shared first turns are never grouped into one task: sorting splits them by the rest of the path, owners are found by a
minimum that is taken before the shuffle, and rows meet nodes in joins of two written tables, which Spark can split.
One conversation is one task's work, since its digest runs through all of it.

Nulls: a null text or role is empty, a null turn comes last, a null conversation id is a conversation of its own.
Turns with the same number are ordered by role and text; repeated rows are turns of their own. An empty table gives no
segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.frames import lean, table, written

ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
OPEN, OPENED, CLOSED = "<turn ", ">\n", "\n</turn>\n"
LEARNED_ROLE = "assistant"
PATH = "conv_id {id}, path array<string>, pieces array<string>, learned array<int>"


def escaped(text: Column) -> Column:
    """A text without the template's control characters."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """The text that was escaped."""
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` of ``rows(conv_id, turn, role, text)``: the pieces in order, with where the text begins.

    ``learned`` is the length of an assistant's escaped text, -1 for other turns.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    piece = F.concat(F.lit(OPEN), escaped(role), F.lit(OPENED), escaped(text), F.lit(CLOSED))
    learned = F.when(role == LEARNED_ROLE, F.char_length(escaped(text))).otherwise(F.lit(-1))
    turns = rows.select("conv_id", F.struct(F.col("turn").isNull().alias("last"), "turn", role.alias("role"),
                                            text.alias("text"), piece.alias("piece"),
                                            learned.cast("int").alias("learned")).alias("turn"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the chained digest of every turn."""
    for batch in batches:
        paths = []
        for pieces in batch.column("pieces").to_pylist():
            name, path = b"", []
            for piece in pieces:
                name = hashlib.blake2b(name + piece.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                path.append(name.hex())
            paths.append(path)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(paths, pa.list_(pa.string())), batch.column("pieces"),
             batch.column("learned")],
            names=["conv_id", "path", "pieces", "learned"],
        )


def ranked_paths(rows: DataFrame) -> DataFrame:
    """``(conv_id, path, pieces, learned, rank)``: conversations with ``rank`` rising in depth-first order."""
    lean(rows.sparkSession)
    turns = format_turns(rows).select("conv_id", F.col("turns.piece").alias("pieces"),
                                      F.col("turns.learned").alias("learned"))
    paths = written(turns.mapInArrow(_named, PATH.format(id=turns.schema["conv_id"].dataType.simpleString())),
                    "chat-paths")
    ordered = paths.orderBy("path", F.asc_nulls_last("conv_id"))
    return written(ordered.withColumn("rank", F.monotonically_increasing_id()), "chat-ranked")


def prefix_tree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The emitted segments and, per conversation, where to read it.

    Segments: ``(segment, start, position, length, tokens, loss, ancestors)``; ``loss`` has the learned spans and
    ``ancestors`` the intervals attended to, both as places in the emitted sequence. Conversations:
    ``(conv_id, segment, first, last)``, in order of ``first``: the interval of each segment that it reads.
    """
    ranked = ranked_paths(rows)
    steps = ranked.select("rank", "conv_id", F.posexplode(F.arrays_zip("path", "pieces", "learned")).alias("depth", "n"))
    ahead = Window.partitionBy("rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("rank", "conv_id", "depth", F.col("n.path").alias("node"), F.col("n.learned").alias("learned"),
                         F.char_length("n.pieces").cast("long").alias("size"))
    steps = steps.withColumn("position", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    steps = written(steps, "chat-steps")
    owners = steps.groupBy("node").agg(
        F.min("rank").alias("segment"), F.first("depth").alias("depth"), F.first("position").alias("position"),
        F.first("size").alias("size"), F.first("learned").alias("learned"),
    )
    owners = written(owners, "chat-owners")
    segments = owners.groupBy("segment").agg(F.min("depth").alias("depth"), F.min("position").alias("position"),
                                             F.sum("size").alias("length"))
    # Places in the sequence: within each slice of the sorted conversations, then over the slices.
    segments = written(segments.withColumn("slice", F.shiftright("segment", 33)), "chat-segments")
    slices = segments.groupBy("slice").agg(F.sum("length").alias("length"))
    so_far = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("slice", F.coalesce(F.sum("length").over(so_far), F.lit(0)).alias("before"))
    inside = Window.partitionBy("slice").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.withColumn("inside", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(slices, "slice")
    placed = written(placed.select("segment", "depth", "position", "length",
                                   (F.col("before") + F.col("inside")).alias("start")), "chat-placed")

    shift = placed.select("segment", (F.col("start") - F.col("position")).alias("shift"))
    nodes = owners.join(shift, "segment").select(
        "node", "segment", "size", "learned", (F.col("position") + F.col("shift")).alias("first")
    )
    nodes = written(nodes, "chat-nodes")
    reads = steps.select("rank", "conv_id", "node").join(nodes, "node")
    reads = reads.groupBy("rank", "conv_id", "segment").agg(
        F.min("first").alias("first"), F.max(F.col("first") + F.col("size")).alias("last")
    )
    reads = written(reads, "chat-reads")
    # The text lies between the piece's head and its tail; the head's length follows from the piece's.
    begin = F.col("first") + F.col("size") - len(CLOSED) - F.col("learned")
    span = F.struct(begin.alias("first"), (begin + F.col("learned")).alias("last"))
    loss = nodes.where("learned >= 0").groupBy("segment").agg(F.array_sort(F.collect_list(span)).alias("loss"))
    above = reads.where("rank <> segment").join(placed.select(F.col("segment").alias("rank")), "rank", "left_semi")
    above = above.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ancestors"))
    text = F.array_join(F.slice("pieces", F.col("depth") + 1, F.greatest(F.size("pieces"), F.lit(1))), "")
    spans = "array<struct<first:bigint,last:bigint>>"
    emitted = (
        placed.join(ranked.select(F.col("rank").alias("segment"), "pieces"), "segment")
        .join(loss, "segment", "left").join(above.withColumnRenamed("rank", "segment"), "segment", "left")
        .select("segment", "start", "position", "length", text.alias("tokens"),
                F.coalesce("loss", F.array().cast(spans)).alias("loss"),
                F.coalesce("ancestors", F.array().cast(spans)).alias("ancestors"))
    )
    return written(emitted, "chat-emitted"), reads.select("conv_id", "rank", "segment", "first", "last")


def read_back(emitted: DataFrame, reads: DataFrame) -> DataFrame:
    """``(conv_id, formatted, learned)``: each conversation's text and its learned parts, cut from the segments."""
    met = reads.join(emitted.select("segment", "start", "tokens", "loss"), "segment")
    cut = F.substring("tokens", (F.col("first") - F.col("start") + 1).cast("int"),
                      (F.col("last") - F.col("first")).cast("int"))
    own = F.filter("loss", lambda s: (s["first"] >= F.col("first")) & (s["last"] <= F.col("last")))
    learned = F.transform(own, lambda s: F.substring(
        F.col("tokens"), (s["first"] - F.col("start") + 1).cast("int"), (s["last"] - s["first"]).cast("int")))
    part = F.struct("first", cut.alias("cut"), learned.alias("learned"))
    parts = met.groupBy("rank", "conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return parts.select("conv_id", F.array_join("parts.cut", "").alias("formatted"),
                        F.flatten("parts.learned").alias("learned"))


def parsed(formatted: str) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    pieces = F.filter(F.split(F.col(formatted), CLOSED), lambda p: p != "")
    head = len(OPEN) + 1
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, head, 2**31 - 1), OPENED, 1)).alias("role"),
        unescaped(F.substring(p, F.locate(OPENED, p, 1) + len(OPENED), 2**31 - 1)).alias("text"),
    ))


def op9_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every conversation, and one with control strings, reads as from the emitted segments."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    emitted, reads = prefix_tree(rows.unionByName(extra))
    back = read_back(emitted, reads).withColumn("turns", parsed("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("learned", unescaped), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "replace(replace(replace({0}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"

ORACLE = {
    "op9_chat_prefix_tree": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text))
                   AS turns_sha256,
               CAST(sum(CASE WHEN role = '{LEARNED_ROLE}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text)
                   FILTER (role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
               CAST(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})
                   + {len(OPEN) + len(OPENED) + len(CLOSED)}) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id
    """,
}
