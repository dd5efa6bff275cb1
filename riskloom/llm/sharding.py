"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A tree has regions, racks in them and shards in those, and a node weighs what the shards below it weigh. A document
descends from the root: at every level each child draws ``-ln(u) / weight``, where ``u`` in (0, 1) is a hash of the
document's key and the child's name, and the least draw wins. A child is chosen in proportion to its weight, and a
change of one weight leaves all other draws as they are. So rows move only into a subtree that grew, out of one that
shrank, and below a node whose weight stays nothing moves.

``with_shard`` hangs a new shard under a region of its own: no node that was there changes, and the new shard takes
rows only into itself. A shard added to a standing rack, or a changed weight, moves rows into that region too, where
they may go to any of its shards; movement is then confined to the path whose weights changed.

Law: ``key``. The id and the tree decide, so equal texts under different ids may part; copies of one id stay together.

A slot is the place of a row within its shard, from 0 without gaps, in the order of a digest of id, size and checksum.
Rows that agree in all three can't be told apart: they are counted before they are shuffled and take as many slots. The
sum runs over groups of the digest's leading digits, whose number follows the rows, so no shard is one task.

Nulls: a null text has no bytes and the checksum of an empty one; a null id draws as an empty text and stays null.
An empty table gives an empty result. A tree without positive weights is a ValueError.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.frames import counted, table, written

SEED = "shard-1"
SHAPE = (2, 2, 4)  # regions, racks in a region, shards in a rack
HASH_DIGITS = 13  # hexadecimal digits of a draw, which a double holds exactly
GROUP_ROWS = 64  # rows of a group of the slot order, on average
CHUNK = 100_000  # slots that one row is unfolded into at once


@dataclass(frozen=True)
class Leaf:
    """A shard and where it hangs."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform_tree(regions: int, racks: int, shards: int) -> list[Leaf]:
    """Shards of weight 1, numbered from 0 through the racks of each region."""
    return [
        Leaf(region, rack, (region * racks + rack) * shards + k)
        for region in range(regions) for rack in range(racks) for k in range(shards)
    ]


def with_shard(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one shard more, in a region of its own."""
    region, shard = (1 + max(getattr(leaf, name) for leaf in leaves) for name in ("region", "shard"))
    return [*leaves, Leaf(region, 0, shard, weight)]


def _levels(leaves: list[Leaf]) -> list[dict[str, dict[str, float]]]:
    """For each level the weight of every child by its parent's name; a child's name is its path."""
    levels: list[dict[str, dict[str, float]]] = [defaultdict(lambda: defaultdict(float)) for _ in range(3)]
    for leaf in leaves:
        if leaf.weight < 0:
            raise ValueError(f"a negative weight: {leaf}")
        path = ("", f"{leaf.region}", f"{leaf.region}/{leaf.rack}", f"{leaf.region}/{leaf.rack}/{leaf.shard}")
        if leaf.weight:
            for level, parent, child in zip(levels, path, path[1:]):
                level[parent][child] += leaf.weight
    if not levels[0]:
        raise ValueError("the tree has no weight")
    return levels


def draw(key: Column, node: Column, weight: Column, seed: str = SEED) -> Column:
    """A child's draw for a document; exponential, with the child's weight as its rate."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit("@"), node).cast("binary"))
    number = F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double")
    return -F.ln((number + 0.5) / float(16**HASH_DIGITS)) / weight


def descend(key: Column, leaves: list[Leaf], seed: str = SEED) -> Column:
    """The shard that a key descends to."""
    node = F.lit("")
    for level in _levels(leaves):
        pairs = []
        for parent, children in level.items():
            listed = [F.struct(F.lit(n).alias("node"), F.lit(float(w)).alias("weight")) for n, w in children.items()]
            pairs += [F.lit(parent), F.array(*listed)]
        below = F.element_at(F.create_map(*pairs), node)
        draws = F.transform(below, lambda c: F.struct(draw(key, c["node"], c["weight"], seed).alias("draw"), c["node"]))
        node = F.array_min(draws)["node"]
    return F.element_at(F.split(node, "/"), 3).cast("int")


def with_slots(rows: DataFrame, order: str, n_rows: int, n_shards: int) -> DataFrame:
    """Adds ``slot`` to ``rows``, which have a ``shard`` and in ``order`` a digest that tells different rows apart."""
    digits = 1
    while n_shards * 16**digits * GROUP_ROWS < n_rows:
        digits += 1
    rows = rows.withColumn("_group", F.substring(order, 1, digits))
    ahead = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("shard", "_group").agg(F.count(F.lit(1)).alias("_rows"))
    groups = groups.select("shard", "_group", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"))
    alike = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    place = Window.partitionBy("shard", "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_before") + F.coalesce(F.sum("_n").over(place), F.lit(0))
    placed = written(alike.join(groups, ["shard", "_group"]).withColumn("_first", first).drop("_before", "_group"),
                     "slots")
    # Rows of very many copies are unfolded in chunks that are dealt out first.
    many = placed.where(F.col("_n") > CHUNK).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))))
    many = many.select(
        *[c for c in placed.columns if c not in ("_n", "_first")],
        F.least(F.col("_n") - F.col("_chunk") * CHUNK, F.lit(CHUNK)).alias("_n"),
        (F.col("_first") + F.col("_chunk") * CHUNK).alias("_first"),
    ).repartition("shard", "_first")
    spread = placed.where(F.col("_n") <= CHUNK).unionByName(many)
    slots = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1))
    return spread.withColumn("slot", slots).drop("_n", "_first")


def shard_documents(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None, seed: str = SEED) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, grown_shard)`` of ``docs(doc_id, text)``.

    ``grown_shard`` is the shard under a second tree, null without one.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), descend(key, leaves, seed).alias("shard"),
        (descend(key, grown, seed) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    parts = F.concat_ws(":", F.lit(seed), key, F.col("doc_id").isNull().cast("string"), "size", "text_crc32")
    rows, n_rows = counted(sized.withColumn("_order", F.md5(parts.cast("binary"))), "shard-rows")
    placed = with_slots(rows, "_order", n_rows, len(leaves))
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def moves(placed: DataFrame) -> DataFrame:
    """``(shard, grown_shard, rows, bytes)``: what goes from where to where when the second tree takes over."""
    went = placed.where(F.col("shard") != F.col("grown_shard"))
    return went.groupBy("shard", "grown_shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def op11_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16, its slot there, and its shard of 17."""
    leaves = uniform_tree(*SHAPE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shard_documents(docs, leaves, with_shard(leaves))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _rows(leaves: list[Leaf]) -> str:
    """The nodes of a tree as SQL values: level, parent, name, weight."""
    levels = enumerate(_levels(leaves))
    return ", ".join(f"({k}, '{parent}', '{child}', {weight}::DOUBLE)" for k, level in levels
                     for parent, children in level.items() for child, weight in children.items())


def _descent(name: str, leaves: list[Leaf]) -> str:
    """Common tables that end in ``<name>(key, shard)``."""
    steps = [f"{name}_nodes(level, parent, node, weight) AS (VALUES {_rows(leaves)})"]
    before = "(SELECT key, '' AS node FROM keys)"
    for k in range(3):
        steps.append(f"""{name}{k} AS (
            SELECT d.key, arg_min(n.node, -ln((('0x' || substr(md5('{SEED}:' || d.key || '@' || n.node), 1,
                   {HASH_DIGITS}))::BIGINT::DOUBLE + 0.5) / {16**HASH_DIGITS}::DOUBLE) / n.weight) AS node
            FROM {before} d JOIN {name}_nodes n ON n.parent = d.node WHERE n.level = {k} GROUP BY d.key)""")
        before = f"{name}{k}"
    return ", ".join([*steps, f"{name} AS (SELECT key, split_part(node, '/', 3)::INTEGER AS shard FROM {name}2)"])


# DuckDB has no CRC-32: it is folded over the bytes of the text, by a table of 256 values made here from its polynomial.
ORACLE = {
    "op11_shard_tree": f"""
        WITH crc AS (
            SELECT list_transform(range(256), lambda b: list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
        docs AS (
            SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, strlen(coalesce(text, '')) + 1 AS size,
                   hex(encode(coalesce(text, ''))) AS digits FROM documents),
        sized AS (
            SELECT doc_id, key, CAST(size AS BIGINT) AS size,
                   xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(digits, '..'),
                       lambda d: ('0x' || d)::BIGINT)),
                       lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
            FROM docs, crc),
        keys AS (SELECT DISTINCT key FROM docs),
        {_descent("small", uniform_tree(*SHAPE))},
        {_descent("large", with_shard(uniform_tree(*SHAPE)))}
        SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, a.shard,
               row_number() OVER (PARTITION BY a.shard ORDER BY md5('{SEED}:' || s.key || ':' ||
                   CASE WHEN s.doc_id IS NULL THEN 'true' ELSE 'false' END || ':' || s.size || ':' || s.text_crc32))
                   - 1 AS slot, b.shard AS grown_shard
        FROM sized s JOIN small a USING (key) JOIN large b USING (key)
    """,
}
