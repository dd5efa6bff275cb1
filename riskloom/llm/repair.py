"""Repairing the turn structure of conversations by weighted CYK interval parsing.

A conversation in order gives role initials ``(s?(ua)+)?``. A row is kept (cost 0), gets another role (2) or goes (3);
an empty user or assistant turn may be inserted anywhere (2). Blank rows and repeats must go, and a row that is cut off
costs 1 more if it stays. Wanted are the edits of least cost and, among those, the ASCII-least string of their initials.

The grammar is in Chomsky normal form. Its symbols say with which role the text of a span begins and ends: none (all rows
of the span go), ``uu ua au aa`` and, after a system turn, ``ss su sa``. A lexical rule gives the edits of one row, a
binary rule joins neighbours if their roles may follow one another, and the insertion closure of a row's cell adds
inserted turns on either side. A conversation starts from none, ``ua`` or ``sa``. A cell holds the least (cost, audit) of
every symbol over a span, and spans are combined bottom-up by length.

Two properties keep that linear in the rows. The symbols are closed under every split of a span, so one split tells the
least of all and only spans of doubled length are made. And audits of one symbol, span and cost never begin one another
(they hold a letter per row beside the insertions, which cost), so the least audit of a span is made of least audits.

On Spark, rows are sorted by range over conversation and turn, so that a conversation of any share of the rows is cut into
many spans. Each task folds its spans into cells, the cells of a conversation meet in order, and the audit is played back
over its rows, which are streamed with no conversation held in memory.

Nulls: a null text, role, or part of the key that damage is drawn from is one space; a null turn stays null and sorts
first, and null ids form one conversation. Rows of one turn are ordered by a digest of role and text, so that repeats
are neighbours. A role's initial is its first character; only ``s``, ``u`` and ``a`` can be kept. Columns beyond the four
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.frames import lean, table, written

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1  # costs
DAMAGE = 20  # one row in so many suffers each kind of damage
BLANKS = " \t\n\x0b\f\r"
ROLES = {"u": "user", "a": "assistant"}
SYMBOLS = ("", "uu", "ua", "au", "aa", "ss", "su", "sa")
FOLLOW = ("ua", "au", "su")
START = ("", "ua", "sa")
FLUSH_ROWS, FLUSH_BYTES = 2_000, 4 * 1024 * 1024

Cell = dict[str, tuple[int, str]]


def _rules() -> list[tuple[str, str, str]]:
    """The binary rules: left, right, whole."""
    pairs = [(a, b, a[0] + b[1]) for a in SYMBOLS if a for b in SYMBOLS if b and a[1] + b[0] in FOLLOW]
    return [("", b, b) for b in SYMBOLS] + [(a, "", a) for a in SYMBOLS if a] + pairs


RULES = _rules()


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of a span from those of its two parts."""
    best: Cell = {}
    for a, b, whole in RULES:
        if a in left and b in right:
            cost = left[a][0] + right[b][0]
            if whole not in best or cost <= best[whole][0]:
                found = (cost, left[a][1] + right[b][1])
                if whole not in best or found < best[whole]:
                    best[whole] = found
    return best


def closed(cell: Cell) -> Cell:
    """A cell with any number of turns inserted before and after it."""
    turn: Cell = {"uu": (INSERT, "I"), "aa": (INSERT, "I")}
    while True:
        grown = dict(cell)
        for other in (combine(cell, turn), combine(turn, cell)):
            for symbol, found in other.items():
                grown[symbol] = min(grown.get(symbol, found), found)
        if grown == cell:
            return cell
        cell = grown


@lru_cache(maxsize=64)
def row_cell(initial: str, fault: str) -> tuple:
    """The closed cell of one row, as items."""
    cell: Cell = {"": (DELETE, "D")}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for role in ROLES:
            cell[role * 2] = (REROLE + more, "R")
        if initial in ("s", *ROLES):
            cell[initial * 2] = (more, "K")
    return tuple(closed(cell).items())


def least(cell: Cell) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(cell[symbol] for symbol in START if symbol in cell)


@dataclass
class Span:
    """Neighbouring rows of a conversation: their cell, and what the report counts."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first_turn: int | None = None
    last_turn: int | None = None
    first_role: str = ""
    last_role: str = ""
    cell: Cell = field(default_factory=lambda: {"": (0, "")})


COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_turn", "last_turn")
SPAN_FIELDS = [*((name, "bigint") for name in COUNTS), ("first_role", "string"), ("last_role", "string"),
               ("costs", "array<bigint>"), ("audits", "array<string>")]


def row_span(turn: int | None, initial: str, fault: str) -> Span:
    """The span of one row."""
    known = {name: int(fault == name) for name in ("blank", "duplicate", "truncated")}
    return Span(rows=1, **known, turns=int(turn is not None), low=turn, high=turn, first_turn=turn, last_turn=turn,
                first_role=initial, last_role=initial, cell=dict(row_cell(initial, fault)))


def joined(a: Span, b: Span) -> Span:
    """Two neighbouring spans as one."""
    if not (a.rows and b.rows):
        return a if a.rows else b
    shared = int(a.last_turn is not None and a.last_turn == b.first_turn)
    legal = a.last_role + b.first_role in FOLLOW
    return Span(
        rows=a.rows + b.rows, blank=a.blank + b.blank, duplicate=a.duplicate + b.duplicate,
        truncated=a.truncated + b.truncated, illegal=a.illegal + b.illegal + (not legal),
        turns=a.turns + b.turns - shared, low=b.low if a.low is None else a.low,
        high=a.high if b.high is None else b.high, first_turn=a.first_turn, last_turn=b.last_turn,
        first_role=a.first_role, last_role=b.last_role, cell=combine(a.cell, b.cell),
    )


class Chart:
    """Spans in order, combined as soon as two neighbours have the same length."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, Span]] = []

    def add(self, span: Span) -> None:
        size = 1
        while self.spans and self.spans[-1][0] == size:
            span, size = joined(self.spans.pop()[1], span), size * 2
        self.spans.append((size, span))

    def whole(self) -> Span:
        return reduce(lambda right, left: joined(left, right), [span for _, span in reversed(self.spans)], Span())


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, dropped)``: the rows after damage; a dropped row is kept under that mark."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % DAMAGE).alias("_kind"))
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"),
                       F.explode(copies).alias("_copy"))
    return rows.drop("_copy")


def _order() -> list[Column]:
    return [F.asc_nulls_first(c) for c in ("conv_id", "turn", "digest", "at")]


def turns_table(rows: DataFrame) -> DataFrame:
    """``rows`` written with ``at``, a number of their own, a ``digest`` of role and text, and the row's own ``fault``."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return written(rows.select("conv_id", "turn", "role", "text", "dropped", digest.alias("digest"),
                               fault.alias("fault"), F.monotonically_increasing_id().alias("at")), "turns")


def with_repeats(turns: DataFrame) -> DataFrame:
    """The rows without their texts, where one that is not blank and was there earlier has the fault ``duplicate``.

    The first of equal rows is cut per task before the shuffle, and rows find it by their own number, so that a text
    that a conversation repeats without end is never one group.
    """
    small = turns.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "dropped", "digest", "fault", "at")
    place = Window.partitionBy("conv_id", "digest").orderBy(*_order())
    first = small.where("not dropped").withColumn("_n", F.row_number().over(place)).where("_n = 1")
    met = small.join(first.select("at", F.lit(True).alias("_first")), "at", "left")
    again = (F.col("fault") != "blank") & F.col("_first").isNull()
    return met.withColumn("fault", F.when(again, "duplicate").otherwise(F.col("fault"))).drop("_first")


def _span_row(span: Span) -> list:
    found = [span.cell.get(symbol, (None, None)) for symbol in SYMBOLS]
    own = [getattr(span, name) for name, _ in SPAN_FIELDS[:-2]]
    return [*own, [cost for cost, _ in found], [audit for _, audit in found]]


def _span_of(row: dict) -> Span:
    cell = {s: (c, a) for s, c, a in zip(SYMBOLS, row["costs"], row["audits"]) if c is not None}
    return Span(**{name: row[name] for name, _ in SPAN_FIELDS[:-2]}, cell=cell)


def _batch(rows: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(list(column), kind) for column, kind in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, names=names)


ARROW = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()),
         "array<string>": pa.list_(pa.string())}


def _folded(of_row, head: tuple[str, ...]):
    """A task that folds each run of rows of one conversation into a span; ``head`` is taken from the run's first row."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*head, *(name for name, _ in SPAN_FIELDS)]
        out, run, types = [], None, []
        for batch in batches:
            types = [batch.schema.field(c).type for c in head] + [ARROW[kind] for _, kind in SPAN_FIELDS]
            for row in batch.to_pylist():
                if run is None or run[0] != row["conv_id"]:
                    if run:
                        out.append([*run[1], *_span_row(run[2].whole())])
                    run = (row["conv_id"], [row[c] for c in head], Chart())
                run[2].add(of_row(row))
            if len(out) >= FLUSH_ROWS:
                yield _batch(out, names, types)
                out = []
        if run:
            out.append([*run[1], *_span_row(run[2].whole())])
            yield _batch(out, names, types)

    return fold


def _row_or_nothing(row: dict) -> Span:
    return Span() if row["dropped"] else row_span(row["turn"], row["initial"], row["fault"])


def parsed(rows: DataFrame) -> DataFrame:
    """One row per conversation: its span over all rows of ``rows``, as ``with_repeats`` gives them."""
    fields = ", ".join(f"{name} {kind}" for name, kind in SPAN_FIELDS)
    head = ("conv_id", "turn", "digest", "at")
    kinds = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in head)
    spread = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    spans = written(spread.mapInArrow(_folded(_row_or_nothing, head), f"{kinds}, {fields}"), "spans")
    met = spans.repartition("conv_id").sortWithinPartitions(*_order())
    return met.mapInArrow(_folded(_span_of, head), f"{kinds}, {fields}").drop("turn", "digest", "at")


def report(spans: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation, written."""
    places = {symbol: k for k, symbol in enumerate(SYMBOLS)}
    found = [F.struct(F.col("costs")[places[s]].alias("cost"), F.col("audits")[places[s]].alias("audit")) for s in START]
    best = F.array_min(F.filter(F.array(*found), lambda f: f["cost"].isNotNull()))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return written(spans.select(
        "conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        best["cost"].alias("cost"), best["audit"].alias("audit"),
    ), "repair-report")


class _Player:
    """Plays an audit back over the rows of a conversation, one after another."""

    def __init__(self, conv_id, audit: str) -> None:
        self.conv_id, self.audit, self.at, self.place, self.last = conv_id, audit, 0, 0, ""

    def _given(self, role: str, text: str, edit: str) -> list:
        self.last, self.place = role[:1], self.place + 1
        return [self.conv_id, self.place - 1, role, text, edit]

    def _next_role(self) -> str:
        return ROLES["a" if self.last == "u" else "u"]

    def inserted(self) -> Iterator[list]:
        while self.audit[self.at: self.at + 1] == "I":
            self.at += 1
            yield self._given(self._next_role(), "", "I")

    def row(self, role: str, text: str) -> Iterator[list]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            yield self._given(role if edit == "K" else self._next_role(), text, edit)


def repaired_turns(turns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(conv_id, place, role, text, edit)``: the repaired conversations; ``edit`` is K, R or I.

    A conversation's rows lie in one partition in order. Its audit goes ahead of its rows, which are streamed.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.where("not dropped").select("conv_id", F.lit(1).alias("part"), "turn", "digest", "at", "role", "text")
    heads = verdicts.select(
        "conv_id", F.lit(0).alias("part"), *[F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in
                                             ("turn", "digest", "at", "role")], F.col("audit").alias("text"))
    lean(turns.sparkSession)
    ahead, *order = _order()

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, player, out, size = ["conv_id", "place", "role", "text", "edit"], None, [], 0
        for batch in batches:
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
            for row in batch.to_pylist():
                if row["part"] == 0:
                    given = list(player.inserted()) if player else []
                    player = _Player(row["conv_id"], row["text"])
                else:
                    given = list(player.row(row["role"], row["text"]))
                out += given
                size += sum(len(g[3]) for g in given)
                if len(out) >= FLUSH_ROWS or size >= FLUSH_BYTES:
                    yield _batch(out, names, types)
                    out, size = [], 0
        if player:
            out += player.inserted()
            if out:
                yield _batch(out, names, types)

    streamed = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(ahead, "part", *order)
    return streamed.mapInArrow(play, f"conv_id {kind}, place bigint, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the lines ``role:text`` of ``repaired_turns``; none for an empty conversation."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out, types = None, [], []
        for batch in batches:
            types = [batch.schema.field("conv_id").type, pa.string()]
            for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if state:
                        out.append([state[0], state[1].hexdigest()])
                    state = (conv_id, hashlib.sha256())
                state[1].update(("\n" * (place > 0) + f"{role}:{text}").encode())
            if len(out) >= FLUSH_ROWS:
                yield _batch(out, ["conv_id", "repaired_sha256"], types)
                out = []
        if state:
            yield _batch([*out, [state[0], state[1].hexdigest()]], ["conv_id", "repaired_sha256"], types)

    return repaired.mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report and the repaired turns of ``rows(conv_id, turn, role, text, dropped)``."""
    turns = turns_table(rows)
    verdicts = report(parsed(with_repeats(turns)))
    return verdicts, repaired_turns(turns, verdicts)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every damaged conversation, its cheapest repair, and a digest of the repaired text."""
    verdicts, repaired = repair(damaged(table(spark, sf_dir, "conversations")))
    found = digests(repaired).withColumnRenamed("conv_id", "_conv")
    met = verdicts.join(found, verdicts["conv_id"].eqNullSafe(found["_conv"]), "left").drop("_conv")
    empty = hashlib.sha256(b"").hexdigest()
    return met.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty)))
