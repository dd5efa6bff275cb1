"""Conversation repair against brute force: every edit of short conversations, and a shortest path for long ones."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from conftest import SMALL

from riskloom.llm import repair
from riskloom.llm.queries import QUERIES

LEGAL = re.compile("(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def every_edit(rows: list[tuple[str, str]], most_inserted: int = 2) -> tuple[int, str]:
    """The least (cost, audit) over all edits, with so many insertions per gap."""
    gaps = ["".join(p) for n in range(most_inserted + 1) for p in itertools.product("ua", repeat=n)]
    best = None
    options = []
    for initial, fault in rows:
        more = int(fault == "truncated")
        own = [(3, "D", "")]
        if fault not in ("blank", "duplicate"):
            own += [(more, "K", initial), (2 + more, "R", "u"), (2 + more, "R", "a")]
        options.append(own)
    for picked in itertools.product(*options):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            given = inserted[0] + "".join(edit[2] + gap for edit, gap in zip(picked, inserted[1:]))
            if LEGAL.fullmatch(given):
                cost = sum(edit[0] for edit in picked) + 2 * sum(map(len, inserted))
                audit = "I" * len(inserted[0]) + "".join(e[1] + "I" * len(g) for e, g in zip(picked, inserted[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


def shortest(rows: list[tuple[str, str]]) -> tuple[int, str, list]:
    """The same by least paths over (rows done, last role), with what stays: (row or None, initial)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, kept = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit, list(kept)
        fits = {"": "us", "s": "u", "u": "a", "a": "u"}[last]
        for role in set(fits) - {"s"}:
            heapq.heappush(heap, (cost + 2, audit + "I", at, role, (*kept, (-1, role))))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last, kept))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if initial and initial in fits:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initial, (*kept, (at, initial))))
                for role in set(fits) - {"s"}:
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, role, (*kept, (at, role))))
    raise AssertionError


def test_cells_give_the_least_of_every_edit():
    some = random.Random(5)
    faults = ("", "", "", "truncated", "blank", "duplicate")
    cases = [[(r, f)] for r in "suax " for f in faults[2:]] + [[]]
    cases += [[(some.choice("ssuuaax"), some.choice(faults)) for _ in range(n)] for n in (2, 2, 2, 3) for _ in range(12)]
    for rows in cases:
        chart = repair.Chart()
        for initial, fault in rows:
            chart.add(repair.row_span(0, initial, fault))
        assert repair.least(chart.whole().cell) == every_edit(rows) == shortest(rows)[:2], rows


def test_any_split_gives_the_same_cell():
    some = random.Random(6)
    rows = [(some.choice("suax"), some.choice(("", "truncated", "blank"))) for _ in range(23)]
    spans = [repair.row_span(k, *row) for k, row in enumerate(rows)]

    def folded(begin: int, end: int):
        if end - begin == 1:
            return spans[begin]
        cut = some.randrange(begin + 1, end)
        return repair.joined(folded(begin, cut), folded(cut, end))

    assert folded(0, 23) == folded(0, 23)
    assert repair.least(folded(0, 23).cell) == shortest(rows)[:2]


def brute(conversations: list[tuple]) -> dict:
    """The contract's columns by conversation, from (conv_id, turn, role, text)."""
    rows, ids = defaultdict(list), {c[0] for c in conversations}
    for conv, turn, role, text in conversations:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv in ids:
        order = lambda r: (r[0] is not None, r[0] or 0,
                           hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest())
        own, earlier, faults = sorted(rows[conv], key=order), set(), []
        for _, role, text in own:
            last = text.rstrip(" \t\n\x0b\f\r")[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in earlier else
                          "" if last in ".!?" else "truncated")
            earlier.add((role, text))
        roles = [r[1][:1] for r in own]
        cost, audit, kept = shortest(list(zip(roles, faults)))
        lines = []
        for at, initial in kept:
            keeps = at >= 0 and own[at][1][:1] == initial
            lines.append(f"{own[at][1] if keeps else NAMES[initial]}:{own[at][2] if at >= 0 else ''}")
        turns = [r[0] for r in own if r[0] is not None]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
            faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df) -> dict:
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query_matches_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_repair"](spark, folder)) == brute(rows)


def odd_rows() -> list[tuple]:
    some = random.Random(11)
    texts = ["One.", "Two!", "no end", "", " \t", None, "Why? ", "One.", "é.", "x" * 40_000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "ünd"]
    rows = [(some.choice([1, 2, 3, None, -4, 9]), some.choice([None, *range(12)]), some.choice(roles),
             some.choice(texts)) for _ in range(160)]
    rows += [(50, k, "user", "Again.") for k in range(300)] + [(51, 3, "assistant", "Ties.")] * 40
    rows += [(60, k, ("user", "assistant")[k % 2], f"Line {k}" + ".!?x"[k % 4]) for k in range(-200, 400)]
    return rows


def test_odd_rows_match_brute_force(spark, tmp_path):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows],
                                  "conv_id bigint, turn bigint, role string, text string, at int, fault string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(QUERIES["op13_repair"](spark, str(tmp_path))) == brute(rows)


def test_a_conversation_cut_into_many_spans(spark):
    """Rows of one conversation dealt over many tasks give the cell of one task, and its repaired turns in order."""
    rows = [(7, k, "user" if k % 3 else "assistant", f"Text {k}.") for k in range(2_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        verdicts, repaired = repair.repair(repair.damaged(frame))
        assert found(verdicts.selectExpr("*", "'' AS repaired_sha256"))[7][:-1] == brute(rows)[7][:-1]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    turns = repaired.orderBy("place").collect()
    assert [r.place for r in turns] == list(range(len(turns)))
    assert LEGAL.fullmatch("".join(r.role[0] for r in turns)) and {r.edit for r in turns} <= set("KRI")
    text = "\n".join(f"{r.role}:{r.text}" for r in turns)
    assert hashlib.sha256(text.encode()).hexdigest() == brute(rows)[7][-1]


def test_a_conversation_without_rows(spark, tmp_path):
    gone = next(k for k in range(1_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    assert found(QUERIES["op13_repair"](spark, str(tmp_path))) == {
        gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
