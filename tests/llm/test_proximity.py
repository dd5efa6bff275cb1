"""Proximity matches of benchmark windows against every stretch of every document."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from riskloom.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text: str | None) -> list[str]:
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs: list[tuple], items: list[tuple], slop: int, window: int) -> set:
    found = set()
    for item, text in items:
        words = split(text)
        for at in range(max(len(words) - window, 0) + 1 if words else 0):
            phrase = Counter(words[at: at + window])
            size = phrase.total() + slop
            for doc_id, own in ((d, split(t)) for d, t in docs):
                for start in range(len(own)):
                    stretch = own[start: start + size]
                    if own[start] in phrase and not phrase - Counter(stretch):
                        found.add((str(item), doc_id, start, len(stretch)))
    return found


def matches(spark, docs: list, items: list, slop: int, window: int) -> set:
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, pos int")
    right = spark.createDataFrame(items, "item_id bigint, text string")
    rows = contamination.near_matches(left, right, slop, window).collect()
    return {(r["item_id"], r["doc_id"], r["start"], r["length"]) for r in rows}


@pytest.mark.parametrize(("slop", "window"), [(0, 4), (2, 4), (3, 3)])
def test_near_matches_are_all_stretches(spark, slop, window):
    some = random.Random(slop + window)
    draw = lambda n: " ".join(some.choice("abcdefgh") for _ in range(n))
    docs = [(k, draw(some.randrange(0, 40))) for k in range(25)] + [(100, None), (101, "")]
    items = [(k, draw(some.randrange(1, 9))) for k in range(6)] + [(50, "A. b, C!"), (51, None), (52, "zzz a b c")]
    assert matches(spark, docs, items, slop, window) == brute(docs, items, slop, window)


def test_inserted_words_and_repeated_ones(spark):
    """A phrase with words put in, its rarest word at either end, and a word that must occur twice."""
    ten = [f"w{k}" for k in range(10)]
    docs = [(1, " ".join([*ten[:5], "x", "y", *ten[5:]])), (2, "r s z z z"), (3, "r z r s"), (4, " ".join(reversed(ten)))]
    docs += [(10 + k, " ".join(ten[1:])) for k in range(3)] + [(20 + k, " ".join(ten[:9])) for k in range(3)]
    items = [(7, " ".join(ten)), (8, "r r s")]
    found = matches(spark, docs, items, 2, 10)
    assert {(item, doc) for item, doc, _, _ in found} == {("7", 1), ("7", 4), ("8", 3)}
    assert found == brute(docs, items, 2, 10)
