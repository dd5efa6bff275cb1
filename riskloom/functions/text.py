"""Text expressions: whitespace, tokens, compaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space str.split() recognises, which is Unicode's plus the four separator control codes.
UNICODE = "(?U)"
WHITESPACE = r"[\s\x1c-\x1f]"

# Token pattern and the length of a compacted text.
TOKEN = "[a-z0-9_]+"
COMPACT_CHARS = 900


def strip(text: Column) -> Column:
    """Drop leading and trailing white space of any kind (Spark's trim drops blanks only)."""
    return F.regexp_replace(text, f"{UNICODE}^{WHITESPACE}+|{WHITESPACE}+$", "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only; stops at the first other character."""
    return ~F.coalesce(text, F.lit("")).rlike(UNICODE + "[^" + WHITESPACE[1:])


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim the ends."""
    return F.trim(F.regexp_replace(text, f"{UNICODE}{WHITESPACE}+", " "))


def tokens(text: Column) -> Column:
    """All lower-case word tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def compact(text: Column, max_chars: int = COMPACT_CHARS) -> Column:
    """White space collapsed and the result cut to ``max_chars``, with an ellipsis where it was cut."""
    return F.regexp_replace(squeeze(text), f"(?s)^(.{{{max_chars - 3}}}).{{4,}}$", "$1...")
