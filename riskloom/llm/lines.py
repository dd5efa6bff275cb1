"""Line deduplication by site-relative frequency.

A line is boilerplate of a host when it is on at least ``MIN_PAGES`` of the host's pages and on more than ``RATIO`` of
them. Lines are compared without the white space around them; a blank line is never boilerplate. A page that would lose
every line that is not blank is a copy of other pages rather than a page with boilerplate, and is kept as it is: copies
are for the near-duplicate step.

Lines travel as 16-byte digests, once per page, and are counted before the shuffle, so a hot host or line sends one
number per task. The few boilerplate lines are matched to pages by a join whose two sides come straight from a shuffle
(or by broadcast, if Spark finds the written table small enough), so a line that a third of all pages have is split.

Nulls: pages of a null host are a host of their own; a null text has no lines and stays null. Repeated rows are pages
of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.frames import table, written

RATIO = 0.05
MIN_PAGES = 5
BLANK = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def text_lines(text: Column) -> Column:
    """The lines of a text."""
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """Digest of a line without the white space around it; null for a blank line."""
    bare = F.regexp_replace(line, BLANK, "")
    return F.when(bare != "", F.unhex(F.md5(bare.cast("binary"))))


def _keys(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(text_lines(text), line_key), lambda k: k.isNotNull()))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, key, pages, total)`` of the boilerplate lines of ``pages(host, text)``."""
    totals = written(pages.groupBy("host").agg(F.count(F.lit(1)).alias("total")), "host-totals")
    lines = pages.select("host", F.explode(_keys(F.col("text"))).alias("key"))
    counts = lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    met = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).drop(totals["host"])
    return met.where(F.col("pages") > F.col("total") * ratio)


def drop_boilerplate(
    pages: DataFrame, doc_id: str, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``(row, text, n_lines, n_dropped)``: each page as a struct, its text without boilerplate, and line counts."""
    slim = pages.select(F.col(doc_id).alias("id"), F.col(host).alias("host"), F.col(text).alias("text"))
    known = written(boilerplate(slim, ratio, min_pages).select("host", "key"), "boilerplate")
    found = slim.select("id", "host", F.explode(_keys(F.col("text"))).alias("key"))
    same = found["key"].eqNullSafe(known["key"]) & found["host"].eqNullSafe(known["host"])
    hits = found.join(known, same, "left_semi")
    hits = written(hits.groupBy("id", "host").agg(F.collect_set("key").alias("gone")), "boilerplate-hits").hint("merge")
    rows = pages.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.col(host).alias("host"),
                        F.col(text).alias("text"))
    met = rows.join(hits, rows["id"].eqNullSafe(hits["id"]) & rows["host"].eqNullSafe(hits["host"]), "left")
    lines = text_lines(F.col("text"))
    stays = F.filter(lines, lambda line: ~F.coalesce(F.array_contains(F.col("gone"), line_key(line)), F.lit(False)))
    met = met.select("row", rows["text"], "gone", F.when(F.col("gone").isNotNull(), stays).alias("stays"))
    something = F.exists("stays", lambda line: line_key(line).isNotNull())
    cut = F.col("gone").isNotNull() & something
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long")
    return met.select(
        "row",
        F.when(cut, F.array_join("stays", "\n")).otherwise(F.col("text")).alias("text"),
        n_lines.alias("n_lines"),
        F.when(cut, n_lines - F.size("stays")).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and dropped lines of every document, with its source as the host, and the digest of what is kept."""
    cleaned = drop_boilerplate(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return cleaned.select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def line_stage(docs: DataFrame) -> DataFrame:
    """The documents without the boilerplate lines of their source, in the columns of ``docs``."""
    cleaned = drop_boilerplate(docs, "doc_id", "source", "text")
    kept = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        kept[docs.columns.index("n_chars")] = (
            F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("row.n_chars"))
            .cast(docs.schema["n_chars"].dataType).alias("n_chars")
        )
    return cleaned.select(*kept)


_SPACES = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'"

ORACLE = {
    "op4_line_dedup": f"""
        WITH pages AS (SELECT row_number() OVER () AS page, doc_id, source, text FROM documents),
        parts AS (SELECT page, source, unnest(string_split(text, chr(10))) AS line,
                         generate_subscripts(string_split(text, chr(10)), 1) AS pos
                  FROM pages WHERE text IS NOT NULL),
        bare AS (SELECT *, regexp_replace(line, {_SPACES}) AS key FROM parts),
        totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
        known AS (
            SELECT b.source, b.key FROM bare b JOIN totals t ON b.source IS NOT DISTINCT FROM t.source
            WHERE b.key <> '' GROUP BY b.source, b.key, t.total
            HAVING count(DISTINCT b.page) >= {MIN_PAGES} AND count(DISTINCT b.page) > t.total * {RATIO}::DOUBLE),
        marked AS (
            SELECT b.page, b.pos, b.line, b.key, k.key IS NOT NULL AS gone
            FROM bare b LEFT JOIN known k ON b.source IS NOT DISTINCT FROM k.source AND b.key = k.key),
        judged AS (
            SELECT page, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone,
                   count(*) FILTER (NOT gone AND key <> '') AS n_left,
                   string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS stays
            FROM marked GROUP BY page)
        SELECT p.doc_id, CAST(coalesce(j.n_lines, 0) AS BIGINT) AS n_lines,
               CAST(CASE WHEN j.n_left > 0 THEN j.n_gone ELSE 0 END AS BIGINT) AS n_dropped,
               sha256(CASE WHEN j.n_left > 0 THEN j.stays ELSE coalesce(p.text, '') END) AS kept_sha256
        FROM pages p LEFT JOIN judged j USING (page)
    """,
}
