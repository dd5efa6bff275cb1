"""Benchmark decontamination with a positional inverted index, with DataFrame functions only.

Words are runs of digits, a to z (upper case folded) and everything beyond ASCII. A window is ten consecutive words of
an item, or the whole item if it is shorter. For each window the term that is rarest in the corpus is its anchor. The
index stores, for every anchor term, its postings over all documents: document, position, and the words around it, which
is what the lists of the window's other terms hold at the adjusted offsets. A window occurs where an anchor posting,
moved back by the anchor's offset, has the window's other terms at their offsets.

Anchors are broadcast to the scan in blocks of a bounded size, one scan each, however large the benchmark is. Postings
and windows are joined from written tables, so a frequent anchor is split over tasks; a posting meets only the windows
with its term as anchor.

Nulls: a null text has no words; a null item id counts as an empty text; a null document id is kept. Rows that share a
document id are judged one by one. Empty tables give empty results, or no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.frames import table, written

WINDOW = 10
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHOR_BLOCK = 50_000  # anchor terms broadcast to one scan
TERM_BYTES = 1_000  # longer terms are anchors by their digest, so a block has a bound in bytes too
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def short(term: Column) -> Column:
    """A term as the index names it."""
    return F.when(F.octet_length(term) > TERM_BYTES, F.sha2(term, 256)).otherwise(term)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, words)``: every window of ``items(item_id, text)``, as an array of its words."""
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                       words(F.col("text")).alias("all"))
    last = F.greatest(F.size("all") - window, F.lit(0))
    starts = cut.where(F.size("all") > 0).select("item_id", "all", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return starts.select("item_id", F.slice("all", F.col("at") + 1, F.lit(window)).alias("words")).distinct()


def term_blocks(terms: DataFrame, block: int = ANCHOR_BLOCK) -> list[DataFrame]:
    """``terms(term)`` cut by hash into parts of about ``block`` rows, so that each may be broadcast."""
    parts = max(1, -(-terms.count() // block))
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k) for k in range(parts)]


def _tokens(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the words in ``all`` and a digest that tells rows of one id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("sign"), words(F.col("text")).alias("all"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n)``: how often each of the ``terms(term)`` occurs in ``docs``; 0 is left out."""
    tokens = _tokens(docs).select(F.explode("all").alias("word")).select(short(F.col("word")).alias("term"))
    found = [tokens.join(F.broadcast(part), "term") for part in term_blocks(terms)]
    return reduce(DataFrame.unionByName, found).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame, reach: int = WINDOW - 1) -> DataFrame:
    """``(term, doc_id, sign, pos, left, around)`` for every occurrence of the ``terms(term)`` in ``docs``.

    ``around`` has up to ``reach`` words on either side, ``left`` of them before the term. The empty term ends every
    document; its position is the number of words.
    """
    ends = docs.sparkSession.createDataFrame([("",)], "term string")
    tokens = _tokens(docs)
    parts = term_blocks(terms)
    found = []
    for k, part in enumerate(parts):
        whole = F.concat("all", F.array(F.lit(""))) if k == 0 else F.col("all")
        wanted = part.unionByName(ends) if k == 0 else part
        rows = tokens.select("doc_id", "sign", "all", F.posexplode(whole).alias("pos", "word"))
        met = rows.withColumn("term", short(F.col("word"))).join(F.broadcast(wanted), "term")
        left = F.least(F.col("pos"), F.lit(reach))
        around = F.slice("all", F.col("pos") - left + 1, left + 1 + reach)
        around = F.when(F.col("term") != "", around)
        found.append(met.select("term", "doc_id", "sign", "pos", left.alias("left"), around.alias("around")))
    return reduce(DataFrame.unionByName, found)


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(doc_id, sign, phrase, start, length)``: where the words of ``phrases(phrase, words, anchor, offset)`` occur.

    ``anchor`` is one of the phrase's terms and ``offset`` its place in the phrase.
    """
    met = index.where("term <> ''").join(phrases, F.col("term") == F.col("anchor"))
    begin = F.col("left") - F.col("offset") + 1
    exact = (begin >= 1) & (F.slice("around", F.greatest(begin, F.lit(1)), F.size("words")) == F.col("words"))
    return met.where(exact).select(
        "doc_id", "sign", "phrase", (F.col("pos") - F.col("offset")).alias("start"), F.size("words").alias("length")
    )


def proximity_matches(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """``(doc_id, sign, phrase, start, length)``: stretches that hold all words of a phrase, in any order.

    A stretch begins with a word of the phrase and has at most ``slop`` words more than it; a word that the phrase has
    twice must occur twice. Each holds the phrase's anchor, so the words that the index keeps around a posting decide:
    its ``reach`` must be the longest phrase's words less one, plus ``slop``.
    """
    met = index.where("term <> ''").join(phrases, F.col("term") == F.col("anchor"))
    length = F.size("words") + slop
    first = F.greatest(F.lit(1), F.col("left") + 2 - length)
    met = met.select("*", F.explode(F.sequence(first, F.col("left") + 1)).alias("begin"))
    met = met.where(F.array_contains("words", F.element_at("around", F.col("begin"))))
    met = met.withColumn("stretch", F.slice("around", F.col("begin"), length))

    def uses(name: str, word: Column) -> Column:
        return F.size(F.filter(F.col(name), lambda other: other == word))

    holds = F.forall("words", lambda word: uses("stretch", word) >= uses("words", word))
    found = met.where(holds).select(
        "doc_id", "sign", "phrase", (F.col("pos") - F.col("left") - 1 + F.col("begin")).alias("start"),
        F.size("stretch").alias("length"),
    )
    return found.distinct()


def with_anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``(phrase, words, anchor, offset)``: each of ``windows(phrase, words)`` by its rarest term in the corpus.

    A window with a term that never occurs can't occur either and is left out.
    """
    terms = windows.select("phrase", F.posexplode("words").alias("offset", "word"))
    known = terms.withColumn("term", short(F.col("word"))).join(counts, "term", "left")
    best = known.groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")).alias("best")
    )
    return windows.join(best, "phrase").where("best.n > 0").select(
        "phrase", "words", F.col("best.term").alias("anchor"), F.col("best.offset").alias("offset")
    )


def near_matches(docs: DataFrame, items: DataFrame, slop: int, window: int = WINDOW) -> DataFrame:
    """``(item_id, doc_id, sign, start, length)``: where the words of an item's windows stand close together.

    ``docs(doc_id, text)`` and ``items(item_id, text)``; a stretch has up to ``slop`` words more than the window, whose
    words may come in any order. Exact occurrences are among them.
    """
    spelled = F.array_join("words", " ")
    by_item = written(item_windows(items, window).select("item_id", F.md5(spelled.cast("binary")).alias("phrase"),
                                                         "words"), "item-windows")
    windows = by_item.groupBy("phrase").agg(F.first("words").alias("words"))
    vocabulary = by_item.select(F.explode("words").alias("word")).select(short(F.col("word")).alias("term"))
    counts = written(term_counts(docs, written(vocabulary.distinct(), "item-terms")), "term-counts")
    phrases = written(with_anchors(windows, counts), "phrases")
    anchors = written(phrases.select(F.col("anchor").alias("term")).distinct(), "anchors")
    index = written(postings(docs, anchors, window - 1 + slop), "postings")
    found = written(proximity_matches(index, phrases, slop), "near-matches")
    return found.join(by_item.select("phrase", "item_id"), "phrase").select(
        "item_id", "doc_id", "sign", "start", "length").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, sign, n_words, n_hit, item_ids)``, one row per row of ``docs(doc_id, text)``."""
    spelled = F.array_join("words", " ")
    by_item = written(item_windows(items, window).select("item_id", F.md5(spelled.cast("binary")).alias("phrase"),
                                                         "words"), "item-windows")
    windows = by_item.groupBy("phrase").agg(F.first("words").alias("words"))
    vocabulary = by_item.select(F.explode("words").alias("word")).select(short(F.col("word")).alias("term"))
    counts = written(term_counts(docs, written(vocabulary.distinct(), "item-terms")), "term-counts")
    phrases = written(with_anchors(windows, counts), "phrases")
    anchors = written(phrases.select(F.col("anchor").alias("term")).distinct(), "anchors")
    index = written(postings(docs, anchors, window - 1), "postings")
    matches = written(phrase_matches(index, phrases), "matches")

    spots = matches.groupBy("doc_id", "sign", "start").agg(F.max("length").alias("length"))
    before = Window.partitionBy("doc_id", "sign").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    reached = F.greatest(F.coalesce(F.max(end).over(before), F.lit(0)), F.col("start"))
    new = F.greatest(end - reached, F.lit(0))
    hit = spots.withColumn("new", new).groupBy("doc_id", "sign").agg(F.sum("new").alias("n_hit"))

    named = by_item.select("phrase", "item_id")
    found = matches.select("doc_id", "sign", "phrase").distinct().join(named, "phrase")
    found = found.groupBy("doc_id", "sign").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))

    lengths = index.where("term = ''").select("doc_id", "sign", F.col("pos").cast("long").alias("n_words"))
    hit, found = hit.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("sign", "hit_sign"), (
        found.withColumnRenamed("doc_id", "item_doc").withColumnRenamed("sign", "item_sign"))
    out = lengths.join(hit, lengths["doc_id"].eqNullSafe(hit["hit_id"]) & (lengths["sign"] == hit["hit_sign"]), "left")
    out = out.join(found, out["doc_id"].eqNullSafe(found["item_doc"]) & (out["sign"] == found["item_sign"]), "left")
    return out.select(
        "doc_id", "sign", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def op7_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows, and the items found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontamination_stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, in the columns of ``docs``."""
    found = contamination(docs.select("doc_id", "text"), items.select("item_id", "text"))
    bad = written(found.where("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("sign").alias("bad_sign"))
                  .distinct(), "contaminated").hint("merge")
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_sign"])
    return docs.join(bad, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = {
    "op7_benchmark_hits": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(lower_az(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents),
        items AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
                   regexp_extract_all(lower_az(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark),
        item_windows AS (
            SELECT DISTINCT item_id, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS phrase, least(len(w), {WINDOW}) AS n
            FROM (SELECT *, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS i FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM item_windows),
        doc_windows AS (
            SELECT r, i, n, array_to_string(w[i + 1:i + n], ' ') AS phrase
            FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)),
        hits AS (SELECT d.r, d.i, d.n, m.item_id FROM doc_windows d JOIN item_windows m USING (phrase, n)),
        counted AS (
            SELECT r, count(DISTINCT spot) AS n_hit
            FROM (SELECT r, unnest(range(i, i + n)) AS spot FROM hits) GROUP BY r),
        named AS (
            SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
               coalesce(c.n_hit, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN counted c USING (r) LEFT JOIN named n USING (r)
    """.replace("lower_az(coalesce(text, ''))", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"),
}
