"""Top-k retrieval of documents for a table of questions, by keyword and by vector, over indexes made on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import compact, is_blank
from riskloom.operators.joins import join_measured
from riskloom.operators.keyword_index import KEPT, QUESTIONS, keyword_blocks, search_keywords
from riskloom.operators.sizing import fits
from riskloom.operators.vector_index import search_vectors, vector_packs
from riskloom.session import staged


def corpus_documents(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """``(source, text)`` of the files with a supported extension and some text."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(suffix.isin(*extensions) & ~is_blank(F.col("text"))).select(
        F.col("path").alias("source"), "text"
    )


def keyword_topk(questions: DataFrame, corpus: DataFrame, top_k: int = 4, block: int = QUESTIONS) -> DataFrame:
    """``(question, source, score, rank)``: per distinct question its best documents, by score and then source.

    ``corpus`` has one row per source; it is indexed once, whatever the number of questions.
    """
    return search_keywords(questions, staged(keyword_blocks(corpus), "keyword-index", KEPT), top_k, block)


def with_text(hits: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Add the compacted text of each hit; ``documents(<key>, text)`` has one row per key.

    Texts that a hit names are compacted and written before they meet the hits, or a broadcast join would compact a text
    again for every hit. A document that many hits name is split over tasks.
    """
    hits = staged(hits, "hits")
    named = hits.select(key).distinct()
    texts = documents.join(F.broadcast(named) if fits(named) else named, key, "left_semi")
    return join_measured(staged(texts.select(key, compact(F.col("text")).alias("text")), "texts"), hits, key).select(
        *hits.columns, "text")


def retrieve_context(questions: DataFrame, corpus: DataFrame, top_k: int = 4) -> DataFrame:
    """``(question, source, score, rank, text)``: per distinct question its best documents and their compacted text."""
    return with_text(keyword_topk(questions, corpus, top_k), corpus, "source")


def vector_topk(queries: DataFrame, corpus: DataFrame, top_k: int = 3, block: int | None = None) -> DataFrame:
    """``(query_id, vec_id, cosine, score, rank)``: per query its nearest vectors by cosine.

    A corpus row without a vector can't be found. Vectors are indexed once, whatever the number of queries.
    """
    return search_vectors(queries, staged(vector_packs(corpus), "vector-index"), top_k, block)
