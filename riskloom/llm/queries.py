"""The registered queries of the subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import (
    chat, contamination, fingerprint, language, lexical, lines, mixing, near, quality, repair, sharding, substring,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_language_id": language.op2_language_id,
    "op3_quality": quality.op3_quality,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_benchmark_hits": contamination.op7_benchmark_hits,
    "op8_lz_fingerprint": fingerprint.op8_lz_fingerprint,
    "op9_chat_prefix_tree": chat.op9_chat_prefix_tree,
    "op10_near_groups": near.op10_near_groups,
    "op11_shard_tree": sharding.op11_shard_tree,
    "op12_ranked_search": lexical.op12_ranked_search,
    "op13_repair": repair.op13_repair,
}

ORACLE: dict[str, str] = {
    **substring.ORACLE, **lines.ORACLE, **mixing.ORACLE, **contamination.ORACLE, **chat.ORACLE, **near.ORACLE,
    **sharding.ORACLE, **lexical.ORACLE,
}
