"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import decontaminate, html_text, language_id, media, mixing, near_dedup, phrases, prefix_trie, sharding, substring_dedup, token_shards, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1_sharding,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_warc": warc.op4_warc,
    "op5_html_extraction": html_text.op5_html_extraction,
    "op6_token_shards": token_shards.op6_token_shards,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_media": media.op9_media,
    "op10_mixing": mixing.op10_mixing,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_language_id": language_id.op12_language_id,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE_SQL: dict[str, str] = {"op10_mixing": mixing.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op13_phrases": phrases.ORACLE}
