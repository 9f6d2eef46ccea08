"""The queries of this subpackage, by the names under which the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import ann, bitslice, html, jaccard, langid, mixing, packing, quality, secrets, spans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_inverted_file_pq": ann.query,
    "op2_bit_sliced_topk": bitslice.query,
    "op3_language_id": langid.query,
    "op4_best_fit_packing": packing.query,
    "op5_source_mixing": mixing.query,
    "op6_quality": quality.query,
    "op7_secrets": secrets.query,
    "op8_jaccard_join": jaccard.query,
    "op9_html_consensus": html.query,
    "op10_sentence_spans": spans.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_bit_sliced_topk": bitslice.ORACLE_SQL,
    "op7_secrets": secrets.ORACLE_SQL,
    "op8_jaccard_join": jaccard.ORACLE_SQL,
}
