"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, html, lexical, lm, media, mixing, near, packing, repeats, token_files, topk, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_topk": topk.query,
        "op2_html": html.query,
        "op3_huffman": token_files.query,
        "op4_media": media.query,
        "op5_repeats": repeats.query,
        "op6_toxicity": toxicity.query,
        "op7_near_dedup": near.query,
        "op8_mixing": mixing.query,
        "op9_urls": urls.query,
        "op10_packing": packing.query,
        "op11_divergence": divergence.query,
        "op12_lm": lm.query,
        "op13_lexical": lexical.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": topk.ORACLE,
        "op5_repeats": repeats.ORACLE,
        "op7_near_dedup": near.ORACLE,
        "op8_mixing": mixing.ORACLE,
        "op11_divergence": divergence.ORACLE,
        "op13_lexical": lexical.ORACLE,
    }
