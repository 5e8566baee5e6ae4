"""The registered queries of this subpackage and their SQL, in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, hard_negatives, html_extract, imatch, language_id, masked_lm, minhash_dedup, quality_rules, secret_scan, sentence_pieces, source_mix, suffix_dedup, whitening
from .common import table


def _on(name: str, fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_imatch": _on("documents", imatch.op1),
        "op2_suffix_dedup": _on("documents", suffix_dedup.op2),
        "op3_sentence_pieces": _on("documents", sentence_pieces.op3),
        "op4_quality_rules": _on("documents", quality_rules.op4),
        "op5_chat_format": _on("conversations", chat_format.op5),
        "op6_source_mix": _on("documents", source_mix.op6),
        "op7_html_extract": _on("pages", html_extract.op7),
        "op8_masked_lm": _on("documents", masked_lm.op8),
        "op9_minhash_dedup": _on("documents", minhash_dedup.op9),
        "op10_language_id": _on("documents", language_id.op10),
        "op11_hard_negatives": _on("embeddings", hard_negatives.op11),
        "op12_whitening": _on("embeddings", whitening.op12),
        "op13_secret_scan": _on("documents", secret_scan.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": quality_rules.ORACLE,
        "op5_chat_format": chat_format.ORACLE,
        "op6_source_mix": source_mix.ORACLE,
        "op9_minhash_dedup": minhash_dedup.ORACLE,
        "op11_hard_negatives": hard_negatives.ORACLE,
    }
