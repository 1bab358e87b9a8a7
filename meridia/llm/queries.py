"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import bpe, chat, exact_dedup, language, line_rules, packing, quality, secrets, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_simhash": simhash.op3_simhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_line_rules": line_rules.op6_line_rules,
    "op7_bpe": bpe.op7_bpe,
    "op8_language": language.op8_language,
    "op9_secrets": secrets.op9_secrets,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat.ORACLE,
    "op6_line_rules": line_rules.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
