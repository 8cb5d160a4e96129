"""Queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import ann, byte_bpe, decontamination, hard_negatives, language_model, ngram_join, packing, quality_model, quality_rules, sharding, toxicity, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_byte_bpe": byte_bpe.op2_byte_bpe,
        "op3_language_model": language_model.op3_language_model,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_warc": warc.op5_warc,
        "op6_hilbert_sharding": sharding.op6_hilbert_sharding,
        "op7_packing": packing.op7_packing,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_quality_model": quality_model.op9_quality_model,
        "op10_nearest": ann.op10_nearest,
        "op11_whitening": whitening.op11_whitening,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_decontamination": decontamination.op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.ORACLE_SQL,
        "op5_warc": warc.ORACLE_SQL,
        "op6_hilbert_sharding": sharding.ORACLE_SQL,
        "op8_quality_rules": quality_rules.ORACLE_SQL,
        "op12_hard_negatives": hard_negatives.ORACLE_SQL,
        "op13_decontamination": decontamination.ORACLE_SQL,
    }
