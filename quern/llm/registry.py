"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from quern.llm import bpe, exact_dedup, line_dedup, mixing, quality, secrets, simhash, suffix_dedup, toxicity, warc

_MODULES = {
    "op1_byte_bpe": bpe,
    "op2_quality_rules": quality,
    "op3_simhash": simhash,
    "op4_suffix_dedup": suffix_dedup,
    "op5_toxicity": toxicity,
    "op6_mix_sources": mixing,
    "op7_exact_dedup": exact_dedup,
    "op8_secret_scan": secrets,
    "op9_line_dedup": line_dedup,
    "op10_warc": warc,
}


def queries():
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql():
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
