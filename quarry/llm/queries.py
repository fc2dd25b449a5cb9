"""Queries opN_<name> over the whole tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, mixing, repair_tokens, repeats, secrets, simhash, topk, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.query,
        "op2_toxicity": toxicity.query,
        "op3_warc": warc.query,
        "op4_mixing": mixing.query,
        "op5_language": langid.query,
        "op6_repeats": repeats.query,
        "op7_decontaminate": decontaminate.query,
        "op8_simhash": simhash.query,
        "op9_topk": topk.query,
        "op10_tokens": repair_tokens.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": warc.ORACLE,
        "op4_mixing": mixing.ORACLE,
        "op9_topk": topk.ORACLE,
    }
