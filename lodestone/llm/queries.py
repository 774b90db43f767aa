"""Queries of the text operators, by name; a module is imported when its query is run."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

NAMES = [
    "op1_toxicity",
    "op2_suffix_dedup",
    "op3_sentencepiece",
    "op4_fingerprints",
    "op5_exact_topk",
    "op6_simhash",
    "op7_seed_extend",
    "op8_pii",
    "op9_quality",
    "op10_packing",
]


def queries() -> dict[str, Callable]:
    return {n: (lambda spark, sf_dir, n=n: import_module(f"lodestone.llm.{n}").query(spark, sf_dir)) for n in NAMES}


def oracle_sql() -> dict[str, str]:
    from lodestone.llm import oracles

    return oracles.SQL
