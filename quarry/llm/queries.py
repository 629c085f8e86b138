"""The opN_<name> queries over the supplied tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this subpackage that defines it under that name, with ORACLE where SQL can express it.
MODULES = {
    "op1_mix_sources": "mixing",
    "op2_licences": "licences",
    "op3_suffix_dedup": "suffixes",
    "op4_html_text": "html",
    "op5_toxicity": "toxicity",
    "op6_simhash": "simhash",
    "op7_byte_bpe": "bpe",
    "op8_quality": "quality",
    "op9_media": "media",
    "op10_format_chat": "chat",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
