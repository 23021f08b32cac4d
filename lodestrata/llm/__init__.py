"""Operators of a training-data pipeline.  Nothing outside this folder and tests/llm imports them."""

from __future__ import annotations

import importlib

#: The modules that hold an operator with its query and SQL, in the order of the operators.
MODULES = ["toxicity", "ngram_join", "decontaminate", "secrets", "suffix_dedup", "quality", "html_text", "warc", "bpe", "pii"]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"{__name__}.{m}").ORACLE_SQL.items()}
