"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import importlib

MODULES = ["sharding", "mixing", "topk", "secrets", "warc", "jaccard", "neardup", "toxicity", "sentencepiece_codec", "html_text", "infill", "token_alignment", "personal"]


def load() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"provena.llm.{name}")
        queries |= module.QUERIES
        sql |= module.ORACLE_SQL
    return queries, sql
