"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tracewell.llm import chat, decontaminate, katz, language, mixing, neardup, passages, quality, rollup, toxicity, variants, vectorgraph, whitening

_MODULES = [rollup, katz, chat, language, decontaminate, toxicity, quality, neardup, passages, mixing, whitening, variants, vectorgraph]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
