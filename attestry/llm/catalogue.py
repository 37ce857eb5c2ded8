"""The registry of this subpackage's queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from attestry.llm import decontaminate, dialogue, divergence, edits, fixity, langid, packing, pii, pivots, quality, simhash, substrings, urls

MODULES = [edits, decontaminate, pii, packing, quality, langid, substrings, simhash, urls, fixity, dialogue, pivots, divergence]


def queries() -> dict[str, Callable]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
