"""The registry of queries over the test tables and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from attestry.plans import checks, evidence, health, records, retrieval, streams, telemetry, values, versions

MODULES = [records, telemetry, health, checks, values, evidence, retrieval, versions, streams]


def queries() -> dict[str, Callable]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
