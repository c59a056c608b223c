"""Registry of queries and their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}

_NAME = re.compile(r"\b[vp]_\w+")


def cte(name: str, sql: str) -> None:
    """A named subquery that reference SQL may use."""
    CTES[name] = sql.strip()


def _closure(sql: str, found: set[str]) -> set[str]:
    for name in set(_NAME.findall(sql)) & CTES.keys() - found:
        found.add(name)
        _closure(CTES[name], found)
    return found


def past(name: str, prefix: str, changed: dict[str, str]) -> None:
    """A second form of a subquery, and of all it needs, under names with ``prefix`` in place of ``v_``, where some are changed."""
    found = {name}
    _closure(CTES[name], found)
    for n in [c for c in CTES if c in found]:
        again = re.sub(r"\bv_(?=\w)", prefix, CTES[n])
        CTES[prefix + n[2:]] = changed.get(n, again)


def complete(sql: str) -> str:
    needed = _closure(sql, set())
    if not needed:
        return sql.strip()
    body = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in CTES if n in needed)
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return f"WITH {body},\n{sql[5:]}"
    return f"WITH {body}\n{sql}"


def half_up(expr: str, digits: int = 2) -> str:
    """Decimal half-up rounding in the reference SQL."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28, 8)), {digits}) AS DOUBLE)"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register
