"""Registry of queries, their oracles, and shared oracle CTEs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    """A named subquery the oracles may refer to as ``{name}``."""
    CTES[name] = body.strip()


def _needed(sql: str, seen: list[str]) -> None:
    for name in re.findall(r"\{([a-z]\w*)\}", sql):
        if name not in seen:
            _needed(CTES[name], seen)
            seen.append(name)


def render(sql: str) -> str:
    """Prefix the CTEs a query refers to, in dependency order."""
    names: list[str] = []
    _needed(sql, names)
    plain = lambda s: re.sub(r"\{([a-z]\w*)\}", r"\1", s)
    if not names:
        return sql.strip()
    parts = [f"{n} AS MATERIALIZED ({plain(CTES[n])})" for n in names]
    body = plain(sql).strip()
    own = body.startswith("WITH ")
    return "WITH " + ",\n".join(parts) + (",\n" + body[5:] if own else "\n" + body)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = render(sql)
        return fn

    return register
