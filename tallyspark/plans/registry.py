"""All queries of the reference's operators, by operator id, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.sources.bridge import CTES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str = "") -> Callable[[Query], Query]:
    """Register a query. sql may name the bridge's relations; it starts with SELECT, or with its own WITH list after ', '."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            used = [c for c in CTES if re.search(rf"\b{c}\b", sql)]
            head = ", ".join(f"{c} AS ({CTES[c]})" for c in used)
            own = sql.lstrip().removeprefix(",") if sql.lstrip().startswith(",") else ""
            if own:
                SQL[name] = f"WITH {head + ',' if head else ''}{own}"
            else:
                SQL[name] = f"WITH {head} {sql}" if head else sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from tallyspark.plans import agents, attribution, basics, closing, corrections, given, more, pushes, references, rest, reverts, stored, streams, windows  # noqa: F401
