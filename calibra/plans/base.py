"""The query registry: functions of (spark, sf_dir), with the DuckDB SQL that has to give the same rows."""

from __future__ import annotations

from calibra.sources import adapter

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, views: bool = True):
    """Registers a query; ``sql`` goes on after the semantic views, unless ``views`` is false."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (adapter.SQL if views else "") + sql
        return f

    return register


def onward(name: str, select: str) -> str:
    """The SQL of a registered query as a view ``rows_``, and ``select`` from it; to register another query with."""
    sql = ORACLE_SQL[name].removeprefix(adapter.SQL)
    depth, last = 0, 0
    for k, ch in enumerate(sql):
        depth += (ch == "(") - (ch == ")")
        if not depth and sql.startswith("SELECT", k):
            last = k
    return f"{sql[:last]}, rows_ AS ({sql[last:]}) {select}"
