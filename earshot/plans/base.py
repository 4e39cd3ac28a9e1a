"""Where queries and their SQL are registered."""

from __future__ import annotations

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    """Register a function (spark, sf_dir) by its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
