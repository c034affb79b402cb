"""Registration of queries together with their SQL counterparts."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}
FLAGSHIP = "erp01_readiness"


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
