"""Where queries are registered: a function over domain views, and its SQL."""

from __future__ import annotations

from hazardspark import fixtures as fx

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(*views: str, sql: str | None = None):
    """Register a query over these views, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(fx.view(spark, sf_dir, v) for v in views))
        if sql:
            ORACLE[f.__name__] = fx.with_views(sql)
        return f

    return add
