"""Named queries with the SQL that another engine can check them by."""

from __future__ import annotations

from collections.abc import Callable

from lodestrata.sources.views import Views, with_views

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Views as query ``name``; ``sql`` may use the views of lodestrata.sources.views.SQL."""

    def register(build: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return build

    return register
