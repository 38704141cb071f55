"""Every query over the driver tables, by name, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Register the function below as a query; ``ctes`` come before its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return add


def _load() -> None:
    from gridloom.catalog import cells, evaluation, feedback, landing, models, rasters, spatial  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
