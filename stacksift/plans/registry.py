"""The library's queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("catalogue", "linking", "texts", "audits", "rules", "streams", "persons", "policies", "imports", "reads", "files", "numbers")

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name."""

    def add(f: Callable) -> Callable:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"stacksift.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
