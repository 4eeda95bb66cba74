"""Every operator bound to the test tables, with the SQL it must agree with."""

from __future__ import annotations

from importlib import import_module

from lexloom.catalog.registry import ORACLE, QUERIES, Query

_MODULES = ["learner", "documents", "wording", "structure", "matching", "bank", "content", "practice"]


def _load() -> None:
    for name in _MODULES:
        import_module(f"lexloom.catalog.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
