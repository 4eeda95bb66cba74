"""Operators for preparing training data: each module holds one operator and its query."""

from __future__ import annotations

from importlib import import_module

from lexloom.llm.registry import ORACLE, QUERIES, Query

_MODULES = [
    "url_trust", "mixing", "substring", "warc", "quality", "materialise", "ngram_join", "packing", "near_vectors", "fm_quality",
    "repair", "lattice", "prefix_trie",
]


def _load() -> None:
    for name in _MODULES:
        import_module(f"lexloom.llm.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
