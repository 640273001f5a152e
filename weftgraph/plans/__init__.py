"""The registered queries, by area; each module has QUERIES and ORACLE_SQL."""

from __future__ import annotations

from importlib import import_module

AREAS = ("search", "linking", "building", "graph", "compat", "changes", "reports", "composing", "extraction", "watch")


def modules():
    return [import_module(f"{__name__}.{a}") for a in AREAS]
