"""Registered queries: Spark callables and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("retrieval", "evidence", "grounding", "ingest", "tables", "events")


def _collect(name: str) -> dict:
    merged: dict = {}
    for module in _MODULES:
        merged.update(getattr(import_module(f"{__name__}.{module}"), name))
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
