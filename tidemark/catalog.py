"""All queries of the library and their SQL, collected from the plan modules."""

from __future__ import annotations

import importlib

PLAN_MODULES = ("snapshot", "streams", "types", "state", "messages", "flows")


def _collect(kind: str) -> dict:
    found: dict = {}
    for name in PLAN_MODULES:
        found |= getattr(importlib.import_module(f"tidemark.plans.{name}"), kind)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
