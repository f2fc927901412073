"""The catalogue of queries: each module of plans adds its entries as name -> (query, SQL or None)."""

from __future__ import annotations

import importlib
import pkgutil

from lodeframe import plans


def _entries() -> dict:
    found: dict = {}
    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.endswith("_queries"):
            own = importlib.import_module(f"lodeframe.plans.{m.name}").ENTRIES
            if clash := found.keys() & own.keys():
                raise ValueError(f"query names given twice: {sorted(clash)}")
            found |= own
    return found


def queries() -> dict:
    return {k: v[0] for k, v in _entries().items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in _entries().items() if v[1]}
