"""All queries of the library, by section."""

from __future__ import annotations

import importlib
import pkgutil

from lagloom import plans


def _sections():
    for m in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        yield importlib.import_module(f"lagloom.plans.{m.name}")


def queries() -> dict:
    return {k: q[0] for m in _sections() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q[1] for m in _sections() for k, q in m.QUERIES.items() if q[1]}
