"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_NAMES = ("percentiles", "distinctiveness", "frequencies", "top_n", "packing", "mixing", "languages")
_MODULES = [import_module(f"{__package__}.{n}_queries") for n in _NAMES]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
