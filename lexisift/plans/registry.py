"""All registered queries of the core and their SQL."""

from __future__ import annotations

from lexisift.plans import files, retrieval, skewed_keys

_MODULES = (retrieval, files, skewed_keys)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
