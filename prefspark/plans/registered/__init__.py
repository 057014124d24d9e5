"""Every registered query with the SQL that gives the same rows."""

from __future__ import annotations

from prefspark.plans.registered import curation, energy, files, fitting, pairs, selection

_MODULES = (files, curation, pairs, selection, energy, fitting)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: statement for module in _MODULES for name, statement in module.ORACLES.items()}
