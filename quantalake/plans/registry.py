"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations


def _modules() -> list:
    from quantalake.plans import analysis, distributions, inference, summaries

    return [summaries, inference, distributions, analysis]


def queries() -> dict:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
