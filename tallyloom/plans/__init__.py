"""Registered queries: each operator run over the test tables."""

from importlib import import_module

from tallyloom.plans.registry import QUERIES, SQL

_MODULES = ["scalars", "kpis", "quality", "shapes", "analysis", "forecasting", "people", "files"]


def _load():
    for module in _MODULES:
        import_module(f"tallyloom.plans.{module}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql():
    _load()
    return dict(SQL)
