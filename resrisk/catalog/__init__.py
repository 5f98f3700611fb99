"""All registered queries, one module per operator group."""

from __future__ import annotations

import importlib

from .base import ORACLE, QUERIES

GROUPS = ["sources", "ordering", "evaluation", "analytics", "monitoring", "modelling", "refits", "serving", "benchmark"]


def _load() -> None:
    for group in GROUPS:
        importlib.import_module(f"{__name__}.{group}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
