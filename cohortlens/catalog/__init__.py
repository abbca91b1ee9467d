"""Every operator as a query over the given tables, with its SQL counterpart."""

from __future__ import annotations

from . import cohort, evaluation, export, features, models, text, topics

MODULES = [cohort, text, features, topics, evaluation, models, export]


def all_queries() -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(module.QUERIES)
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out.update(module.SQL)
    return out
