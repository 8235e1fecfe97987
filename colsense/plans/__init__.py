"""Registered queries: each a function of (spark, sf_dir), with SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = " ".join(sql.split())
        return f

    return add


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    from . import analytics, channels, evidence, hierarchy, learning, movement, profiles, records, scoring  # noqa: F401

    return QUERIES, SQL
