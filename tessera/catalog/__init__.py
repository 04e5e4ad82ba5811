"""Registered queries with their DuckDB SQL."""

from __future__ import annotations


def _loaded():
    from . import base, coverage, records, selection  # noqa: F401

    return base


def queries() -> dict:
    return dict(_loaded().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_loaded().SQL)
