"""Registered queries and, where SQL can say it, their ANSI SQL."""

from __future__ import annotations

from cohortry.catalog import adherence, bias, carts, curves, donors, hierarchy, io, models, profile

_PARTS = (adherence, hierarchy, donors, bias, profile, curves, models, io, carts)


def queries() -> dict:
    return {name: fn for part in _PARTS for name, fn in part.BOOK.queries.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.BOOK.sql.items()}
