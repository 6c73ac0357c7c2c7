"""Registered queries and their equivalent SQL, by module."""

from . import code, problems

MODULES = [problems, code]


def all_queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
