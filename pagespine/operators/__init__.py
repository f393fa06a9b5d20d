"""The queries by area; each module has QUERIES and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

AREAS = ("pages", "records", "network", "metrics", "crawl", "observe", "tables", "verify", "compiled", "similar", "structured", "reducers", "addresses", "sequences", "references", "views")


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for area in AREAS:
        module = import_module(f"{__name__}.{area}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
