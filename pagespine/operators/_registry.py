"""How a module of queries registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def registry():
    """(queries, their SQL, a decorator that adds to both)."""
    queries, sql = {}, {}

    def query(name: str, text: str | None = None):
        def add(f):
            queries[name] = f
            if text:
                sql[name] = text
            return f

        return add

    return queries, sql, query


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
