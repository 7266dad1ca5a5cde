"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haltwise.plans.bindings import Tables, duck


def registry() -> tuple[dict, dict, Callable]:
    """(queries, oracles, decorator): the decorator takes the SQL of a function of Tables."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def add(f):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(Tables(spark, sf_dir))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            queries[f.__name__] = run
            if sql is not None:
                oracles[f.__name__] = duck(sql)
            return run

        return add

    return queries, oracles, query
