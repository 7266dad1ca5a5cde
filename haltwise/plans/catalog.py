"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haltwise.plans import core_queries, editing_queries, merge_queries, network_queries, pattern_queries, raw_queries, reader_queries, rest_queries, route_queries, schedule_queries, store_queries, transfer_queries

MODULES = (core_queries, network_queries, raw_queries, schedule_queries, editing_queries, pattern_queries, merge_queries, route_queries, store_queries, rest_queries, transfer_queries, reader_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core_queries.halt_seconds_by_link(spark, sf_dir)


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.ORACLES
    return out
