"""Table operations: filling, conflict handling, replacement, import logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haltwise.functions.scalar import seconds_between


def fill(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """ffill: the last known value up to a row; bfill: the first known from it on. One sort serves both."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("ffill", F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("bfill", F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def insert_ignore(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current plus the new rows whose key it lacks."""
    return current.unionByName(new.join(current.select(*keys), keys, "left_anti").select(*current.columns))


def replace_keys(current: DataFrame, keys: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """current with all rows of the keys replaced by the new ones."""
    return current.join(keys.select(*on).distinct(), on, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def step_durations(log: DataFrame, session: str, time: str, tie: str) -> DataFrame:
    """Seconds since the step before and since the session's first."""
    w = Window.partitionBy(session).orderBy(time, tie)
    first = F.min(time).over(Window.partitionBy(session))
    return log.withColumn("step_s", F.coalesce(seconds_between(F.lag(time).over(w), F.col(time)), F.lit(0.0))).withColumn("total_s", seconds_between(first, F.col(time)))


def log_step(log: DataFrame, session: int, step: str, route: str | None = None, day: str | None = None) -> DataFrame:
    """log with one more step, stamped now."""
    row = log.sparkSession.range(1).select(F.lit(session).cast("long").alias("session_id"), F.current_timestamp().alias("ts"), F.lit(step).alias("step"), F.lit(route).cast("string").alias("route"), F.lit(day).cast("date").alias("oday"))
    return log.unionByName(row)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite_days(df: DataFrame, path: str, day: str, sort: list[str]) -> None:
    """Writes by day, replacing just the days that df has, rows in the order that later reads want."""
    df.sortWithinPartitions(*sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def xy_view(points: DataFrame, geom: str = "geom") -> DataFrame:
    """Points with plain x and y in place of their geometry."""
    return points.withColumn("x", F.col(geom)["x"]).withColumn("y", F.col(geom)["y"]).drop(geom)


def union_lines(**by_mode: DataFrame) -> DataFrame:
    """Lines of several modes as one table; the same line of one mode once."""
    out = None
    for mode, lines in sorted(by_mode.items()):
        part = lines.withColumn("mode", F.lit(mode)).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def truncate_order(references: dict[str, list[str]]) -> list[str]:
    """Tables in the order in which they can be emptied: those that refer to others before these. references: table, what it refers to."""
    order: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError(f"tables refer to each other: {' -> '.join([*path, name])}")
        if name not in order:
            for other in references.get(name, []):
                visit(other, (*path, name))
            order.append(name)

    for name in sorted(references):
        visit(name, ())
    return order[::-1]


def truncate_tables(spark: SparkSession, folder: str, references: dict[str, list[str]]) -> list[str]:
    """Empties the tables of a folder in that order, schemas kept; returns the order."""
    order = truncate_order(references)
    for name in order:
        path = f"{folder}/{name}"
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return order
