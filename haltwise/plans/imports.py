"""The cleaning of raw positions from end to end, as one distributed job over all routes and days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from haltwise.operators import rawpoints
from haltwise.sources.folders import Steps
from haltwise.sources.store import Store

LOG = "step string, status string, n_rows long, message string, started timestamp, finished timestamp"


@dataclass
class Imported:
    journeys: DataFrame
    rejected: DataFrame
    points: DataFrame


def import_positions(raw: DataFrame, schedule: DataFrame, max_spd: float = 28.0, min_acc: float = -5.0, max_acc: float = 5.0, cut: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Imported:
    """Cleans positions, makes journeys, judges them, and keeps the points of good ones less the redundant.

    raw: jrnid, route, dir, start_tst, tst, obs_id, odo, drst, x, y; schedule: route, dir, start_tst, ttid, ptid.
    Route, direction and start of a journey are those of its earliest point. `cut` may write what is read more than once.
    """
    moved = rawpoints.movement_values(rawpoints.obs_numbers(raw))
    clean = cut(rawpoints.drop_invalid_movement(rawpoints.dedup_by_time(moved), max_spd, min_acc, max_acc), "clean")
    about = clean.groupBy("jrnid").agg(F.min_by(F.struct("route", "dir", "start_tst"), F.struct("tst", "obs_id")).alias("_a")).select("jrnid", "_a.*")
    journeys = rawpoints.extract_journeys(clean).join(about, "jrnid").join(schedule, ["route", "dir", "start_tst"], "left").withColumn("invalid_reasons", F.array().cast("array<string>"))
    for reason, condition in rawpoints.journey_rules():
        journeys = rawpoints.invalidate(journeys, reason, condition)
    good, bad = rawpoints.split_invalid(cut(journeys, "judged"))
    points = rawpoints.mark_redundant(clean.join(good.select("jrnid", "ptid"), "jrnid")).where("NOT is_redundant")
    return Imported(good, bad, points)


def run_import(raw: DataFrame, schedule: DataFrame, folder: str, **limits: float) -> DataFrame:
    """The import as a job: adds to the tables journeys, rejected and points of a store, all or none, and returns its log.

    A step that fails is logged with its message, the steps after it are not tried, and what the steps before it have
    written goes: a store's reader sees whole imports only. The log is added to import_log, whatever happened.
    """
    spark = raw.sparkSession
    steps = Steps(spark)
    log: list[tuple] = []
    now = lambda: dt.datetime.now(dt.timezone.utc)
    started, step = now(), "clean"
    try:
        made = import_positions(raw, schedule, cut=steps.write, **limits)
        log.append((step, "done", None, None, started, now()))
        with Store(spark, folder).transaction() as tx:
            for step, table in vars(made).items():
                started = now()
                seen = Observation()
                tx.append(step, table.observe(seen, F.count(F.lit(1)).alias("n")))
                log.append((step, "done", seen.get["n"], None, started, now()))
            step, started = "commit", now()
    except (PySparkException, OSError, Py4JError) as e:
        log = [(done, "undone" if done != "clean" else status, *rest) for done, status, *rest in log]
        log.append((step, "failed", None, str(e), started, now()))
    steps.drop(*[t for _, t in list(steps.paths.values())])
    out = spark.createDataFrame(log, LOG)
    out.coalesce(1).write.mode("append").parquet(f"{folder}/import_log")
    return out


def has_pattern(patterns: DataFrame, route: str) -> bool:
    """Whether a route has any pattern."""
    return not patterns.where(F.col("route") == route).isEmpty()
