"""Journey segments: point arrays by segment, enter and exit times, halts and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haltwise.functions.scalar import halt_code, seconds_between, to_smallint


def by_seg():
    return Window.partitionBy("jrnid").orderBy("segno")


def segment_arrays(points: DataFrame) -> DataFrame:
    """One row per journey and segment with its points in order (missing values kept)."""
    p = F.array_sort(F.collect_list(F.struct("obs_num", "tst", "loc", "spd", "drst", "represents_time_s")))
    return points.groupBy("jrnid", "segno").agg(p.alias("pts"), F.count("*").alias("n_pts"), F.sum("represents_time_s").alias("represents_time_s"), F.sum(F.when(F.col("drst"), F.col("represents_time_s"))).alias("door_open_s"))


def first_last(points: DataFrame) -> DataFrame:
    """First and last time and location of each journey's segments."""
    return points.groupBy("jrnid", "segno").agg(F.min_by("tst", "obs_num").alias("first_tst"), F.max_by("tst", "obs_num").alias("last_tst"), F.min_by("loc", "obs_num").alias("first_loc"), F.max_by("loc", "obs_num").alias("last_loc"))


def enter_exit(segments: DataFrame) -> DataFrame:
    """Interpolated times by groups of a seen segment and the unseen ones after it.

    segments: jrnid, segno, enter_x, first_ts, last_ts (seconds), first_x, last_x. An
    unseen segment refers to the group before the last seen one.
    """
    seen = F.sum(F.when(F.col("first_ts").isNull(), 0).otherwise(1)).over(by_seg().rowsBetween(Window.unboundedPreceding, 0))
    grouped = segments.withColumn("grp", seen)
    values = grouped.groupBy("jrnid", "grp").agg(*[F.min(c).alias(f"g_{c}") for c in ("first_ts", "last_ts", "first_x", "last_x")])
    w = Window.partitionBy("jrnid").orderBy("grp")
    near = values.select("jrnid", "grp", F.lag("g_last_x").over(w).alias("x0"), F.lead("g_first_x").over(w).alias("nx"), F.lag("g_last_ts").over(w).alias("t0"), F.lead("g_first_ts").over(w).alias("nt"))
    ref = grouped.join(near, ["jrnid", "grp"]).withColumn("x1", F.coalesce("first_x", "nx")).withColumn("t1", F.coalesce("first_ts", "nt"))
    enter = F.col("t0") + (F.col("enter_x") - F.col("x0")) * F.try_divide(F.col("t1") - F.col("t0"), F.col("x1") - F.col("x0"))
    done = ref.withColumn("e", enter)
    return done.select("jrnid", "segno", F.coalesce("e", "first_ts").alias("enter_ts"), F.coalesce(F.lead("e").over(by_seg()), F.col("last_ts")).alias("exit_ts")).withColumn("thru_s", F.col("exit_ts") - F.col("enter_ts"))


def time_differences(arrays: DataFrame, entered: str = "enter_tst") -> DataFrame:
    """Seconds of each point since the segment was entered, as an array."""
    return arrays.withColumn("pt_timediffs_s", F.transform("pts", lambda p: seconds_between(F.col(entered), p["tst"])))


def n_halts(arrays: DataFrame) -> DataFrame:
    """Runs of zero speed among a segment's points; a number that doesn't fit 16 bits is null."""
    pts = F.col("pts")
    starts = F.filter(pts, lambda p, i: F.coalesce(p["spd"] == 0, F.lit(False)) & ~F.coalesce(F.get(pts, i - 1)["spd"] == 0, F.lit(False)))
    return arrays.withColumn("n_halts", to_smallint(F.size(starts)))


def journey_totals(segments: DataFrame) -> DataFrame:
    """Segments, empty segments and points of each journey."""
    return segments.groupBy("jrnid").agg(F.count("*").alias("n_segs"), F.sum((F.coalesce("n_pts", F.lit(0)) == 0).cast("long")).alias("n_empty_segs"), F.sum(F.coalesce("n_pts", F.lit(0))).alias("n_pts"))


def end_codes(segments: DataFrame) -> DataFrame:
    """0 inside, 1 first, 2 last, 3 the only segment of its journey."""
    w = Window.partitionBy("jrnid")
    return segments.withColumn("end_segment", halt_code(F.col("segno") == F.min("segno").over(w), F.col("segno") == F.max("segno").over(w)))
