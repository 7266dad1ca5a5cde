"""Raw vehicle positions: cleaning, journeys, redundancy, and matching to segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.functions.scalar import seconds_between
from haltwise.operators.walks import walk


def by_time():
    return Window.partitionBy("jrnid").orderBy("tst", "obs_id")


def by_obs():
    return Window.partitionBy("jrnid").orderBy("obs_num")
REQUIRED = ("event_type", "dir", "oper", "veh", "tst", "lat", "lon", "oday", "start", "route")


def drop_invalid(raw: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Rows of ongoing journeys, of position events, with all required fields."""
    return raw.where("is_ongoing AND event_type = 'VP'").dropna(subset=list(required))


def obs_numbers(raw: DataFrame) -> DataFrame:
    return raw.withColumn("obs_num", F.row_number().over(by_time()))


def movement_values(points: DataFrame) -> DataFrame:
    """dodo, dx, spd, acc and hdg from the point before; the first point looks ahead instead."""
    first = F.col("obs_num") == 1
    near = lambda c, f: f(c).over(by_time())
    x0, y0 = F.when(first, F.col("x")).otherwise(near("x", F.lag)), F.when(first, F.col("y")).otherwise(near("y", F.lag))
    x1, y1 = F.when(first, near("x", F.lead)).otherwise(F.col("x")), F.when(first, near("y", F.lead)).otherwise(F.col("y"))
    seconds = F.when(first, seconds_between(F.col("tst"), near("tst", F.lead))).otherwise(seconds_between(near("tst", F.lag), F.col("tst")))
    moved = points.withColumn("_dt", seconds).withColumn("_a", g.point(x0, y0)).withColumn("_b", g.point(x1, y1))
    moved = moved.withColumn("dx", g.hypot(F.col("_a"), F.col("_b"))).withColumn("hdg", F.degrees(g.azimuth(F.col("_a"), F.col("_b")))).withColumn("spd", F.try_divide("dx", "_dt"))
    acc = F.try_divide(F.col("spd") - F.coalesce(F.lag("spd").over(by_time()), F.lit(0.0)), F.col("_dt"))
    dodo = F.coalesce(F.col("odo") - F.lag("odo").over(by_time()), F.lit(0)).cast("double")
    return moved.withColumn("acc", acc).withColumn("dodo", dodo).drop("_dt", "_a", "_b")


def dedup_by_time(points: DataFrame) -> DataFrame:
    """One point per journey and time: the largest dodo, then the smallest speed (missing last), then the first."""
    order = Window.partitionBy("jrnid", "tst").orderBy(F.col("dodo").desc_nulls_first(), F.col("spd").asc_nulls_last(), F.col("obs_num"))
    return points.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def drop_invalid_movement(points: DataFrame, max_spd: float = 28.0, min_acc: float = -5.0, max_acc: float = 5.0) -> DataFrame:
    """Drops points too fast or too abrupt against the last point that was kept; values are set anew for the others.

    The state is the last kept row. Points go by in order, so a task holds a batch of them and not a whole journey.
    """
    names = points.columns
    at = {c: i for i, c in enumerate(names)}

    def step(last: tuple | None, r: dict) -> tuple[tuple, tuple | None]:
        here = [r[c] for c in ("x", "y", "tst", "odo", "spd")]
        row = [r[c] for c in names]
        if last is None:
            return here, tuple(row)
        px, py, pt, podo, pspd = last
        x, y, t, odo, _ = here
        dx = None if None in (x, y, px, py) else ((x - px) ** 2 + (y - py) ** 2) ** 0.5
        dt = None if None in (t, pt) else (t - pt).total_seconds()
        v = dx / dt if dx is not None and dt else None
        a = (v - (pspd or 0.0)) / dt if v is not None else None
        if v is not None and (v > max_spd or a < min_acc or a > max_acc):
            return last, None
        for c, value in (("dodo", None if None in (odo, podo) else float(odo - podo)), ("dx", dx), ("spd", v), ("acc", a)):
            row[at[c]] = value
        return [x, y, t, odo, v], tuple(row)

    return walk(points, "jrnid", ["obs_num"], step, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema))


def extract_journeys(points: DataFrame) -> DataFrame:
    """One row per journey: counts, spans and distances for the quality rules."""
    return points.groupBy("jrnid").agg(
        F.count("*").alias("n_obs"),
        F.sum(F.col("drst").cast("long")).alias("n_dropen"),
        F.min("tst").alias("first_tst"),
        F.max("tst").alias("last_tst"),
        F.min("odo").alias("min_odo"),
        F.max("odo").alias("max_odo"),
        F.sum((F.col("dodo") < 0).cast("long")).alias("n_neg_dodo"),
        F.sum("dx").alias("raw_distance"),
    )


def invalidate(df: DataFrame, reason: str, condition: Column, column: str = "invalid_reasons") -> DataFrame:
    """Adds a reason, once, where the condition holds; an unknown condition is no reason."""
    have = F.coalesce(F.col(column), F.array().cast("array<string>"))
    hit = F.coalesce(condition, F.lit(False)) & ~F.array_contains(have, reason)
    return df.withColumn(column, F.when(hit, F.array_append(have, F.lit(reason))).otherwise(have))


def propagate_invalidations(source: DataFrame, target: DataFrame, keys: list[str], name: str, column: str = "invalid_reasons") -> DataFrame:
    """Marks rows of target that share a key with an invalid row of source."""
    bad = source.where(F.size(F.coalesce(F.col(column), F.array().cast("array<string>"))) > 0).select(*keys).distinct().withColumn("_bad", F.lit(True))
    return invalidate(target.join(bad, keys, "left"), f"Invalid records in {name}", F.col("_bad"), column).drop("_bad")


def journey_rules() -> list[tuple[str, Column]]:
    """The quality rules of journeys and their limits."""
    seconds = seconds_between(F.col("first_tst"), F.col("last_tst"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return [
        ("NULL ttid", F.col("ttid").isNull()),
        ("Too few observations vs. tst span", rate(F.col("n_obs"), seconds) < 0.5),
        ("Too little odometer sum vs. cumulative GPS distance", rate(F.col("max_odo") - F.col("min_odo"), F.col("raw_distance")) < 0.5),
        ("Non-increasing odometer values", F.col("n_neg_dodo") > 0),
        ("Defect door status: open in > 50 % of obs", F.try_divide(F.col("n_dropen"), F.col("n_obs")) > 0.5),
    ]


def match_rules() -> list[tuple[str, Column]]:
    """The rule of journeys after their points have been matched to segments."""
    return [("No valid segment matches", F.coalesce("n_segs", F.lit(0)) == 0)]


def judge_matches(journeys: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(journeys with matched segments and their number n_segs, those without with the reason added). segments: jrnid, one row a segment."""
    counted = journeys.drop("n_segs").join(segments.groupBy("jrnid").agg(F.count("*").alias("n_segs")), "jrnid", "left").withColumn("n_segs", F.coalesce("n_segs", F.lit(0)))
    for reason, condition in match_rules():
        counted = invalidate(counted, reason, condition)
    return split_invalid(counted)


def odometer_groups(points: DataFrame) -> DataFrame:
    """Points with the rank of their odometer value within the journey (equal values share one) and how many have it."""
    by_odo = Window.partitionBy("jrnid").orderBy("odo")
    return points.withColumn("odogroup", F.rank().over(by_odo)).withColumn("n_in_odogroup", F.count("*").over(Window.partitionBy("jrnid", "odo")))


def split_invalid(df: DataFrame, column: str = "invalid_reasons") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    bad = F.size(F.coalesce(F.col(column), F.array().cast("array<string>"))) > 0
    return df.where(~bad), df.where(bad)


def mark_redundant(points: DataFrame) -> DataFrame:
    """is_redundant: odometer and doors as both neighbours have them; n_rdnt_after: how many follow the point at a run's start."""
    same = lambda c: F.lag(c).over(by_obs()).eqNullSafe(F.col(c)) & F.lead(c).over(by_obs()).eqNullSafe(F.col(c))
    marked = points.withColumn("is_redundant", same("odo") & same("drst"))
    opens = (F.col("is_redundant") & ~F.lag("is_redundant").over(by_obs())).cast("int")
    grouped = marked.withColumn("_new", F.coalesce(opens, F.lit(0))).withColumn("_grp", F.sum("_new").over(by_obs()))
    runs = grouped.where("is_redundant").groupBy("jrnid", "_grp").agg(F.count("*").alias("n_rdnt_after"), (F.min("obs_num") - 1).alias("obs_num")).drop("_grp")
    return grouped.drop("_new", "_grp").join(runs, ["jrnid", "obs_num"], "left").withColumn("n_rdnt_after", F.coalesce("n_rdnt_after", F.lit(0)))


def geometric_medians(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """For each group of points, given one after the other with their sizes (at least 1), the point with the least sum of distances; NaN where a place is unknown.

    From the mean, Newton's steps, halved as often as it helps, or Weiszfeld's where those are better. The point nearest to a step is the median
    itself if the unit vectors from it to the others add up to no more than the points there. It ends where the sum of unit vectors
    times the reach of the points, which bounds what the sum of distances can still lose, is below a hundredth of a millimetre.
    All groups take a step together, and those that have ended are left out of the next.
    """
    p, sizes = np.stack([x, y]).astype(float), np.asarray(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    centre = np.add.reduceat(p, starts, axis=1) / sizes if len(sizes) else np.empty((2, 0))
    centre[:, ~np.isfinite(centre).all(axis=0)] = np.nan
    left, of = np.arange(len(sizes)), np.repeat(np.arange(len(sizes)), sizes)

    def keep(groups: np.ndarray) -> None:
        """Goes on with the groups that are marked."""
        nonlocal p, sizes, starts, left, of
        p, sizes, left = p[:, groups[of]], sizes[groups], left[groups]
        starts, of = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int), np.repeat(np.arange(len(sizes)), sizes)

    def total(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, starts, axis=-1)

    def pulls(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distances, their inverse and 0 at the place itself, unit vectors, sums of those)"""
        to = p - c[:, of]
        d = np.hypot(*to)
        k = np.divide(1.0, d, out=np.zeros_like(d), where=d > 0)
        return d, k, to * k, total(to * k)

    keep(~np.isnan(centre[0]))
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(steps):
            if not len(left):
                break
            c = centre[:, left]
            d, k, _, pull = pulls(c)
            ended = np.hypot(*pull) * np.maximum.reduceat(d, starts) < 1e-5
            near = np.flatnonzero(d == np.minimum.reduceat(d, starts)[of])
            own = p[:, near[np.unique(of[near], return_index=True)[1]]]
            od, _, _, opull = pulls(own)
            is_own = ~ended & (np.hypot(*opull) <= total((od == 0).astype(float)))
            centre[:, left[is_own]] = own[:, is_own]
            keep(~ended & ~is_own)
            if not len(left):
                break
            c = centre[:, left]
            d, k, u, pull = pulls(c)
            here, sk = total((d == 0).astype(float)), total(k)
            xx, xy, yy = total(u[1] ** 2 * k), total(-u[0] * u[1] * k), total(u[0] ** 2 * k)
            det = xx * yy - xy**2
            turn = np.stack([yy * pull[0] - xy * pull[1], xx * pull[1] - xy * pull[0]]) / det
            turn[:, ~(np.abs(det) > 1e-12 * sk**2)] = np.nan
            best = c + pull / sk
            least = total(np.hypot(*(p - best[:, of])))
            for i in range(12):
                there = c + turn / 2**i
                far = total(np.hypot(*(p - there[:, of])))
                best, least = np.where(far < least, there, best), np.where(far < least, far, least)
            # At a point that isn't the median, only the pull beyond the points there moves it.
            part = np.where(here > 0, np.maximum(0.0, 1 - here / np.maximum(np.hypot(*pull), 1e-300)), 1.0)
            centre[:, left] = np.where(here > 0, c + part * (best - c), best)
    return centre[0], centre[1]


def geometric_median(xs: list[float], ys: list[float], steps: int = 200) -> tuple[float, float]:
    """The point with the least sum of distances to those of one group."""
    x, y = geometric_medians(np.asarray(xs, dtype=float), np.asarray(ys, dtype=float), np.array([len(xs)]), steps)
    return float(x[0]), float(y[0])


def _centres(points: pa.Array) -> pa.Array:
    """The medians of a batch of groups, each a list of places."""
    places = points.flatten()
    x, y = (places.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    return pa.StructArray.from_arrays([pa.array(v, mask=np.isnan(v)) for v in geometric_medians(x, y, points.value_lengths().to_numpy(zero_copy_only=False))], ["x", "y"])


def halt_clusters(points: DataFrame, min_points: int = 2) -> DataFrame:
    """Points of one odometer value in a journey, at least min_points, with their geometric median."""

    n = F.count("*").over(Window.partitionBy("jrnid", "odo"))
    some = points.withColumn("n_points", n).where(F.col("n_points") >= min_points)
    place = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    collected = some.groupBy("jrnid", "odo").agg(F.count("*").alias("n_points"), F.min("obs_num").alias("first_obs"), F.sort_array(F.collect_list(place)).alias("_p"))
    return collected.withColumn("centre", F.arrow_udf(_centres, "x double, y double")("_p")).drop("_p")


def move_halted(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """points with those of a cluster at its centre, halt_offset how far they were from it, and their old place."""
    at = clusters.select("jrnid", "odo", F.col("centre.x").alias("_cx"), F.col("centre.y").alias("_cy"))
    met = points.withColumns({"old_x": F.col("x"), "old_y": F.col("y")}).join(at, ["jrnid", "odo"], "left")
    offset = F.hypot(F.col("old_x") - F.col("_cx"), F.col("old_y") - F.col("_cy"))
    return met.withColumns({"x": F.coalesce("_cx", "x"), "y": F.coalesce("_cy", "y"), "halt_offset": offset}).drop("_cx", "_cy")


def segment_candidates(points: DataFrame, segments: DataFrame, metres: float = 20.0) -> DataFrame:
    """Points with their candidate segments, nearest first: array of (dist, segno, hdg, loc).

    points: jrnid, obs_num, ptid, x, y; segments: ptid, segno, geom.
    """
    n = g.nearest(F.col("geom"), g.point(F.col("x"), F.col("y")))
    boxed = segments.withColumn("_box", g.box(F.col("geom")))
    pairs = points.join(boxed, "ptid").where(g.near_box(F.col("_box"), F.col("x"), F.col("y"), metres)).withColumn("_n", n).where(F.col("_n.distance") <= metres)
    heading = F.degrees(g.azimuth(g.start_point(F.col("geom")), g.end_point(F.col("geom"))))
    c = F.struct(F.col("_n.distance").alias("dist"), "segno", heading.alias("hdg"), F.coalesce(F.try_divide(F.col("_n.along"), g.length(F.col("geom"))), F.lit(0.0)).alias("loc"))
    found = pairs.groupBy("jrnid", "obs_num").agg(F.array_sort(F.collect_list(c)).alias("candidates"))
    return points.join(found, ["jrnid", "obs_num"], "left")


def best_match_segments(points: DataFrame) -> DataFrame:
    """segno of each point, walking a journey in order.

    The first point with candidates takes the smallest segment. Then candidates
    0 or 1 after the last come first, then those not at a segment's end, then
    those with a heading less than 90 degrees off (an unknown heading counts
    before both), then the nearest.
    """

    def turned(c: float | None, r: float | None) -> int:
        if c is None or r is None:
            return -1
        d = abs(c - r)
        return int((d - 180 if d > 180 else d) >= 90)

    def step(last: int | None, r: dict) -> tuple[int | None, tuple]:
        def rank(c: dict) -> tuple:
            return not 0 <= c["segno"] - last <= 1, not 0 < c["loc"] < 1, turned(c["hdg"], r["hdg"]), c["dist"], c["segno"]

        found = r["candidates"]
        chosen = None if not found else min(c["segno"] for c in found) if last is None else min(map(rank, found))[-1]
        return (last if chosen is None else chosen), (r["jrnid"], r["obs_num"], chosen)

    rows = points.where(F.col("candidates").isNotNull()).select("jrnid", F.col("obs_num").cast("int").alias("obs_num"), F.col("hdg").cast("double").alias("hdg"), "candidates")
    return walk(rows, "jrnid", ["obs_num"], step, f"jrnid {points.schema['jrnid'].dataType.simpleString()}, obs_num int, segno int")


def visit_groups(matched: DataFrame) -> DataFrame:
    """Runs of one segment in a journey with their first and last point, size, and priority among visits of that segment."""
    changed = (~F.col("segno").eqNullSafe(F.lag("segno").over(by_obs()))).cast("int")
    grouped = matched.withColumn("_c", changed).withColumn("grp", F.sum("_c").over(by_obs()))
    runs = grouped.groupBy("jrnid", "grp", "segno").agg(F.min("obs_num").alias("first_obs"), F.max("obs_num").alias("last_obs"), F.count("*").alias("n"))
    return runs.withColumn("prio", F.dense_rank().over(Window.partitionBy("jrnid", "segno").orderBy(F.col("n").desc())))


def failed_visits(matched: DataFrame) -> DataFrame:
    """Visits to discard: before the journey's smallest segment, going backwards, or ahead with a lower priority."""
    runs = visit_groups(matched)
    w = Window.partitionBy("jrnid")
    suspect = runs.withColumn("_m", F.max("prio").over(w)).withColumn("_min", F.min("segno").over(w)).where("_m > 1")

    def step(last: int | None, r: dict) -> tuple[int | None, tuple | None]:
        to = r["segno"]  # a run without a segment never fits
        ok = to is not None and (to <= r["low"] if last is None else (to > last and r["prio"] == 1) or to == last)
        return (to, None) if ok else (last, (r["jrnid"], r["first_obs"], r["last_obs"]))

    rows = suspect.select("jrnid", "grp", F.col("segno").cast("int").alias("segno"), "prio", F.col("first_obs").cast("int").alias("first_obs"), F.col("last_obs").cast("int").alias("last_obs"), F.col("_min").cast("int").alias("low"))
    return walk(rows, "jrnid", ["grp"], step, f"jrnid {matched.schema['jrnid'].dataType.simpleString()}, first_obs int, last_obs int")


def discard_failed(matched: DataFrame) -> DataFrame:
    """Matched points without those of failed visits."""
    bad = failed_visits(matched).select("jrnid", F.explode(F.sequence("first_obs", "last_obs")).alias("obs_num"))
    return matched.join(bad, ["jrnid", "obs_num"], "left_anti")


def linear_movement(points: DataFrame) -> DataFrame:
    """dx and seconds to the next point, and speed from the one before, along the route. points: jrnid, obs_num, tst, abs_loc."""
    nxt = lambda c: F.lead(c).over(by_obs())
    prev = lambda c: F.lag(c).over(by_obs())
    return points.select(
        "jrnid",
        "obs_num",
        (nxt("abs_loc") - F.col("abs_loc")).alias("dx_m"),
        seconds_between(F.col("tst"), nxt("tst")).alias("dur_s"),
        F.try_divide(F.col("abs_loc") - prev("abs_loc"), seconds_between(prev("tst"), F.col("tst"))).alias("spd_m_s"),
    )
