"""Raw positions, segments, functions and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.functions import scalar
from haltwise.functions.scalar import epoch_us
from haltwise.operators import rawpoints, segments, tables
from haltwise.plans.bindings import ON_LINKS, POINTS, Tables, r
from haltwise.plans.registry import registry

QUERIES, ORACLES, query = registry()

_RAW = f"SELECT p.*, obs_id % 13 <> 0 AS is_ongoing, CASE WHEN obs_id % 17 = 0 THEN 'DOO' ELSE 'VP' END AS event_type, CASE WHEN obs_id % 19 = 0 THEN NULL ELSE CAST(1 AS INT) END AS dir FROM ({POINTS}) p"


@query(f"SELECT obs_id, jrnid FROM ({_RAW}) q WHERE is_ongoing AND event_type = 'VP' AND dir IS NOT NULL AND x IS NOT NULL")
def raw_filter_invalid(t: Tables) -> DataFrame:
    return rawpoints.drop_invalid(t.sql(_RAW), ("event_type", "dir", "tst", "x")).select("obs_id", "jrnid")


_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY jrnid ORDER BY tst, obs_id) AS obs_num FROM ({POINTS}) p"


def _numbered(t: Tables) -> DataFrame:
    return rawpoints.obs_numbers(t.sql(POINTS))


@query(f"SELECT obs_id, jrnid, obs_num::BIGINT AS obs_num FROM ({_NUMBERED}) q")
def raw_obs_nums(t: Tables) -> DataFrame:
    return _numbered(t).select("obs_id", "jrnid", F.col("obs_num").cast("long").alias("obs_num"))


_MOVED = f"""n AS ({_NUMBERED}), a AS (SELECT *, CASE WHEN obs_num = 1 THEN x ELSE lag(x) OVER w END AS ax, CASE WHEN obs_num = 1 THEN y ELSE lag(y) OVER w END AS ay, CASE WHEN obs_num = 1 THEN lead(x) OVER w ELSE x END AS bx, CASE WHEN obs_num = 1 THEN lead(y) OVER w ELSE y END AS by_,
  CASE WHEN obs_num = 1 THEN (epoch_us(lead(tst) OVER w) - epoch_us(tst)) / 1e6 ELSE (epoch_us(tst) - epoch_us(lag(tst) OVER w)) / 1e6 END AS dt FROM n WINDOW w AS (PARTITION BY jrnid ORDER BY tst, obs_id)),
b AS (SELECT *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS dx, CASE WHEN ax = bx AND ay = by_ THEN NULL ELSE (degrees(atan2(bx - ax, by_ - ay)) + 360) % 360 END AS hdg FROM a),
c AS (SELECT *, dx / nullif(dt, 0) AS spd FROM b),
m AS (SELECT *, (spd - coalesce(lag(spd) OVER w, 0)) / nullif(dt, 0) AS acc, coalesce(odo - lag(odo) OVER w, 0)::DOUBLE AS dodo FROM c WINDOW w AS (PARTITION BY jrnid ORDER BY tst, obs_id))"""


def _moved(t: Tables) -> DataFrame:
    return rawpoints.movement_values(_numbered(t))


@query(f"WITH {_MOVED} SELECT obs_id, round(dx, 3) AS dx, round(hdg, 3) AS hdg, round(spd, 5) AS spd, round(acc, 5) AS acc, dodo FROM m")
def raw_movement_values(t: Tables) -> DataFrame:
    return _moved(t).select("obs_id", r("dx", 3).alias("dx"), r("hdg", 3).alias("hdg"), r("spd", 5).alias("spd"), r("acc", 5).alias("acc"), "dodo")


@query(f"WITH {_MOVED}, q AS (SELECT *, row_number() OVER (PARTITION BY jrnid, date_trunc('day', tst) ORDER BY dodo DESC NULLS FIRST, spd ASC NULLS LAST, obs_num) AS k FROM m) SELECT obs_id, jrnid FROM q WHERE k = 1")
def raw_dedup_by_tst(t: Tables) -> DataFrame:
    """One point for each journey and (coarsened) time."""
    return rawpoints.dedup_by_time(_moved(t).withColumn("tst", F.date_trunc("day", "tst"))).select("obs_id", "jrnid")


@query(
    f"""WITH RECURSIVE {_MOVED}, z AS (SELECT jrnid, obs_num, obs_id, x, y, epoch_us(tst) / 1e6 AS t, odo::DOUBLE AS odo, spd FROM m),
f AS (SELECT jrnid, obs_num, obs_id, true AS kept, x, y, t, odo, spd FROM z WHERE obs_num = 1
UNION ALL SELECT jrnid, obs_num, obs_id, ok, CASE WHEN ok THEN nx ELSE x END, CASE WHEN ok THEN ny ELSE y END, CASE WHEN ok THEN nt ELSE t END, CASE WHEN ok THEN no ELSE odo END, CASE WHEN ok THEN v ELSE spd END
 FROM (SELECT *, NOT (coalesce(v, 0) > 0.02 OR coalesce((v - coalesce(spd, 0)) / nullif(nt - t, 0), 0) < -5 OR coalesce((v - coalesce(spd, 0)) / nullif(nt - t, 0), 0) > 5) AS ok
   FROM (SELECT z.jrnid, z.obs_num, z.obs_id, f.x, f.y, f.t, f.odo, f.spd, z.x AS nx, z.y AS ny, z.t AS nt, z.odo AS no, sqrt((z.x - f.x) ** 2 + (z.y - f.y) ** 2) / nullif(z.t - f.t, 0) AS v FROM f JOIN z ON z.jrnid = f.jrnid AND z.obs_num = f.obs_num + 1)))
SELECT obs_id, jrnid, round(spd, 6) AS spd FROM f WHERE kept"""
)
def raw_drop_invalid_movement(t: Tables) -> DataFrame:
    """Fast points against the last kept one."""
    return rawpoints.drop_invalid_movement(_moved(t), max_spd=0.02).select("obs_id", "jrnid", r("spd", 6).alias("spd"))


_JRN = f"WITH {_MOVED}, j AS (SELECT jrnid, count(*) AS n_obs, sum(CASE WHEN drst THEN 1 WHEN NOT drst THEN 0 END) AS n_dropen, min(tst) AS a, max(tst) AS z, min(odo) AS mi, max(odo) AS mx, sum(CASE WHEN dodo < 0 THEN 1 ELSE 0 END) AS n_neg, sum(dx) AS dist, CASE WHEN jrnid % 9 = 0 THEN NULL ELSE 'tt' END AS ttid FROM m GROUP BY jrnid)"


def _extracted(t: Tables) -> DataFrame:
    return rawpoints.extract_journeys(_moved(t)).withColumn("ttid", F.when(F.col("jrnid") % 9 == 0, F.lit(None)).otherwise(F.lit("tt"))).withColumn("invalid_reasons", F.array().cast("array<string>"))


@query(_JRN + " SELECT jrnid, n_obs::BIGINT AS n_obs, n_dropen::BIGINT AS n_dropen, epoch_us(a) AS first_us, epoch_us(z) AS last_us, mx - mi AS odo_length, n_neg::BIGINT AS n_neg_dodo, round(dist, 3) AS raw_distance FROM j")
def journeys_from_raw(t: Tables) -> DataFrame:
    return _extracted(t).select("jrnid", "n_obs", "n_dropen", epoch_us(F.col("first_tst")).alias("first_us"), epoch_us(F.col("last_tst")).alias("last_us"), scalar.range_length(F.col("min_odo"), F.col("max_odo")).alias("odo_length"), "n_neg_dodo", r("raw_distance", 3).alias("raw_distance"))


_REASONS = """concat_ws('|', CASE WHEN ttid IS NULL THEN 'NULL ttid' END, CASE WHEN coalesce(n_obs / nullif((epoch_us(z) - epoch_us(a)) / 1e6, 0), 0) < 0.5 THEN 'Too few observations vs. tst span' END,
 CASE WHEN coalesce((mx - mi) / nullif(dist, 0), 0) < 0.5 THEN 'Too little odometer sum vs. cumulative GPS distance' END, CASE WHEN n_neg > 0 THEN 'Non-increasing odometer values' END, CASE WHEN n_dropen / n_obs > 0.5 THEN 'Defect door status: open in > 50 % of obs' END)"""


def _judged(t: Tables) -> DataFrame:
    out = _extracted(t)
    for reason, condition in rawpoints.journey_rules():
        out = rawpoints.invalidate(out, reason, condition)
    return out


@query(_JRN + f" SELECT jrnid, {_REASONS} AS reasons FROM j")
def journey_quality_invalidations(t: Tables) -> DataFrame:
    return _judged(t).select("jrnid", F.array_join("invalid_reasons", "|").alias("reasons"))


@query(_JRN + f" SELECT m.obs_id, CASE WHEN ttid IS NULL THEN 'Invalid records in journeys' ELSE '' END AS reasons FROM m JOIN j ON j.jrnid = m.jrnid")
def propagate_invalidations(t: Tables) -> DataFrame:
    bad = rawpoints.invalidate(_extracted(t), "NULL ttid", F.col("ttid").isNull())
    points = t.sql(POINTS).withColumn("invalid_reasons", F.array().cast("array<string>"))
    return rawpoints.propagate_invalidations(bad, points, ["jrnid"], "journeys").select("obs_id", F.array_join("invalid_reasons", "|").alias("reasons"))


_ODO = f"SELECT *, CAST(floor(obs_num / 6) AS BIGINT) AS odo2, CASE WHEN obs_num % 11 = 0 THEN NULL ELSE obs_num % 23 > 3 END AS dr2 FROM ({_NUMBERED}) n"


def _slow(t: Tables) -> DataFrame:
    return _numbered(t).withColumn("odo", F.floor(F.col("obs_num") / 6)).withColumn("drst", F.when(F.col("obs_num") % 11 == 0, F.lit(None)).otherwise(F.col("obs_num") % 23 > 3))


@query(
    f"""WITH a AS ({_ODO}), b AS (SELECT *, NOT (lag(odo2) OVER w IS DISTINCT FROM odo2 OR lead(odo2) OVER w IS DISTINCT FROM odo2 OR lag(dr2) OVER w IS DISTINCT FROM dr2 OR lead(dr2) OVER w IS DISTINCT FROM dr2) AS red FROM a WINDOW w AS (PARTITION BY jrnid ORDER BY obs_num)),
c AS (SELECT *, CASE WHEN red AND NOT lag(red) OVER (PARTITION BY jrnid ORDER BY obs_num) THEN 1 ELSE 0 END AS ng FROM b), d AS (SELECT *, sum(ng) OVER (PARTITION BY jrnid ORDER BY obs_num) AS grp FROM c),
e AS (SELECT jrnid, grp, count(*) AS n, min(obs_num) - 1 AS o FROM d WHERE red GROUP BY jrnid, grp) SELECT d.obs_id, red AS is_redundant, coalesce(n, 0)::BIGINT AS n_rdnt_after FROM d LEFT JOIN e ON e.jrnid = d.jrnid AND e.o = d.obs_num"""
)
def redundant_points(t: Tables) -> DataFrame:
    return rawpoints.mark_redundant(_slow(t)).select("obs_id", "is_redundant", F.col("n_rdnt_after").cast("long").alias("n_rdnt_after"))


@query(f"WITH a AS ({_ODO}) SELECT jrnid, odo2 AS odo, count(*)::BIGINT AS n_points, min(obs_num)::BIGINT AS first_obs, true AS is_better_than_mean FROM a GROUP BY jrnid, odo2 HAVING count(*) >= 3")
def halt_clusters(t: Tables) -> DataFrame:
    """Points at one odometer value; the sum of their distances to the geometric median is no larger than to the mean."""
    points = _slow(t)
    clusters = rawpoints.halt_clusters(points, 3)
    mean = points.groupBy("jrnid", "odo").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    far = rawpoints.move_halted(points, clusters).join(mean, ["jrnid", "odo"]).where("halt_offset IS NOT NULL")
    sums = far.groupBy("jrnid", "odo").agg((F.sum("halt_offset") <= F.sum(F.hypot(F.col("old_x") - F.col("mx"), F.col("old_y") - F.col("my"))) + 1e-6).alias("is_better_than_mean"))
    return clusters.join(sums, ["jrnid", "odo"]).select("jrnid", "odo", "n_points", F.col("first_obs").cast("long").alias("first_obs"), "is_better_than_mean")


@query(f"WITH a AS ({_ODO}), n AS (SELECT *, count(*) OVER (PARTITION BY jrnid, odo2) AS c FROM a) SELECT obs_id, c >= 3 AS is_moved FROM n")
def halted_points_moved(t: Tables) -> DataFrame:
    """All points, those at one odometer value moved to their geometric median."""
    points = _slow(t)
    return rawpoints.move_halted(points, rawpoints.halt_clusters(points, 3)).select("obs_id", F.col("halt_offset").isNotNull().alias("is_moved"))


_SEGMENTS = "SELECT CAST(k AS INT) AS segno, CAST(p AS INT) AS ptid, CAST(k * 500 AS DOUBLE) AS x0, CAST(p * 900 AS DOUBLE) AS y0, CAST(k * 500 + 500 AS DOUBLE) AS x1, CAST(p * 900 AS DOUBLE) AS y1 FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) AS a(k) CROSS JOIN (VALUES (0), (1), (2)) AS b(p)"


def _candidates(t: Tables) -> DataFrame:
    segs = t.sql(_SEGMENTS).withColumn("geom", g.make_line(g.point(F.col("x0"), F.col("y0")), g.point(F.col("x1"), F.col("y1"))))
    points = _numbered(t).withColumn("ptid", (F.col("jrnid") % 3).cast("int")).withColumn("hdg", F.when(F.col("obs_num") % 4 == 0, F.lit(None)).otherwise((F.col("obs_num") * 7 % 360).cast("double")))
    return rawpoints.segment_candidates(points, segs.select("ptid", "segno", "geom"), 700.0)


_CAND = f"""p AS (SELECT *, x AS px, y AS py, CASE WHEN obs_num % 4 = 0 THEN NULL ELSE (obs_num * 7 % 360)::DOUBLE END AS hdg FROM ({_NUMBERED}) n), s AS ({_SEGMENTS}),
c AS (SELECT jrnid, obs_num, obs_id, p.hdg, segno, least(1, greatest(0, (px - x0) / (x1 - x0))) AS loc, sqrt((px - (x0 + least(1, greatest(0, (px - x0) / (x1 - x0))) * (x1 - x0))) ** 2 + (py - y0) ** 2) AS dist FROM p JOIN s ON s.ptid = p.jrnid % 3),
k AS (SELECT * FROM c WHERE dist <= 700)"""


@query(f"WITH {_CAND} SELECT obs_id, count(*)::BIGINT AS n, string_agg(segno::VARCHAR, ',' ORDER BY dist, segno) AS segnos, round(min(dist), 3) AS nearest FROM k GROUP BY obs_id")
def segment_candidates(t: Tables) -> DataFrame:
    out = _candidates(t).where(F.col("candidates").isNotNull())
    return out.select("obs_id", F.size("candidates").cast("long").alias("n"), F.array_join(F.transform("candidates", lambda c: c["segno"]), ",").alias("segnos"), F.round(F.get("candidates", 0)["dist"], 3).alias("nearest"))


@query(
    f"""WITH RECURSIVE {_CAND}, q AS (SELECT jrnid, obs_num, hdg, list({{'segno': segno, 'loc': loc, 'dist': dist}} ORDER BY dist, segno) AS cs, row_number() OVER (PARTITION BY jrnid ORDER BY obs_num) AS o FROM k GROUP BY jrnid, obs_num, hdg),
w AS (SELECT jrnid, o, obs_num, (SELECT min(u.c.segno) FROM (SELECT unnest(cs) AS c) u) AS segno FROM q WHERE o = 1
UNION ALL SELECT q.jrnid, q.o, q.obs_num, (SELECT u.c.segno FROM (SELECT unnest(q.cs) AS c) u ORDER BY (u.c.segno - w.segno BETWEEN 0 AND 1) DESC NULLS FIRST, (u.c.loc > 0 AND u.c.loc < 1) DESC NULLS FIRST,
  (CASE WHEN abs(90.0 - q.hdg) > 180 THEN abs(90.0 - q.hdg) - 180 ELSE abs(90.0 - q.hdg) END < 90) DESC NULLS FIRST, u.c.dist, u.c.segno LIMIT 1) FROM w JOIN q ON q.jrnid = w.jrnid AND q.o = w.o + 1)
SELECT jrnid, obs_num::BIGINT AS obs_num, segno FROM w"""
)
def best_match_segments(t: Tables) -> DataFrame:
    return rawpoints.best_match_segments(_candidates(t)).select("jrnid", F.col("obs_num").cast("long").alias("obs_num"), "segno")


_VISITS = f"SELECT jrnid, obs_num, CAST(1 + (floor(obs_num / 3) + (obs_num * jrnid) % 4) % 5 AS INT) AS segno FROM ({_NUMBERED}) n"
_RUNS = f"""v AS ({_VISITS}), a AS (SELECT *, CASE WHEN segno IS DISTINCT FROM lag(segno) OVER (PARTITION BY jrnid ORDER BY obs_num) THEN 1 ELSE 0 END AS ch FROM v), b AS (SELECT *, sum(ch) OVER (PARTITION BY jrnid ORDER BY obs_num) AS grp FROM a),
runs AS (SELECT jrnid, grp, segno, min(obs_num) AS lo, max(obs_num) AS hi, count(*) AS n FROM b GROUP BY ALL), pr AS (SELECT *, dense_rank() OVER (PARTITION BY jrnid, segno ORDER BY n DESC) AS prio FROM runs)"""


@query(f"WITH {_RUNS} SELECT jrnid, grp::BIGINT AS grp, segno, lo::BIGINT AS first_obs, hi::BIGINT AS last_obs, prio::BIGINT AS prio FROM pr")
def visit_groups(t: Tables) -> DataFrame:
    out = rawpoints.visit_groups(t.sql(_VISITS))
    return out.select("jrnid", *[F.col(c).cast("long").alias(c) for c in ("grp",)], "segno", *[F.col(c).cast("long").alias(c) for c in ("first_obs", "last_obs", "prio")])


@query(
    f"""WITH RECURSIVE {_RUNS}, s AS (SELECT *, max(prio) OVER (PARTITION BY jrnid) AS mp, min(segno) OVER (PARTITION BY jrnid) AS low FROM pr), u AS (SELECT *, row_number() OVER (PARTITION BY jrnid ORDER BY grp) AS o FROM s WHERE mp > 1),
w AS (SELECT jrnid, o, lo, hi, segno <= low AS ok, CASE WHEN segno <= low THEN segno END AS last FROM u WHERE o = 1
UNION ALL SELECT jrnid, o, lo, hi, ok, CASE WHEN ok THEN segno ELSE last END FROM (SELECT u.jrnid, u.o, u.lo, u.hi, u.segno, w.last, CASE WHEN w.last IS NULL THEN u.segno <= u.low ELSE (u.segno > w.last AND u.prio = 1) OR u.segno = w.last END AS ok FROM w JOIN u ON u.jrnid = w.jrnid AND u.o = w.o + 1))
SELECT v.jrnid, v.obs_num::BIGINT AS obs_num, v.segno FROM v WHERE NOT EXISTS (SELECT 1 FROM w WHERE NOT ok AND w.jrnid = v.jrnid AND v.obs_num BETWEEN lo AND hi)"""
)
def failed_seg_matches(t: Tables) -> DataFrame:
    """Points left after failed visits are discarded."""
    return rawpoints.discard_failed(t.sql(_VISITS)).select("jrnid", F.col("obs_num").cast("long").alias("obs_num"), "segno")


_LINEAR = f"SELECT jrnid, obs_num, tst, CAST(odo AS DOUBLE) * 10 + location_on_link AS abs_loc FROM (SELECT *, row_number() OVER (PARTITION BY jrnid ORDER BY tst, obs_id) AS obs_num FROM ({ON_LINKS}) p) n"


@query(f"SELECT jrnid, obs_num::BIGINT AS obs_num, round(lead(abs_loc) OVER w - abs_loc, 4) AS dx_m, round((epoch_us(lead(tst) OVER w) - epoch_us(tst)) / 1e6, 6) AS dur_s, round((abs_loc - lag(abs_loc) OVER w) / nullif((epoch_us(tst) - epoch_us(lag(tst) OVER w)) / 1e6, 0), 7) AS spd_m_s FROM ({_LINEAR}) q WINDOW w AS (PARTITION BY jrnid ORDER BY obs_num)")
def linear_movement(t: Tables) -> DataFrame:
    out = rawpoints.linear_movement(t.sql(_LINEAR))
    return out.select("jrnid", F.col("obs_num").cast("long").alias("obs_num"), r("dx_m").alias("dx_m"), r("dur_s", 6).alias("dur_s"), r("spd_m_s", 7).alias("spd_m_s"))


_SEG_POINTS = f"SELECT jrnid, CAST(link_seq AS INT) AS segno, row_number() OVER (PARTITION BY jrnid ORDER BY tst, obs_id) AS obs_num, tst, location_on_link AS loc, CASE WHEN obs_id % 3 = 0 THEN CAST(0 AS DOUBLE) WHEN obs_id % 7 = 0 THEN NULL ELSE x END AS spd, drst, represents_time_s FROM ({ON_LINKS}) p"


@query(f"SELECT jrnid, segno, count(*)::BIGINT AS n_pts, string_agg(coalesce(spd::INT::VARCHAR, '-'), ',' ORDER BY obs_num) AS speeds, round(sum(represents_time_s), 3) AS represents_time_s, round(sum(CASE WHEN drst THEN represents_time_s END), 3) AS door_open_s FROM (SELECT * REPLACE (CASE WHEN spd IS NULL THEN NULL ELSE floor(spd) END AS spd) FROM ({_SEG_POINTS}) q) GROUP BY jrnid, segno")
def journey_segments_arrays(t: Tables) -> DataFrame:
    out = segments.segment_arrays(t.sql(_SEG_POINTS).withColumn("spd", F.floor("spd").cast("double")))
    speeds = F.array_join(F.transform("pts", lambda p: F.coalesce(p["spd"].cast("int").cast("string"), F.lit("-"))), ",")
    return out.select("jrnid", "segno", "n_pts", speeds.alias("speeds"), r("represents_time_s", 3).alias("represents_time_s"), r("door_open_s", 3).alias("door_open_s"))


@query(f"SELECT jrnid, segno, epoch_us(min(tst)) AS first_us, epoch_us(max(tst)) AS last_us, arg_min(loc, obs_num) AS first_loc, arg_max(loc, obs_num) AS last_loc FROM ({_SEG_POINTS}) q GROUP BY jrnid, segno")
def seg_first_last(t: Tables) -> DataFrame:
    out = segments.first_last(t.sql(_SEG_POINTS))
    return out.select("jrnid", "segno", epoch_us(F.col("first_tst")).alias("first_us"), epoch_us(F.col("last_tst")).alias("last_us"), "first_loc", "last_loc")


_SEG_ENTER = """SELECT o_custkey AS jrnid, CAST(s AS INT) AS segno, CAST((s - 1) * 100 AS DOUBLE) AS enter_x,
 CASE WHEN (o_custkey + s) % 3 = 0 THEN NULL ELSE CAST(s * 60 + o_custkey % 7 AS DOUBLE) END AS first_ts, CASE WHEN (o_custkey + s) % 3 = 0 THEN NULL ELSE CAST(s * 60 + 30 + o_custkey % 7 AS DOUBLE) END AS last_ts,
 CASE WHEN (o_custkey + s) % 3 = 0 THEN NULL ELSE CAST((s - 1) * 100 + 10 AS DOUBLE) END AS first_x, CASE WHEN (o_custkey + s) % 3 = 0 THEN NULL ELSE CAST((s - 1) * 100 + 80 AS DOUBLE) END AS last_x
FROM (SELECT DISTINCT o_custkey FROM {orders}) c CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7)) AS v(s)"""


@query(
    f"""WITH s AS ({_SEG_ENTER}), g AS (SELECT *, sum(CASE WHEN first_ts IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY jrnid ORDER BY segno) AS grp FROM s), v AS (SELECT jrnid, grp, min(first_ts) AS a, min(last_ts) AS b, min(first_x) AS c, min(last_x) AS d FROM g GROUP BY ALL),
n AS (SELECT jrnid, grp, lag(d) OVER w AS x0, lead(c) OVER w AS nx, lag(b) OVER w AS t0, lead(a) OVER w AS nt FROM v WINDOW w AS (PARTITION BY jrnid ORDER BY grp)),
e AS (SELECT g.*, t0 + (enter_x - x0) * (coalesce(first_ts, nt) - t0) / nullif(coalesce(first_x, nx) - x0, 0) AS e FROM g JOIN n USING (jrnid, grp)), f AS (SELECT jrnid, segno, coalesce(e, first_ts) AS enter_ts, coalesce(lead(e) OVER (PARTITION BY jrnid ORDER BY segno), last_ts) AS exit_ts FROM e)
SELECT jrnid, segno, round(enter_ts, 4) AS enter_ts, round(exit_ts, 4) AS exit_ts, round(exit_ts - enter_ts, 4) AS thru_s FROM f"""
)
def seg_enter_exit(t: Tables) -> DataFrame:
    return segments.enter_exit(t.sql(_SEG_ENTER)).select("jrnid", "segno", *[r(c).alias(c) for c in ("enter_ts", "exit_ts", "thru_s")])


@query(f"WITH q AS ({_SEG_POINTS}), e AS (SELECT *, min(tst) OVER (PARTITION BY jrnid, segno) AS en FROM q) SELECT jrnid, segno, string_agg(((epoch_us(tst) - epoch_us(en)) // 1000)::VARCHAR, ',' ORDER BY obs_num) AS diffs_ms FROM e GROUP BY jrnid, segno")
def seg_timediffs(t: Tables) -> DataFrame:
    arrays = segments.segment_arrays(t.sql(_SEG_POINTS)).withColumn("entered", F.array_min(F.transform("pts", lambda p: p["tst"])))
    out = segments.time_differences(arrays, "entered")
    return out.select("jrnid", "segno", F.array_join(F.transform("pt_timediffs_s", lambda s: F.floor(F.round(s * 1e6) / 1000).cast("long")), ",").alias("diffs_ms"))


@query(f"SELECT jrnid, segno, sum(h)::BIGINT AS n_halts FROM (SELECT jrnid, segno, CASE WHEN spd = 0 AND lag(spd) OVER (PARTITION BY jrnid, segno ORDER BY obs_num) IS DISTINCT FROM 0 THEN 1 ELSE 0 END AS h FROM ({_SEG_POINTS}) q) GROUP BY jrnid, segno")
def seg_n_halts(t: Tables) -> DataFrame:
    return segments.n_halts(segments.segment_arrays(t.sql(_SEG_POINTS))).select("jrnid", "segno", F.col("n_halts").cast("long").alias("n_halts"))


_SEG_COUNTS = f"SELECT jrnid, segno, CASE WHEN segno % 3 = 0 THEN NULL ELSE count(*) END AS n_pts FROM ({_SEG_POINTS}) q GROUP BY jrnid, segno"


@query(f"SELECT jrnid, count(*)::BIGINT AS n_segs, sum(CASE WHEN coalesce(n_pts, 0) = 0 THEN 1 ELSE 0 END)::BIGINT AS n_empty_segs, sum(coalesce(n_pts, 0))::BIGINT AS n_pts FROM ({_SEG_COUNTS}) c GROUP BY jrnid")
def seg_aggregates(t: Tables) -> DataFrame:
    return segments.journey_totals(t.sql(_SEG_COUNTS))


@query(f"SELECT jrnid, segno, (CASE WHEN segno = min(segno) OVER w THEN 1 ELSE 0 END + CASE WHEN segno = max(segno) OVER w THEN 2 ELSE 0 END)::INT AS end_segment FROM ({_SEG_COUNTS}) c WINDOW w AS (PARTITION BY jrnid)")
def seg_end_codes(t: Tables) -> DataFrame:
    return segments.end_codes(t.sql(_SEG_COUNTS)).select("jrnid", "segno", "end_segment")


# Functions.
@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderpriority = '1-URGENT' THEN '1-URGENT' ELSE '1-URGENT,' || o_orderpriority END ELSE 'a,b,' || o_orderpriority END AS errors FROM orders")
def append_unique(t: Tables) -> DataFrame:
    o = t.table("orders")
    have = F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("array<string>")).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("1-URGENT"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return o.select("o_orderkey", F.array_join(scalar.append_unique(have, F.col("o_orderpriority")), ",").alias("errors"))


@query("SELECT event_id, round(CASE WHEN abs(value - k) > 180 THEN abs(value - k) - 180 ELSE abs(value - k) END, 6) AS angle, round(CASE WHEN abs(value - k) > 180 THEN 360 - abs(value - k) ELSE abs(value - k) END, 6) AS strict_angle FROM (SELECT event_id, value % 360 AS value, CASE WHEN event_type = 'error' THEN NULL ELSE (event_id * 7 % 360)::DOUBLE END AS k FROM events)")
def minimum_angle(t: Tables) -> DataFrame:
    e = t.table("events").select("event_id", (F.col("value") % 360).alias("a"), F.when(F.col("event_type") == "error", F.lit(None)).otherwise((F.col("event_id") * 7 % 360).cast("double")).alias("b"))
    return e.select("event_id", F.round(scalar.minimum_angle(F.col("a"), F.col("b")), 6).alias("angle"), F.round(scalar.minimum_angle(F.col("a"), F.col("b"), strict=True), 6).alias("strict_angle"))


@query("SELECT event_id, round(value + (event_id - user_id) * (2 * value - value) / nullif((event_id % 5 + user_id) - user_id, 0), 4) AS y FROM events")
def linear_interpolate(t: Tables) -> DataFrame:
    e, c = t.table("events"), F.col
    return e.select("event_id", F.round(scalar.linear_interpolate(c("event_id"), c("user_id"), c("value"), c("event_id") % 5 + c("user_id"), 2 * c("value")), 4).alias("y"))


@query("SELECT c_custkey, max(o_orderkey) - min(o_orderkey) AS key_length, epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate)) AS us_length FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def range_lengths(t: Tables) -> DataFrame:
    rows = t.table("customer").join(t.table("orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey")
    return rows.agg(scalar.range_length(F.min("o_orderkey"), F.max("o_orderkey")).alias("key_length"), F.timestamp_diff("MICROSECOND", F.min("o_orderdate"), F.max("o_orderdate")).alias("us_length"))


@query("SELECT jrnid, link_seq, last_value(v IGNORE NULLS) OVER (PARTITION BY jrnid ORDER BY link_seq ROWS UNBOUNDED PRECEDING) AS ffill, first_value(v IGNORE NULLS) OVER (PARTITION BY jrnid ORDER BY link_seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill FROM (SELECT event_id AS link_seq, user_id AS jrnid, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)")
def fill_forwards_and_backwards(t: Tables) -> DataFrame:
    e = t.table("events").select(F.col("event_id").alias("link_seq"), F.col("user_id").alias("jrnid"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return tables.fill(e, ["jrnid"], ["link_seq"], "v").select("jrnid", "link_seq", "ffill", "bfill")


@query(
    """WITH p AS (SELECT n_nationkey AS node_id, radians(60.0 + n_nationkey / 10) AS phi, 0.0066943800229 AS e FROM nation)
SELECT node_id, 500000.0 AS east, round(0.9996 * 6378137.0 * ((1 - e / 4 - 3 * e ** 2 / 64 - 5 * e ** 3 / 256) * phi - (3 * e / 8 + 3 * e ** 2 / 32 + 45 * e ** 3 / 1024) * sin(2 * phi) + (15 * e ** 2 / 256 + 45 * e ** 3 / 1024) * sin(4 * phi) - 35 * e ** 3 / 3072 * sin(6 * phi))) AS north FROM p"""
)
def tm_projection(t: Tables) -> DataFrame:
    """Places on the grid's central meridian, against the meridian arc's series; other places are tested apart."""
    p = g.project(F.lit(27.0), 60.0 + F.col("n_nationkey") / 10)
    return t.table("nation").select(F.col("n_nationkey").alias("node_id"), F.round(p["x"], 1).alias("east"), F.round(p["y"]).alias("north"))


# Sinks and logs.
@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def insert_ignore_conflicts(t: Tables) -> DataFrame:
    o = t.table("orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return tables.insert_ignore(o.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS state FROM orders WHERE NOT (o_custkey % 4 = 0 AND o_orderkey % 2 = 1)")
def upsert_replace_keys(t: Tables) -> DataFrame:
    o = t.table("orders").select("o_orderkey", "o_custkey").withColumn("state", F.lit("old"))
    keys = o.where("o_custkey % 4 = 0").select("o_custkey")
    new = o.where("o_custkey % 4 = 0 AND o_orderkey % 2 = 0").withColumn("state", F.lit("new"))
    return tables.replace_keys(o, keys, new, ["o_custkey"])


@query("SELECT user_id AS session_id, event_id, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0) AS step_s, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6 AS total_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def log_step_durations(t: Tables) -> DataFrame:
    log = t.table("events").select(F.col("user_id").alias("session_id"), "event_id", "ts")
    return tables.step_durations(log, "session_id", "ts", "event_id").select("session_id", "event_id", "step_s", "total_s")
