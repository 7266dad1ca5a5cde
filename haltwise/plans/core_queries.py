"""Halts, traversals and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.functions import scalar
from haltwise.functions.scalar import epoch_us
from haltwise.operators import halts, matching, traversal
from haltwise.plans.bindings import EDGE_LINKS, EDGE_POINTS, JOURNEYS, LINKS, ON_LINKS, POINTS, ROUTE_LINKS, STOPS, Tables, r
from haltwise.plans.registry import registry

QUERIES, ORACLES, query = registry()

_HALTS = f"""
WITH pol AS ({ON_LINKS}),
sp AS (SELECT *, lead(tst) OVER w AS end_tst,
  (link_seq = lead(link_seq) OVER w AND location_on_link = lead(location_on_link) OVER w) OR (link_seq = lag(link_seq) OVER w AND location_on_link = lag(location_on_link) OVER w) AS halted
  FROM pol WINDOW w AS (PARTITION BY jrnid ORDER BY tst)),
hp AS (SELECT *, CASE WHEN coalesce(link_seq <> lag(link_seq) OVER w {{op}} location_on_link <> lag(location_on_link) OVER w, true) THEN 1 ELSE 0 END AS m FROM sp WHERE halted WINDOW w AS (PARTITION BY jrnid ORDER BY tst)),
gr AS (SELECT *, sum(m) OVER (PARTITION BY jrnid ORDER BY tst) AS g FROM hp),
halt AS (SELECT jrnid, min(tst) AS tst, (epoch_us(max(end_tst)) - epoch_us(min(tst))) / 1e6 AS total_s, coalesce(sum(represents_time_s) FILTER (WHERE drst), 0.0) AS door_open_s,
  coalesce(sum(represents_time_s) FILTER (WHERE NOT drst), 0.0) AS door_closed_s, sum(represents_time_s) AS represents_time_s FROM gr GROUP BY jrnid, g HAVING (epoch_us(max(end_tst)) - epoch_us(min(tst))) / 1e6 >= 3.0)
"""
_HALT_ROWS = "SELECT jrnid, epoch_us(tst) AS tst_us, round(total_s, 6) AS total_s, round(door_open_s, 4) AS door_open_s, round(door_closed_s, 4) AS door_closed_s, round(represents_time_s, 4) AS represents_time_s FROM halt"
_COMPATIBLE = _HALTS.replace("{op}", "AND")


def _halts(t: Tables, strict: bool = False) -> DataFrame:
    return halts.halts_on_journey(t.sql(ON_LINKS), strict=strict)


def _halt_rows(df: DataFrame) -> DataFrame:
    return df.select("jrnid", epoch_us(F.col("tst")).alias("tst_us"), r("total_s", 6).alias("total_s"), *[r(c).alias(c) for c in ("door_open_s", "door_closed_s", "represents_time_s")])


@query(_COMPATIBLE + _HALT_ROWS)
def halts_on_journey(t: Tables) -> DataFrame:
    return _halt_rows(_halts(t))


@query(_HALTS.replace("{op}", "OR") + _HALT_ROWS)
def halts_strict(t: Tables) -> DataFrame:
    return _halt_rows(_halts(t, strict=True))


@query(
    _COMPATIBLE
    + "SELECT link_id, count(*)::BIGINT AS n_halts, round(sum(total_s), 2) AS halt_s, round(avg(total_s), 2) AS mean_s FROM halt JOIN (SELECT jrnid, tst, link_id FROM pol) p USING (jrnid, tst) GROUP BY link_id"
)
def halt_seconds_by_link(t: Tables) -> DataFrame:
    """Where and how long vehicles halt."""
    placed = _halts(t).join(t.sql(ON_LINKS).select("jrnid", "tst", "link_id"), ["jrnid", "tst"])
    return placed.groupBy("link_id").agg(F.count("*").alias("n_halts"), r(F.sum("total_s"), 2).alias("halt_s"), r(F.avg("total_s"), 2).alias("mean_s"))


@query(
    _COMPATIBLE
    + f""", s AS ({STOPS}), l AS ({LINKS}), d AS (SELECT link_id, false AS link_reversed, length_m FROM l UNION ALL SELECT link_id, true, length_m FROM l WHERE NOT oneway)
SELECT h.jrnid, epoch_us(h.tst) AS tst_us, epoch_us(h.tst) + CAST(round(total_s * 1e6) AS BIGINT) AS end_us, round(total_s - h.represents_time_s, 4) AS unknown_s, round(total_s - door_open_s - door_closed_s, 4) AS door_unknown_s,
  p.link_id::BIGINT AS link_id, p.link_reversed, round(p.location_on_link * length_m, 4) AS location_m, s.stop_id
FROM halt h JOIN pol p ON h.jrnid = p.jrnid AND h.tst = p.tst JOIN d ON d.link_id = p.link_id AND d.link_reversed = p.link_reversed
LEFT JOIN s ON s.link_id = p.link_id AND s.link_reversed = p.link_reversed AND p.location_on_link BETWEEN s.location_on_link - radius_share AND s.location_on_link + radius_share"""
)
def halt_extended_stop_match(t: Tables) -> DataFrame:
    from haltwise.operators.network import directed

    out = halts.halts_extended(_halts(t), t.sql(ON_LINKS), directed(t.links()), t.sql(STOPS))
    return out.select("jrnid", epoch_us(F.col("tst")).alias("tst_us"), epoch_us(F.col("end_tst")).alias("end_us"), r("unknown_s").alias("unknown_s"), r("door_unknown_s").alias("door_unknown_s"), F.col("link_id").cast("long").alias("link_id"), "link_reversed", r("location_m").alias("location_m"), "stop_id")


_SECTIONS = f"SELECT route_ver_id AS section_id, link_seq, link_id, link_reversed, length_m FROM ({ROUTE_LINKS}) s"


@query(
    _COMPATIBLE
    + f""", los AS ({_SECTIONS}) SELECT section_id, h.jrnid, round(coalesce(sum(door_open_s), 0), 6) AS tot_door_open_s, round(coalesce(sum(door_closed_s), 0), 6) AS tot_door_closed_s, round(coalesce(sum(total_s) - sum(h.represents_time_s), 0), 6) AS tot_door_unknown_s
FROM halt h JOIN pol p ON h.jrnid = p.jrnid AND h.tst = p.tst JOIN los ON los.link_id = p.link_id AND los.link_reversed = p.link_reversed GROUP BY section_id, h.jrnid"""
)
def section_halt_totals(t: Tables) -> DataFrame:
    out = halts.section_halt_totals(_halts(t), t.sql(ON_LINKS), t.sql(_SECTIONS))
    return out.select("section_id", "jrnid", *[r(c, 6).alias(c) for c in ("tot_door_open_s", "tot_door_closed_s", "tot_door_unknown_s")])


_ENTER = f"""
WITH p AS ({EDGE_POINTS}), jl AS ({EDGE_LINKS}),
o AS (SELECT *, row_number() OVER (PARTITION BY jrnid, link_seq ORDER BY tst, location_on_link) AS a, row_number() OVER (PARTITION BY jrnid, link_seq ORDER BY tst DESC, location_on_link DESC) AS z FROM p),
ep AS (SELECT jrnid, link_seq, min(tst) AS first_tst, max(CASE WHEN a = 1 THEN location_on_link END) AS first_loc, max(tst) AS last_tst, max(CASE WHEN z = 1 THEN location_on_link END) AS last_loc FROM o GROUP BY ALL),
c AS (SELECT jl.*, sum(length_m) OVER (PARTITION BY jl.jrnid ORDER BY jl.link_seq) - length_m AS x, first_tst, last_tst, first_loc * length_m AS first_m, last_loc * length_m AS last_m FROM jl LEFT JOIN ep USING (jrnid, link_seq)),
f AS (SELECT jrnid, link_seq, link_id, link_reversed, length_m, x, last_value(last_tst IGNORE NULLS) OVER fo AS t0, last_value(x + last_m IGNORE NULLS) OVER fo AS x0, first_value(first_tst IGNORE NULLS) OVER ba AS t1, first_value(x + first_m IGNORE NULLS) OVER ba AS x1
  FROM c WINDOW fo AS (PARTITION BY jrnid ORDER BY link_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ba AS (PARTITION BY jrnid ORDER BY link_seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT jrnid, link_seq, link_id, link_reversed, length_m, x, t1, x1, lag(t0) OVER w AS t0, lag(x0) OVER w AS x0 FROM f WINDOW w AS (PARTITION BY jrnid ORDER BY link_seq)),
e AS (SELECT *, epoch_us(t0) + CAST(round((x - x0) * ((epoch_us(t1) - epoch_us(t0)) / 1e6 / nullif(x1 - x0, 0)) * 1e6) AS BIGINT) AS t FROM i),
loj AS (SELECT jrnid, link_seq, link_id, link_reversed, length_m, t AS enter_us, lead(t) OVER (PARTITION BY jrnid ORDER BY link_seq) AS exit_us FROM e)
"""


def _entered(t: Tables) -> DataFrame:
    return traversal.enter_timestamps(t.sql(EDGE_POINTS), t.sql(EDGE_LINKS))


def _traversals(t: Tables) -> DataFrame:
    return traversal.links_on_journey(_entered(t), t.sql(EDGE_LINKS))


@query(_ENTER + "SELECT jrnid, link_seq, round(x0, 4) AS x0, epoch_us(t0) AS t0_us, round(x1, 4) AS x1, epoch_us(t1) AS t1_us, round(x, 4) AS x, round(t / 1000) AS t_ms FROM e")
def enter_timestamps_interpolated(t: Tables) -> DataFrame:
    return _entered(t).select("jrnid", "link_seq", r("x0").alias("x0"), epoch_us(F.col("t0")).alias("t0_us"), r("x1").alias("x1"), epoch_us(F.col("t1")).alias("t1_us"), r("x").alias("x"), F.round(epoch_us(F.col("t")) / 1000).alias("t_ms"))


@query(_ENTER + "SELECT jrnid, link_seq, link_id, link_reversed, round(enter_us / 1000) AS enter_ms, round(exit_us / 1000) AS exit_ms FROM loj WHERE enter_us IS NOT NULL AND exit_us IS NOT NULL")
def links_on_journey(t: Tables) -> DataFrame:
    return _traversals(t).select("jrnid", "link_seq", "link_id", "link_reversed", F.round(epoch_us(F.col("enter_tst")) / 1000).alias("enter_ms"), F.round(epoch_us(F.col("exit_tst")) / 1000).alias("exit_ms"))


@query(_ENTER + "SELECT jrnid, 5::BIGINT AS n_expected, count(CASE WHEN enter_us IS NOT NULL AND exit_us IS NOT NULL THEN 1 END)::BIGINT AS n_found FROM loj GROUP BY jrnid")
def traversal_report(t: Tables) -> DataFrame:
    out = traversal.traversal_report(_traversals(t), t.sql(EDGE_LINKS))
    return out.select("jrnid", F.col("n_expected").cast("long").alias("n_expected"), F.col("n_found").cast("long").alias("n_found"))


_STATS = (
    _ENTER
    + """, st AS (SELECT link_id, link_reversed, jrnid, link_seq, length_m, (exit_us - enter_us) / 1e6 AS s FROM loj WHERE enter_us IS NOT NULL AND exit_us IS NOT NULL)
"""
)


@query(_STATS + "SELECT link_id, link_reversed, count(*)::BIGINT AS n, count(CASE WHEN s <> 0 THEN 1 END)::BIGINT AS n_speed, round(avg(3.6 * length_m / nullif(s, 0)), 3) + 0.0 AS mean_speed_kmh, round(stddev_samp(3.6 * length_m / nullif(s, 0)), 3) AS sd_speed_kmh, round(sum(length_m), 2) AS metres FROM st GROUP BY ALL")
def link_speed_stats(t: Tables) -> DataFrame:
    """Traversals and mean speed of each directed link."""
    stats = _traversals(t).join(t.sql(EDGE_LINKS).select("jrnid", "link_seq", "length_m"), ["jrnid", "link_seq"])
    speed = scalar.kmh(F.col("length_m"), scalar.seconds_between(F.col("enter_tst"), F.col("exit_tst")))
    rows = stats.select("link_id", "link_reversed", speed.alias("speed_kmh"), F.col("length_m").alias("link_length_m"))
    counts = rows.groupBy("link_id", "link_reversed").agg(F.count("speed_kmh").alias("n_speed"))
    return traversal.link_speed_summary(rows).join(counts, ["link_id", "link_reversed"]).select("link_id", "link_reversed", "n", "n_speed", (r("mean_speed_kmh", 3) + 0.0).alias("mean_speed_kmh"), r("sd_speed_kmh", 3).alias("sd_speed_kmh"), r("metres", 2).alias("metres"))


_SECTION_OF_LINKS = "SELECT CAST(s AS BIGINT) AS section_id, CAST(k AS INT) AS link_seq, CAST(1 + (s + k) % 40 AS BIGINT) AS link_id, (s + k) % 2 = 0 AS link_reversed FROM (VALUES (1), (5), (9), (30)) AS a(s) CROSS JOIN (VALUES (1), (2), (3)) AS b(k)"


@query(
    _ENTER
    + f""", los AS ({_SECTION_OF_LINKS}), ok AS (SELECT * FROM loj WHERE enter_us IS NOT NULL AND exit_us IS NOT NULL), last AS (SELECT section_id, max(link_seq) AS m FROM los GROUP BY 1)
SELECT i.section_id, a.jrnid, round(a.enter_us / 1000) AS enter_ms, round(b.exit_us / 1000) AS exit_ms, round((b.exit_us - a.enter_us) / 1e6, 2) AS duration_s
FROM los i JOIN last ON last.section_id = i.section_id JOIN los j ON j.section_id = i.section_id AND j.link_seq = last.m AND i.link_seq = 1
JOIN ok a ON a.link_id = i.link_id AND a.link_reversed = i.link_reversed JOIN ok b ON b.link_id = j.link_id AND b.link_reversed = j.link_reversed AND a.jrnid = b.jrnid"""
)
def section_traversal(t: Tables) -> DataFrame:
    out = traversal.section_traversals(_traversals(t), t.sql(_SECTION_OF_LINKS))
    return out.select("section_id", "jrnid", F.round(epoch_us(F.col("section_enter_tst")) / 1000).alias("enter_ms"), F.round(epoch_us(F.col("section_exit_tst")) / 1000).alias("exit_ms"), r("section_duration_s", 2).alias("duration_s"))


_LOCAL = "timezone('Europe/Helsinki', timezone('UTC', start_tst))"


@query(
    f"""WITH j AS ({JOURNEYS}), p AS ({POINTS}), pol AS (SELECT * FROM ({ON_LINKS}) q WHERE obs_id % 5 <> 0),
h AS ({_COMPATIBLE} SELECT jrnid FROM halt),
c AS (SELECT p.jrnid, p.tst, p.represents_time_s, pol.link_seq FROM p LEFT JOIN pol ON p.jrnid = pol.jrnid AND p.tst = pol.tst),
v AS (SELECT jrnid, count(tst) AS n, count(link_seq) AS np, min(tst) AS a, max(tst) AS z, sum(represents_time_s) AS tr, sum(CASE WHEN link_seq IS NULL THEN 0 ELSE represents_time_s END) AS ol FROM c GROUP BY jrnid)
SELECT j.jrnid, route, dir, strftime({_LOCAL}, '%Y-%m-%d') AS oday, strftime({_LOCAL}, '%H:%M:%S') AS start, n::BIGINT AS n_hfp_point, np::BIGINT AS n_point_on_link, epoch_us(a) AS first_us, epoch_us(z) AS last_us,
  round((epoch_us(z) - epoch_us(a)) / 1e6, 4) AS total_duration_s, round(tr, 3) AS total_represents_s, round(ol, 3) AS on_link_represents_s, (SELECT count(*) FROM h WHERE h.jrnid = j.jrnid)::BIGINT AS n_halts,
  (SELECT count(*) FROM ({EDGE_LINKS}) e WHERE e.jrnid = j.jrnid)::BIGINT AS n_link_on_route, (SELECT count(*) FROM ({EDGE_LINKS}) e WHERE e.jrnid = j.jrnid AND link_seq % 2 = e.jrnid % 2)::BIGINT AS n_link_on_journey
FROM j JOIN v ON v.jrnid = j.jrnid"""
)
def journey_stats(t: Tables) -> DataFrame:
    pol = t.sql(ON_LINKS)
    links = t.sql(EDGE_LINKS)
    out = traversal.journey_stats(t.sql(JOURNEYS), traversal.points_combined(t.sql(POINTS), pol.where("obs_id % 5 <> 0")), links, links.where("link_seq % 2 = jrnid % 2"), _halts(t))
    return out.select(
        "jrnid", "route", "dir", "oday", "start", "n_hfp_point", "n_point_on_link", epoch_us(F.col("first_tst")).alias("first_us"), epoch_us(F.col("last_tst")).alias("last_us"),
        r("total_duration_s").alias("total_duration_s"), r("total_represents_s", 3).alias("total_represents_s"), r("on_link_represents_s", 3).alias("on_link_represents_s"), *[F.coalesce(c, F.lit(0)).cast("long").alias(a) for c, a in (("n_halt_on_journey", "n_halts"), ("n_link_on_route", "n_link_on_route"), ("n_link_on_journey", "n_link_on_journey"))],
    )


@query(f"WITH j AS ({JOURNEYS}) SELECT jrnid AS veh_id, md5(route || '_' || dir || '_' || strftime({_LOCAL}, '%Y-%m-%d_%H:%M:%S') || '_' || oper || '_' || veh) AS jrnid FROM j")
def journey_md5_ids(t: Tables) -> DataFrame:
    j = t.sql(JOURNEYS)
    return j.select(F.col("jrnid").alias("veh_id"), scalar.journey_id(F.col("route"), F.col("dir"), F.col("start_tst"), F.col("oper"), F.col("veh")).alias("jrnid"))


_ASOF = "SELECT c_custkey AS route, CAST(1 AS INT) AS dir, CAST(max(o_orderdate) AS DATE) AS oday FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey"


@query(
    """WITH v AS (SELECT o_custkey AS route, o_orderkey AS route_ver_id, CAST(o_orderdate AS DATE) AS valid_from, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS valid_until FROM orders),
q AS (SELECT c_custkey AS route, CAST(max(o_orderdate) AS DATE) AS oday FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
SELECT q.route, route_ver_id, strftime(oday, '%Y-%m-%d') AS oday FROM q JOIN v ON v.route = q.route AND oday >= valid_from AND (valid_until IS NULL OR oday < valid_until)"""
)
def journey_route_version_asof(t: Tables) -> DataFrame:
    from haltwise.plans.bindings import VERSIONS

    out = matching.route_versions_asof(t.sql(_ASOF), t.sql(VERSIONS), ("route", "dir"), "oday")
    return out.select("route", "route_ver_id", F.date_format("oday", "yyyy-MM-dd").alias("oday"))


@query("SELECT jrnid, link_seq, epoch_us(min(tst)) AS first_us, epoch_us(max(tst)) AS last_us, min(CASE WHEN a = 1 THEN location_on_link END) AS first_loc, min(CASE WHEN z = 1 THEN location_on_link END) AS last_loc FROM (SELECT *, row_number() OVER (PARTITION BY jrnid, link_seq ORDER BY tst, location_on_link) AS a, row_number() OVER (PARTITION BY jrnid, link_seq ORDER BY tst DESC, location_on_link DESC) AS z FROM (" + EDGE_POINTS + ") p) GROUP BY jrnid, link_seq")
def first_last_by_time(t: Tables) -> DataFrame:
    out = traversal.edge_points(t.sql(EDGE_POINTS))
    return out.select("jrnid", "link_seq", epoch_us(F.col("first_tst")).alias("first_us"), epoch_us(F.col("last_tst")).alias("last_us"), "first_loc", "last_loc")
