"""Schedules, stops on the network, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.operators import network, schedule, snapping
from haltwise.plans.bindings import CALENDAR, EXCEPTIONS, LINKS, NODES, ROUTE_LINKS, STOP_TIMES, STOPS, Tables, r
from haltwise.plans.registry import registry

QUERIES, ORACLES, query = registry()

_DAYS = f"""c AS ({CALENDAR}), x AS ({EXCEPTIONS}), u AS (SELECT service_id, start_date, end_date, unnest([0, 1, 2, 3, 4, 5, 6]) AS dow, unnest([sunday, monday, tuesday, wednesday, thursday, friday, saturday]) AS on_ FROM c),
d AS (SELECT service_id, unnest(generate_series(start_date::TIMESTAMP, end_date::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM c),
s AS ((SELECT d.service_id, d.date FROM d JOIN u ON u.service_id = d.service_id AND u.dow = dayofweek(d.date) AND on_ UNION SELECT service_id, date FROM x WHERE exception_type = 1) EXCEPT SELECT service_id, date FROM x WHERE exception_type = 2)"""


@query(f"WITH {_DAYS} SELECT service_id, count(*)::BIGINT AS n_days, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day, md5(string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY date)) AS days_md5 FROM s GROUP BY service_id")
def service_dates(t: Tables) -> DataFrame:
    out = schedule.service_dates(t.sql(CALENDAR), t.sql(EXCEPTIONS))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select("service_id", F.size("dates").cast("long").alias("n_days"), day(F.element_at("dates", 1)).alias("first_day"), day(F.element_at("dates", -1)).alias("last_day"), F.md5(F.array_join(F.transform("dates", day), ",")).alias("days_md5"))


_TRIPS = "SELECT o_orderkey AS trip_id, o_custkey AS service_id, CAST(o_orderkey % 2 AS INT) AS direction_id, CAST(o_custkey % 5 AS STRING) AS route, CAST(o_orderkey % 1440 AS BIGINT) * 60 AS start_s FROM {orders}"


@query(f"WITH {_DAYS}, st AS ({STOP_TIMES}), t AS ({_TRIPS}), f AS (SELECT trip_id, arg_min(departure_s, stop_sequence) AS d FROM st GROUP BY 1), n AS (SELECT service_id, count(*) AS n FROM s GROUP BY 1) SELECT t.trip_id, d AS first_departure_s, coalesce(n, 0)::BIGINT AS n_days FROM t LEFT JOIN f ON f.trip_id = t.trip_id LEFT JOIN n ON n.service_id = t.service_id")
def trips_with_dates(t: Tables) -> DataFrame:
    out = schedule.trips_with_dates(t.sql(_TRIPS), t.sql(STOP_TIMES), schedule.service_dates(t.sql(CALENDAR), t.sql(EXCEPTIONS)))
    return out.select("trip_id", "first_departure_s", F.coalesce(F.size("dates"), F.lit(0)).cast("long").alias("n_days"))


@query(f"SELECT trip_id, direction_id + 1 AS direction_id FROM ({_TRIPS}) t")
def direction_ids_fixed(t: Tables) -> DataFrame:
    return schedule.fix_direction(t.sql(_TRIPS)).select("trip_id", "direction_id")


@query(f"SELECT trip_id, stop_sequence, stop_id, arrival_s - min(departure_s) OVER w AS arr_diff_s, departure_s - min(departure_s) OVER w AS dep_diff_s, round(shape_dist / max(shape_dist) OVER w, 6) AS rel_dist FROM ({STOP_TIMES}) s WINDOW w AS (PARTITION BY trip_id)")
def normalized_stop_times(t: Tables) -> DataFrame:
    return schedule.normalized_stop_times(t.sql(STOP_TIMES)).select("trip_id", "stop_sequence", "stop_id", "arr_diff_s", "dep_diff_s", r("rel_dist", 6).alias("rel_dist"))


_PATTERN = f"t AS (SELECT trip_id, string_agg(stop_id::VARCHAR, ',' ORDER BY stop_sequence) AS stops FROM ({STOP_TIMES}) s GROUP BY trip_id), p AS (SELECT stops, count(*) AS n_trips, min(trip_id) AS first_trip FROM t GROUP BY stops)"


@query(f"WITH {_PATTERN} SELECT stops, n_trips::BIGINT AS n_trips, first_trip FROM p")
def trip_stop_patterns(t: Tables) -> DataFrame:
    return schedule.stop_patterns(t.sql(STOP_TIMES)).select(F.array_join("stops", ",").alias("stops"), "n_trips", "first_trip")


def _patterns(t: Tables) -> DataFrame:
    return schedule.stop_patterns(t.sql(STOP_TIMES)).withColumn("route", (F.col("first_trip") % 5).cast("string")).withColumn("dir", F.lit(1))


@query(f"WITH {_PATTERN} SELECT stops, (first_trip % 5)::VARCHAR || '_1_' || row_number() OVER (PARTITION BY first_trip % 5 ORDER BY first_trip) AS ptid FROM p")
def pattern_ids(t: Tables) -> DataFrame:
    return schedule.pattern_ids(_patterns(t)).select(F.array_join("stops", ",").alias("stops"), "ptid")


@query(f"WITH {_PATTERN} SELECT first_trip, generate_subscripts(string_split(stops, ','), 1)::INT AS stop_seq, unnest(string_split(stops, ','))::BIGINT AS stop_id FROM p")
def pattern_stops(t: Tables) -> DataFrame:
    return schedule.pattern_stops(_patterns(t), "first_trip").select("first_trip", F.col("stop_seq").cast("int").alias("stop_seq"), "stop_id")


@query(
    f"WITH {_PATTERN}, q AS (SELECT first_trip, generate_subscripts(string_split(stops, ','), 1) AS k, unnest(string_split(stops, ','))::BIGINT AS i FROM p), l AS (SELECT first_trip, i, lead(i) OVER (PARTITION BY first_trip ORDER BY k) AS j FROM q) SELECT i AS i_stop, j AS j_stop, count(DISTINCT first_trip)::BIGINT AS n_patterns, count(*)::BIGINT AS n FROM l WHERE j IS NOT NULL GROUP BY i, j"
)
def unique_stop_pairs(t: Tables) -> DataFrame:
    return schedule.unique_stop_pairs(schedule.pattern_stops(_patterns(t), "first_trip"), "first_trip")


@query(f"SELECT route_ver_id AS ptid, row_number() OVER w AS segno, link_id, sum(length_m) OVER w - length_m AS dist_lo, sum(length_m) OVER w AS dist_hi, link_seq = 1 AS is_first, link_seq = max(link_seq) OVER (PARTITION BY route_ver_id) AS is_last FROM ({ROUTE_LINKS}) q WINDOW w AS (PARTITION BY route_ver_id ORDER BY link_seq ROWS UNBOUNDED PRECEDING)")
def pattern_segments(t: Tables) -> DataFrame:
    rows = t.sql(ROUTE_LINKS).select(F.col("route_ver_id").alias("ptid"), F.col("link_seq").alias("stop_seq"), F.lit(1).alias("path_seq"), "link_id", "length_m")
    return schedule.pattern_segments(rows).select("ptid", F.col("segno").cast("long").alias("segno"), "link_id", "dist_lo", "dist_hi", "is_first", "is_last")


_TIMED = f"SELECT trip_id, stop_sequence, CAST(floor((departure_s - min(departure_s) OVER (PARTITION BY trip_id)) / 40) AS BIGINT) AS dep_diff_s FROM ({STOP_TIMES}) s"


@query(
    f"WITH s AS ({_TIMED}), t AS (SELECT trip_id, string_agg(dep_diff_s::VARCHAR, ',' ORDER BY stop_sequence) AS d FROM s GROUP BY 1), o AS (SELECT trip_id, route AS ptid, start_s FROM ({_TRIPS}) q) SELECT ptid, d AS diffs, count(*)::BIGINT AS n_trips, string_agg(DISTINCT start_s::VARCHAR, ',' ORDER BY start_s::VARCHAR) AS starts FROM t JOIN o USING (trip_id) GROUP BY ptid, d"
)
def trip_templates(t: Tables) -> DataFrame:
    trips = t.sql(_TRIPS).select("trip_id", F.col("route").alias("ptid"), "start_s")
    out = schedule.trip_templates(trips, t.sql(_TIMED))
    return out.select("ptid", F.array_join("diffs", ",").alias("diffs"), "n_trips", F.array_join(F.array_sort(F.transform("starts", lambda s: s.cast("string"))), ",").alias("starts"))


_SPANS = "SELECT o_orderkey AS ttid, o_orderkey AS ptid, CAST(s AS INT) AS seg_lo, CAST(s + 2 AS INT) AS seg_hi, CAST(s * 100 AS DOUBLE) AS i_s, CAST(s * 100 + 150 AS DOUBLE) AS j_s FROM {orders} CROSS JOIN (VALUES (1), (3), (5)) AS v(s)"
_PSEG = f"SELECT route_ver_id AS ptid, link_seq AS segno, sum(length_m) OVER (PARTITION BY route_ver_id ORDER BY link_seq ROWS UNBOUNDED PRECEDING) - length_m AS dist_lo, sum(length_m) OVER (PARTITION BY route_ver_id ORDER BY link_seq ROWS UNBOUNDED PRECEDING) AS dist_hi FROM ({ROUTE_LINKS}) q"


@query(
    f"WITH g AS ({_PSEG}), p AS ({_SPANS}), j AS (SELECT ttid, seg_lo, segno, i_s, j_s, dist_lo, dist_hi, max(dist_hi) OVER (PARTITION BY ttid, seg_lo) AS top FROM p JOIN g ON g.ptid = p.ptid AND segno >= seg_lo AND segno < seg_hi) SELECT ttid, segno, round(i_s + (j_s - i_s) * dist_lo / nullif(top, 0), 4) AS enter_s, round((j_s - i_s) * dist_hi / nullif(top, 0), 4) AS exit_s FROM j"
)
def segment_times(t: Tables) -> DataFrame:
    return schedule.segment_times(t.sql(_PSEG), t.sql(_SPANS)).select("ttid", "segno", r("enter_s").alias("enter_s"), r("exit_s").alias("exit_s"))


_LOCAL = "timezone('Europe/Helsinki', timezone('UTC', o_orderdate))"


@query(f"SELECT DISTINCT o_custkey AS ttid, strftime({_LOCAL}, '%Y-%m-%d') AS oday, strftime({_LOCAL}, '%H:%M:%S') AS start FROM orders")
def view_trips(t: Tables) -> DataFrame:
    templates = t.table("orders").groupBy(F.col("o_custkey").alias("ttid")).agg(F.collect_set("o_orderdate").alias("starts"))
    return schedule.trips_view(templates).select("ttid", F.date_format("oday", "yyyy-MM-dd").alias("oday"), "start")


def _nearest_link(condition: str) -> str:
    """SQL: the nearest of the links that the condition allows, for each stop."""
    return f"""WITH l AS ({LINKS}), c AS (SELECT s_suppkey AS stop_id, (s_suppkey * 37) % 4000 + 0.0 AS px, (s_suppkey * 53) % 4000 + 0.0 AS py, l.* FROM supplier, l WHERE {condition}), n AS (SELECT *, least(1, greatest(0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / 1e6)) AS t FROM c),
d AS (SELECT *, sqrt((px - (x0 + t * (x1 - x0))) ** 2 + (py - (y0 + t * (y1 - y0))) ** 2) AS dist FROM n), b AS (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY round(dist, 6), link_id) AS k FROM d) SELECT stop_id, link_id, round(dist, 3) AS dist, round(t, 6) AS loc FROM b WHERE k = 1"""


def _snapped(rows: DataFrame) -> DataFrame:
    return rows.select("stop_id", "link_id", r("dist", 3).alias("dist"), r("loc", 6).alias("loc"))


@query(_nearest_link("true"))
def stops_snapped_to_network(t: Tables) -> DataFrame:
    return _snapped(snapping.snap_to_links(t.sql(STOPS).select("stop_id", "x", "y"), t.links()))


@query(_nearest_link("s_suppkey % 4 <> 0 OR link_id % 4 = 0"))
def stops_snapped_to_links_of_their_mode(t: Tables) -> DataFrame:
    links = t.links().withColumn("link_modes", F.when(F.col("link_id") % 4 == 0, F.array(F.lit("bus"), F.lit("tram"))).otherwise(F.array(F.lit("bus"))))
    return _snapped(snapping.snap_to_links(t.sql(STOPS).select("stop_id", "x", "y", "stop_mode"), links, same_mode=True))


_PLACES = "SELECT CAST(s_suppkey AS BIGINT) AS stop_id, CAST(s_suppkey % 4 AS INT) AS edge, CAST((s_suppkey * 37) % 1000 AS DOUBLE) AS place FROM {supplier}"


@query(
    f"""WITH RECURSIVE s AS ({_PLACES}), o AS (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY place, stop_id) AS k FROM s),
w AS (SELECT edge, stop_id, k, 1 AS grp, place AS anchor FROM o WHERE k = 1 UNION ALL SELECT o.edge, o.stop_id, o.k, w.grp + CASE WHEN o.place > w.anchor + 40 THEN 1 ELSE 0 END, CASE WHEN o.place > w.anchor + 40 THEN o.place ELSE w.anchor END FROM w JOIN o ON o.edge = w.edge AND o.k = w.k + 1)
SELECT edge, stop_id, grp::INT AS grp, anchor FROM w"""
)
def stop_greedy_clusters(t: Tables) -> DataFrame:
    return schedule.greedy_clusters(t.sql(_PLACES), "edge", "place", 40.0).select("edge", "stop_id", "grp", "anchor")


_CUTS = "SELECT CAST(1 + s_suppkey % 40 AS BIGINT) AS link_id, CAST(s_suppkey % 9 AS DOUBLE) / 8 AS share FROM {supplier}"


@query(
    f"WITH l AS ({LINKS}), m AS (SELECT link_id, 0.0::DOUBLE AS share FROM l UNION ALL SELECT DISTINCT link_id, share FROM ({_CUTS}) c WHERE share > 0 AND share < 1 AND link_id IN (SELECT link_id FROM l)) SELECT link_id, row_number() OVER w AS part, share AS lo, coalesce(lead(share) OVER w, 1.0) AS hi FROM m WINDOW w AS (PARTITION BY link_id ORDER BY share)"
)
def links_split_at_stops(t: Tables) -> DataFrame:
    return schedule.split_links(t.links(), t.sql(_CUTS)).select("link_id", F.col("part").cast("long").alias("part"), "lo", "hi")


@query(f"WITH q AS ({ROUTE_LINKS}), l AS (SELECT link_id AS k, x0, y0, x1, y1 FROM ({LINKS}) z), s AS (SELECT route_ver_id, link_seq, CASE WHEN link_reversed THEN x1 ELSE x0 END AS ax, CASE WHEN link_reversed THEN y1 ELSE y0 END AS ay, CASE WHEN link_reversed THEN x0 ELSE x1 END AS bx, CASE WHEN link_reversed THEN y0 ELSE y1 END AS b_y FROM q JOIN l ON l.k = q.link_id),\n"
    "v AS (SELECT route_ver_id, link_seq * 2 AS o, ax AS x, ay AS y FROM s UNION ALL SELECT route_ver_id, link_seq * 2 + 1, bx, b_y FROM s), d AS (SELECT route_ver_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS m FROM v WINDOW w AS (PARTITION BY route_ver_id ORDER BY o)) SELECT route_ver_id, round(sum(m), 3) AS length_m FROM d GROUP BY route_ver_id")
def route_lines(t: Tables) -> DataFrame:
    """Lines of routes from their links' geometries in order."""
    rows = t.sql(ROUTE_LINKS).join(t.links().select("link_id", "geom"), "link_id")
    rows = rows.withColumn("geom", F.when(F.col("link_reversed"), g.reverse(F.col("geom"))).otherwise(F.col("geom")))
    return network.line_of_links(rows.select("route_ver_id", "link_seq", "geom"), "route_ver_id").select("route_ver_id", r("length_m", 3).alias("length_m"))


@query(f"WITH n AS ({NODES}) SELECT link_id, a.rn AS source, b.rn AS target FROM ({LINKS}) l JOIN (SELECT x, y, row_number() OVER (ORDER BY x, y)::INT AS rn FROM n) a ON a.x = x0 AND a.y = y0 JOIN (SELECT x, y, row_number() OVER (ORDER BY x, y)::INT AS rn FROM n) b ON b.x = x1 AND b.y = y1")
def topology(t: Tables) -> DataFrame:
    return network.snap_topology(t.links()).select("link_id", "source", "target")


@query("SELECT n_nationkey, round(x, 3) AS x, round(y, 3) AS y, round(60 + 0.0, 3) AS distance FROM (SELECT n_nationkey, 100.0 * n_nationkey + 30 AS x, 60.0 AS y FROM nation)")
def wkt_round_trip(t: Tables) -> DataFrame:
    """Points and lines through WKT, and the distance between them."""
    n = t.table("nation")
    line = g.parse_linestring(F.lit("LINESTRING (0 0, 5000 0, 9000 0)"))
    p = g.parse_point(F.concat(F.lit("POINT ("), 100.0 * F.col("n_nationkey") + 30, F.lit(" 60)")))
    again = g.parse_linestring(g.to_wkt(line))
    return n.select("n_nationkey", r(p["x"], 3).alias("x"), r(p["y"], 3).alias("y"), r(g.distance(again, p), 3).alias("distance"))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(DISTINCT (user_id, ts))::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_hourly_counts(t: Tables) -> DataFrame:
    """Events by hour and type, as a stream run to its end."""
    from haltwise.streaming.events import hourly_counts, run_to_end

    out = run_to_end(t.spark, lambda s: hourly_counts(s, "ts", "event_type", "value"), f"{t.dir}/events.parque[t]", t.table("events").schema, keys=["hour", "event_type"])
    return out.select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", r("total", 2).alias("total"))


@query("SELECT DISTINCT user_id AS jrnid, epoch_us(ts) AS us FROM events WHERE event_type <> 'error'")
def stream_ingest(t: Tables) -> DataFrame:
    """Valid events of a stream, each (journey, time) once."""
    from haltwise.streaming.events import ingest, run_to_end

    def plan(s: DataFrame) -> DataFrame:
        rows = s.select(F.col("user_id").alias("jrnid"), F.col("ts").cast("timestamp").alias("tst"), (F.col("event_type") != "error").alias("is_ongoing"), F.lit("VP").alias("event_type"))
        return ingest(rows).select("jrnid", "tst")

    out = run_to_end(t.spark, plan, f"{t.dir}/events.parque[t]", t.table("events").schema)
    return out.select("jrnid", F.unix_micros("tst").alias("us"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
e AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS z, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, epoch_us(a) AS start_us, epoch_us(z) AS end_us, n::BIGINT AS n FROM e WHERE z <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""
)
def stream_sessions(t: Tables) -> DataFrame:
    """Runs of a user's events that the watermark has passed."""
    from haltwise.streaming.events import run_to_end, sessions

    out = run_to_end(t.spark, lambda s: sessions(s, "user_id", "ts"), f"{t.dir}/events.parque[t]", t.table("events").schema)
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
