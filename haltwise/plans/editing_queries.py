"""Edits of the network, and views that join it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.operators import editing, network, rawpoints, routing, segments
from haltwise.plans.bindings import LINKS, NODES, POINTS, ROUTE_LINKS, STOP_ON_ROUTE, STOPS, VERSIONS, Tables, r
from haltwise.plans.raw_queries import _SEG_ENTER, _SEGMENTS
from haltwise.plans.registry import registry

QUERIES, ORACLES, query = registry()


@query(
    f"""WITH v AS ({VERSIONS}), o AS ({STOP_ON_ROUTE}), s AS ({STOPS}), l AS ({LINKS}), d AS (SELECT link_id, false AS link_reversed, i_node, j_node, length_m FROM l UNION ALL SELECT link_id, true, j_node, i_node, length_m FROM l WHERE NOT oneway)
SELECT o.route_ver_id, stop_seq, o.stop_id, tie, strftime(valid_until, '%Y-%m-%d') AS valid_until, d.i_node, d.j_node FROM v JOIN o ON o.route_ver_id = v.route_ver_id JOIN s ON s.stop_id = o.stop_id LEFT JOIN d ON d.link_id = s.link_id AND d.link_reversed = s.link_reversed"""
)
def stop_on_route_expanded(t: Tables) -> DataFrame:
    out = network.stops_on_route(t.sql(STOP_ON_ROUTE), t.sql(VERSIONS), t.sql(STOPS), network.directed(t.links()))
    return out.select("route_ver_id", "stop_seq", "stop_id", "tie", F.date_format("valid_until", "yyyy-MM-dd").alias("valid_until"), "i_node", "j_node")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_suppkey % 20 = 3 THEN 'moved' ELSE s_name END AS s_name FROM supplier")
def manual_patches(t: Tables) -> DataFrame:
    s = t.table("supplier").select("s_suppkey", "s_acctbal", "s_name")
    fixes = s.where("s_suppkey % 10 = 3").select("s_suppkey", F.lit(0.0).alias("s_acctbal"), F.when(F.col("s_suppkey") % 20 == 3, "moved").alias("s_name"))
    return editing.patch(s, fixes, "s_suppkey")


@query(f"SELECT node_id, x, y FROM ({NODES}) n WHERE x BETWEEN 1000 AND 3000 AND y BETWEEN 0 AND 2000")
def nodes_within_box(t: Tables) -> DataFrame:
    return editing.within_box(t.sql(NODES), 1000.0, 0.0, 3000.0, 2000.0)[0]


@query(f"SELECT link_id, round(sqrt((CASE WHEN j_node % 6 = 0 THEN x1 + 30 ELSE x1 END - CASE WHEN i_node % 6 = 0 THEN x0 + 30 ELSE x0 END) ** 2 + (y1 - y0) ** 2), 3) AS moved_m FROM ({LINKS}) l")
def links_after_node_moves(t: Tables) -> DataFrame:
    """Lengths of links after every sixth node has moved along the x axis."""
    moves = t.sql(NODES).where("node_id % 6 = 0").withColumn("x", F.col("x") + 30)
    return editing.move_nodes(t.links(), moves).select("link_id", r(g.length(F.col("geom")), 3).alias("moved_m"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'x,' || s_name ELSE 'x' END AS history FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS n, s_name AS s_name FROM supplier) q")
def value_history(t: Tables) -> DataFrame:
    old = t.table("supplier").select("s_suppkey", "s_name").withColumn("h", F.array(F.lit("x")))
    new = old.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "new").otherwise(F.col("s_name")).alias("s_name"))
    out = editing.record_history(old, new, "s_suppkey", "s_name", "h")
    return out.join(old.select("s_suppkey", F.col("s_name").alias("was")), "s_suppkey").select("s_suppkey", F.col("was").alias("s_name"), F.array_join("h", ",").alias("history"))


_LONG = "SELECT CAST(100 + k AS BIGINT) AS link_id, CAST(0 AS DOUBLE) AS x0, CAST(k * 1000 AS DOUBLE) AS y0, CAST(4000 AS DOUBLE) AS x1, CAST(k * 1000 AS DOUBLE) AS y1 FROM (VALUES (0), (1), (2), (3), (4)) AS v(k)"


def _with_long(t: Tables) -> DataFrame:
    rows = t.sql(_LONG).withColumn("geom", g.make_line(g.point(F.col("x0"), F.col("y0")), g.point(F.col("x1"), F.col("y1"))))
    return rows.select("link_id", "geom").unionByName(t.links().where("x0 = x1").select("link_id", "geom"))


@query(f"""WITH a AS ({_LONG}), e AS (SELECT link_id AS o, x0 AS x, y0 AS y FROM ({LINKS}) l WHERE x0 = x1 UNION ALL SELECT link_id, x1, y1 FROM ({LINKS}) l WHERE x0 = x1)
SELECT DISTINCT link_id, o AS other_id, round((x - x0) / 4000, 6) AS share FROM a JOIN e ON e.y = a.y0 AND x > x0 AND x < x1""")
def ends_on_links(t: Tables) -> DataFrame:
    """Ends of cross links on the inside of long ones."""
    return editing.touching_ends(_with_long(t)).select("link_id", "other_id", r("share", 6).alias("share"))


@query(f"SELECT link_id, k::BIGINT AS part, 1000.0 AS part_m FROM ({_LONG}) a, (VALUES (1), (2), (3), (4)) v(k)")
def links_cut_at_ends(t: Tables) -> DataFrame:
    from haltwise.operators import schedule

    links = _with_long(t)
    parts = schedule.split_links(links.where("link_id >= 100"), editing.touching_ends(links).withColumn("share", F.round("share", 9)))
    return editing.cut_out(parts, links).select("link_id", F.col("part").cast("long").alias("part"), r(g.length(F.col("geom")), 3).alias("part_m"))


@query(f"SELECT n_nationkey::BIGINT AS link_id, p AS part, 20.0 AS part_m FROM nation, (VALUES (1), (2)) v(p) WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 0, 20.0 FROM nation WHERE n_nationkey % 2 = 1")
def rings_split(t: Tables) -> DataFrame:
    """Squares with a side of ten as two halves, open lines as they are."""
    n = t.table("nation").select(F.col("n_nationkey").cast("long").alias("link_id"))
    corner = lambda x, y: g.point(F.lit(float(x)), F.lit(float(y)))
    square = F.array(corner(0, 0), corner(10, 0), corner(10, 10), corner(0, 10), corner(0, 0))
    lines = n.withColumn("geom", F.when(F.col("link_id") % 2 == 0, square).otherwise(F.array(corner(0, 0), corner(0, 20))))
    return editing.split_rings(lines).select("link_id", "part", r(g.length(F.col("geom")), 3).alias("part_m"))


_MATCHED = f"SELECT jrnid, obs_id, CAST(jrnid % 3 AS INT) AS ptid, CAST(1 + obs_id % 8 AS INT) AS segno, x, y FROM ({POINTS}) p"


@query(f"WITH m AS ({_MATCHED}), s AS ({_SEGMENTS}) SELECT obs_id, round(least(1, greatest(0, (x - x0) / (x1 - x0))), 6) AS seg_rel_loc, round(s.segno * 500 + least(1, greatest(0, (x - x0) / (x1 - x0))) * 500, 3) AS pt_abs_loc FROM m JOIN s ON s.ptid = m.ptid AND s.segno = m.segno")
def linear_locations(t: Tables) -> DataFrame:
    segs = t.sql(_SEGMENTS).withColumn("geom", g.make_line(g.point(F.col("x0"), F.col("y0")), g.point(F.col("x1"), F.col("y1")))).withColumn("dist_lo", F.col("segno") * 500.0)
    return editing.linear_locations(t.sql(_MATCHED), segs.select("ptid", "segno", "geom", "dist_lo")).select("obs_id", r("seg_rel_loc", 6).alias("seg_rel_loc"), r("pt_abs_loc", 3).alias("pt_abs_loc"))


@query(
    f"""WITH s AS ({_SEG_ENTER}), g AS (SELECT *, sum(CASE WHEN first_ts IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY jrnid ORDER BY segno) AS grp FROM s), v AS (SELECT jrnid, grp, min(first_ts) AS a, min(last_ts) AS b, min(first_x) AS c, min(last_x) AS d FROM g GROUP BY ALL),
n AS (SELECT jrnid, grp, lag(d) OVER w AS x0, lead(c) OVER w AS nx, lag(b) OVER w AS t0, lead(a) OVER w AS nt FROM v WINDOW w AS (PARTITION BY jrnid ORDER BY grp)),
e AS (SELECT g.*, t0 + (enter_x - x0) * (coalesce(first_ts, nt) - t0) / nullif(coalesce(first_x, nx) - x0, 0) AS e FROM g JOIN n USING (jrnid, grp)), f AS (SELECT jrnid, segno, coalesce(e, first_ts) AS enter_ts, coalesce(lead(e) OVER (PARTITION BY jrnid ORDER BY segno), last_ts) AS exit_ts FROM e)
SELECT jrnid, count(*)::BIGINT AS n_offered, count(CASE WHEN enter_ts IS NOT NULL AND exit_ts IS NOT NULL AND exit_ts - enter_ts >= 0 AND NOT EXISTS (SELECT 1 FROM f d WHERE d.segno % 3 = 0 AND d.jrnid = f.jrnid AND d.enter_ts = f.enter_ts) THEN 1 END)::BIGINT AS n_added FROM f GROUP BY jrnid"""
)
def segments_transferred(t: Tables) -> DataFrame:
    done = segments.enter_exit(t.sql(_SEG_ENTER))
    return editing.transfer_segments(done, done.where("segno % 3 = 0"))[1].select("jrnid", "n_offered", F.col("n_added").cast("long").alias("n_added"))


@query(f"SELECT route_ver_id AS section_id, link_seq, link_id FROM ({ROUTE_LINKS}) q WHERE route_ver_id % 2 = 0 OR (route_ver_id % 3 = 0 AND link_seq = 1)")
def section_links_replaced(t: Tables) -> DataFrame:
    """Links of every odd section replaced by the first one, or by none."""
    now = t.sql(ROUTE_LINKS).select(F.col("route_ver_id").alias("section_id"), "link_seq", "link_id")
    odd = now.where("section_id % 2 = 1")
    return routing.replace_paths(now, odd, odd.where("section_id % 3 = 0 AND link_seq = 1"), "section_id")


@query(f"SELECT link_id, 1000.0 AS cost, CASE WHEN oneway THEN -1.0 ELSE 1000.0 END AS rcost FROM ({LINKS}) l")
def link_costs(t: Tables) -> DataFrame:
    cost, back = editing.cost_of(F.col("geom"), F.col("oneway"))
    return t.links().select("link_id", cost.alias("cost"), back.alias("rcost"))


@query("SELECT event_type, count(*)::BIGINT AS n_kept FROM events WHERE value IS NOT NULL AND event_id % 7 <> 0 GROUP BY event_type")
def rejected_rows_split(t: Tables) -> DataFrame:
    """Rows left after those with a reason have been split off."""
    e = t.table("events").withColumn("invalid_reasons", F.array().cast("array<string>"))
    good, _ = rawpoints.split_invalid(rawpoints.invalidate(e, "seventh", F.col("event_id") % 7 == 0))
    return good.groupBy("event_type").agg(F.count("*").alias("n_kept"))
