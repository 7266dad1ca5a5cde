"""Paths, shapes and rules of stop patterns, stops on the network, sections drawn by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.operators import network, patterns, schedule, tables, validation
from haltwise.plans.bindings import LINKS, NODES, ROUTE_LINKS, STOPS, Tables, r
from haltwise.plans.registry import registry

QUERIES, ORACLES, query = registry()

#: Stops of patterns at the nodes of the grid, each with the next one and the shares of the shape at both.
_STOPS = f"""SELECT ptid, stop_seq, i_node, j_node, CAST(stop_seq - 1 AS DOUBLE) / n AS i_dist, CASE WHEN j_node IS NOT NULL THEN CAST(stop_seq AS DOUBLE) / n END AS j_dist
FROM (SELECT route_ver_id AS ptid, link_seq AS stop_seq, CAST(link_id % 25 AS BIGINT) AS i_node, CAST(lead(link_id) OVER (PARTITION BY route_ver_id ORDER BY link_seq) % 25 AS BIGINT) AS j_node, count(*) OVER (PARTITION BY route_ver_id) AS n FROM ({ROUTE_LINKS}) rl) q"""
#: A path between two nodes: along the row, then along the column; some pairs have none.
_PATHS = """SELECT i_node, j_node, k + 1 AS path_seq, node_id, CASE WHEN k = dx + dy THEN -1 WHEN k < dx THEN 2 * least(node_id, next_id) + 1 ELSE 2 * least(node_id, next_id) + 2 END AS link_id
FROM (SELECT i_node, j_node, k, dx, dy, CAST(5 * (ay + sy * greatest(0, k - dx)) + ax + sx * least(k, dx) AS BIGINT) AS node_id, CAST(5 * (ay + sy * greatest(0, k + 1 - dx)) + ax + sx * least(k + 1, dx) AS BIGINT) AS next_id
  FROM (SELECT i_node, j_node, ax, ay, abs(bx - ax) AS dx, abs(b_y - ay) AS dy, CASE WHEN bx > ax THEN 1 WHEN bx < ax THEN -1 ELSE 0 END AS sx, CASE WHEN b_y > ay THEN 1 WHEN b_y < ay THEN -1 ELSE 0 END AS sy
    FROM (SELECT CAST(a.n_nationkey AS BIGINT) AS i_node, CAST(b.n_nationkey AS BIGINT) AS j_node, CAST(a.n_nationkey % 5 AS INT) AS ax, CAST(floor(a.n_nationkey / 5) AS INT) AS ay, CAST(b.n_nationkey % 5 AS INT) AS bx, CAST(floor(b.n_nationkey / 5) AS INT) AS b_y
      FROM {nation} AS a CROSS JOIN {nation} AS b) n0 WHERE i_node <> j_node AND (i_node + j_node) % 7 <> 0) n1
  CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) AS v(k) WHERE k <= dx + dy) n2"""
_SEGMENTS = f"""w AS (SELECT *, lead(node_id) OVER (PARTITION BY i_node, j_node ORDER BY path_seq) AS to_node FROM ({_PATHS}) p0),
sg AS (SELECT w.i_node, w.j_node, path_seq, w.link_id, node_id AS from_node, to_node, to_node = l.i_node AND node_id = l.j_node AS reversed FROM w JOIN ({LINKS}) l ON l.link_id = w.link_id),
ps AS ({_STOPS}), pp AS (SELECT ptid, stop_seq, path_seq, link_id, from_node, to_node, reversed FROM ps JOIN sg USING (i_node, j_node))"""


def _stops(t: Tables) -> DataFrame:
    return t.sql(_STOPS)


def _segments(t: Tables) -> DataFrame:
    return patterns.path_segments(t.sql(_PATHS), t.links())


def _paths(t: Tables) -> DataFrame:
    return patterns.pattern_paths(_stops(t), _segments(t))


@query(f"WITH {_SEGMENTS} SELECT * FROM pp")
def pattern_paths(t: Tables) -> DataFrame:
    return _paths(t)


#: Shapes: an angle of two equal sides. Every fifth pattern has none.
_SIDE = "1013.0 * (1 + ptid % 7)"
_MEASURED = f"""{_SEGMENTS}, nl AS (SELECT ptid, stop_seq, count(*) * 1000.0 AS nw_len FROM pp GROUP BY 1, 2),
m AS (SELECT ps.ptid, ps.stop_seq, nw_len IS NOT NULL AS path_found, nw_len, CASE WHEN ps.ptid % 5 <> 0 THEN (j_dist - i_dist) * 2 * {_SIDE.replace('ptid', 'ps.ptid')} END AS shape_len FROM ps LEFT JOIN nl ON nl.ptid = ps.ptid AND nl.stop_seq = ps.stop_seq),
c AS (SELECT *, CASE WHEN shape_len = 0 THEN 0 ELSE nw_len / shape_len END AS coeff FROM m),
rs AS (SELECT *, concat_ws(',', CASE WHEN NOT path_found THEN 'No network path' END, CASE WHEN coeff > 1.2 THEN 'Network path too long' END, CASE WHEN coeff < 0.8 THEN 'Network path too short' END) AS reasons FROM c),
pt AS (SELECT ptid, sum(shape_len) AS shape_len_total, sum(nw_len) AS nw_len_total, CASE WHEN sum(shape_len) = 0 THEN 0 ELSE sum(nw_len) / sum(shape_len) END AS coeff, bool_or(reasons <> '') AS bad FROM rs GROUP BY ptid)"""


def _checked(t: Tables) -> tuple[DataFrame, DataFrame]:
    stops = _stops(t)
    ids = stops.select("ptid").distinct()
    side = 1013.0 * (1 + F.col("ptid") % 7)
    corner = g.make_line(g.point(F.lit(0.0), F.lit(0.0)), g.point(side, F.lit(0.0)), g.point(side, side))
    # One shape for seven patterns' remainders, so shapes are shared.
    shapes = ids.select((F.col("ptid") % 7).alias("shape_id"), corner.alias("geom")).dropDuplicates(["shape_id"])
    pts = ids.select("ptid", F.when(F.col("ptid") % 5 != 0, F.col("ptid") % 7).alias("shape_id"))
    # Lengths are summed once for a pair of nodes, and a pattern's stops are gone through once.
    paths = _segments(t)
    checked = patterns.check_stops(patterns.stop_lengths(patterns.stop_shapes(patterns.path_found(stops, paths), pts, shapes), paths, t.links()))
    return checked, patterns.check_pattern_lengths(patterns.pattern_lengths(checked))


@query(f"WITH {_MEASURED} SELECT ptid, stop_seq, path_found, nw_len, round(shape_len, 3) AS shape_len, round(coeff, 4) AS coeff, reasons FROM rs")
def pattern_stops_checked(t: Tables) -> DataFrame:
    out, _ = _checked(t)
    return out.select("ptid", "stop_seq", "path_found", "nw_len", r("shape_len", 3).alias("shape_len"), r("nw_vs_shape_coeff").alias("coeff"), F.array_join("invalid_reasons", ",").alias("reasons"))


@query(f"WITH {_MEASURED} SELECT ptid, round(shape_len_total, 3) AS shape_len_total, nw_len_total, round(coeff, 4) AS coeff, concat_ws(',', CASE WHEN bad THEN 'Invalid records in stage_gtfs.pattern_stops' END, CASE WHEN coeff > 1.1 THEN 'Network path too long' END, CASE WHEN coeff < 0.9 THEN 'Network path too short' END) AS reasons FROM pt")
def patterns_checked(t: Tables) -> DataFrame:
    _, out = _checked(t)
    return out.select("ptid", r("shape_len_total", 3).alias("shape_len_total"), "nw_len_total", r("nw_vs_shape_coeff").alias("coeff"), F.array_join("invalid_reasons", ",").alias("reasons"))


@query(
    f"WITH {_SEGMENTS}, n AS ({NODES}), k AS (SELECT ptid, stop_seq, count(*) AS c FROM pp GROUP BY 1, 2) SELECT ps.ptid, ps.stop_seq, (c + 1)::INT AS n_points, c * 1000.0 AS length_m, CASE WHEN c > 0 THEN a.x END AS x0, CASE WHEN c > 0 THEN a.y END AS y0, CASE WHEN c > 0 THEN b.x END AS x1, CASE WHEN c > 0 THEN b.y END AS y1 "
    "FROM ps LEFT JOIN k ON k.ptid = ps.ptid AND k.stop_seq = ps.stop_seq LEFT JOIN n a ON a.node_id = ps.i_node LEFT JOIN n b ON b.node_id = ps.j_node"
)
def pattern_stops_geometry(t: Tables) -> DataFrame:
    """Lines of stop pairs from their directed segments."""
    out = patterns.stops_with_geometry(_stops(t), patterns.paths_with_geometry(_segments(t), t.links()))
    line, has = F.col("geom"), F.col("geom").isNotNull()
    ends = [F.when(has, p[c]).alias(f"{c}{i}") for i, p in enumerate((g.start_point(line), g.end_point(line))) for c in ("x", "y")]
    return out.select("ptid", "stop_seq", F.when(has, F.size(line)).alias("n_points"), F.when(has, g.length(line)).alias("length_m"), *ends)


_TEMPLATES = "SELECT o_orderkey AS ttid, o_custkey AS ptid, CAST(o_orderkey % 3 AS INT) AS bad FROM {orders}"
_TSTOPS = "SELECT l_orderkey AS ttid, CAST(l_linenumber AS INT) AS stop_seq, l_partkey AS tie, CAST(l_quantity - 2 AS DOUBLE) AS ij_seconds FROM {lineitem}"
_VALID = f"ts AS ({_TSTOPS}), b AS (SELECT DISTINCT ttid FROM ts WHERE ij_seconds <= 0), tt AS (SELECT ttid, ptid FROM ({_TEMPLATES}) q WHERE ttid NOT IN (SELECT ttid FROM b))"


def _templates(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.sql(_TEMPLATES).select("ttid", "ptid", F.array().cast("array<string>").alias("invalid_reasons"))
    return patterns.check_templates(t.sql(_TSTOPS).withColumn("invalid_reasons", F.array().cast("array<string>")), rows)


@query(f"SELECT ttid, stop_seq, tie, CASE WHEN ij_seconds <= 0 THEN 'Non-positive driving time' ELSE '' END AS reasons FROM ({_TSTOPS}) s")
def template_stops_checked(t: Tables) -> DataFrame:
    return _templates(t)[0].select("ttid", "stop_seq", "tie", F.array_join("invalid_reasons", ",").alias("reasons"))


@query(f"WITH {_VALID} SELECT ttid, tt.ptid, strftime(o_orderdate, '%Y-%m-%d') AS start_day FROM tt JOIN customer c ON c_custkey = tt.ptid AND c_nationkey < 20 JOIN orders ON o_orderkey = ttid")
def templates_transferred(t: Tables) -> DataFrame:
    """Valid templates of known patterns with their starts."""
    known = t.table("customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("ptid"))
    starts = t.table("orders").select(F.col("o_orderkey").alias("ttid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_day"))
    kept, when = patterns.transfer_templates(_templates(t)[1], known, starts)
    return kept.join(when, "ttid").select("ttid", "ptid", "start_day")


_SCHED = f"SELECT route_ver_id AS ptid, link_seq AS segno, link_id, link_reversed AS reversed, CAST(link_id % 10 AS BIGINT) AS i_stop, CASE WHEN link_seq % 3 = 0 THEN CAST(length_m AS BIGINT) % 10 END AS j_stop FROM ({ROUTE_LINKS}) rl"
_DIRECTED = f"d AS (SELECT link_id, false AS reversed, x0, y0, x1, y1 FROM ({LINKS}) a UNION ALL SELECT link_id, true, x1, y1, x0, y0 FROM ({LINKS}) b WHERE NOT oneway)"


def _shapes(t: Tables) -> DataFrame:
    links = t.links().select("link_id", "oneway", "geom")
    directed = links.select("link_id", F.lit(False).alias("reversed"), "geom").unionByName(links.where("NOT oneway").select("link_id", F.lit(True).alias("reversed"), g.reverse(F.col("geom")).alias("geom")))
    pts = t.table("orders").select(F.col("o_orderkey").alias("ptid"), (F.col("o_custkey") % 5).alias("route"))
    return patterns.segment_shapes(t.sql(_SCHED), pts, directed)


@query(f"WITH {_DIRECTED} SELECT s.ptid, o_custkey % 5 AS route, segno, s.link_id, s.reversed, x0, y0, x1, y1 FROM ({_SCHED}) s JOIN orders ON o_orderkey = s.ptid JOIN d ON d.link_id = s.link_id AND d.reversed = s.reversed")
def view_segment_shapes(t: Tables) -> DataFrame:
    a, b = F.col("geom")[0], F.col("geom")[1]
    return _shapes(t).select("ptid", "route", "segno", "link_id", "reversed", a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))


@query(f"WITH {_DIRECTED} SELECT s.ptid, (o_custkey % 5) AS route, (2 * count(*))::INT AS n_points, md5(string_agg((x0::INT) || ' ' || (y0::INT) || ',' || (x1::INT) || ' ' || (y1::INT), ',' ORDER BY segno)) AS line_md5 FROM ({_SCHED}) s JOIN orders ON o_orderkey = s.ptid JOIN d ON d.link_id = s.link_id AND d.reversed = s.reversed GROUP BY ALL")
def view_pattern_shapes(t: Tables) -> DataFrame:
    out = patterns.pattern_shapes(_shapes(t), ["route"])
    said = F.array_join(F.transform("geom", lambda p: F.concat_ws(" ", p["x"].cast("int"), p["y"].cast("int"))), ",")
    return out.select("ptid", "route", F.size("geom").alias("n_points"), F.md5(said).alias("line_md5"))


_AT = "SELECT s_suppkey AS stop_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS node_id FROM {supplier}"


@query(
    f"WITH s AS ({_SCHED}), n AS (SELECT ptid, segno, i_stop AS stop_id FROM s UNION ALL SELECT ptid, segno, j_stop FROM s), u AS (SELECT ptid, stop_id, max(segno) AS segno FROM n WHERE stop_id IS NOT NULL GROUP BY 1, 2), q AS (SELECT ptid, stop_id, row_number() OVER (PARTITION BY ptid ORDER BY segno, stop_id)::INT AS stop_seq FROM u) "
    f"SELECT ptid, o_custkey % 5 AS route, q.stop_id, stop_seq, name, x, y FROM q JOIN orders ON o_orderkey = ptid JOIN ({_AT}) a ON a.stop_id = q.stop_id JOIN ({NODES}) z ON z.node_id = a.node_id"
)
def view_pattern_stops(t: Tables) -> DataFrame:
    pts = t.table("orders").select(F.col("o_orderkey").alias("ptid"), (F.col("o_custkey") % 5).alias("route"))
    out = patterns.pattern_stop_places(t.sql(_SCHED), pts, t.sql(_AT), t.sql(NODES))
    return out.select("ptid", "route", "stop_id", "stop_seq", "name", "x", "y")


@query(f"SELECT stop_id, name, x, y FROM ({_AT}) a JOIN ({NODES}) z ON z.node_id = a.node_id")
def view_stop_nodes(t: Tables) -> DataFrame:
    return patterns.stop_nodes(t.sql(_AT), t.sql(NODES)).select("stop_id", "name", "x", "y")


_SERVED = "SELECT l_suppkey AS stop_id, min(CASE WHEN o_custkey % 5 = 0 THEN 'tram' ELSE 'bus' END) AS mode FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 5 < 4 GROUP BY 1"


def _with_mode(t: Tables) -> DataFrame:
    times = t.table("lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id"))
    trips = t.table("orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % 5).alias("route_id"))
    routes = t.spark.range(4).select(F.col("id").alias("route_id"), F.when(F.col("id") == 0, "tram").otherwise("bus").alias("mode"))
    return patterns.stops_with_mode(t.table("supplier").select(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("name")), times, trips, routes)


@query(f"SELECT stop_id, s_name AS name, mode FROM ({_SERVED}) m JOIN supplier ON s_suppkey = stop_id")
def stops_with_mode(t: Tables) -> DataFrame:
    return _with_mode(t).select("stop_id", "name", "mode")


@query(f"SELECT mode, count(*)::BIGINT AS n FROM ({_SERVED}) m JOIN supplier ON s_suppkey = stop_id GROUP BY mode")
def stop_mode_counts(t: Tables) -> DataFrame:
    return patterns.mode_counts(_with_mode(t))


_SNAPPED = """SELECT CAST(s_suppkey AS BIGINT) AS stop_id, CAST(1 + s_suppkey % 4 AS INT) AS edge, CAST((s_suppkey * 37) % 1000 AS DOUBLE) AS start_dist, CAST(1000 - (s_suppkey * 37) % 1000 AS DOUBLE) AS end_dist,
CAST((s_suppkey * 37) % 1000 AS DOUBLE) AS x, CAST(1000 * (1 + s_suppkey % 4) AS DOUBLE) AS y, CAST(s_suppkey % 45 AS DOUBLE) AS point_dist, 'snapped' AS status FROM {supplier}"""


@query(f"SELECT stop_id, edge, point_dist FROM ({_SNAPPED}) s WHERE point_dist <= 20")
def outlier_stops_dropped(t: Tables) -> DataFrame:
    return patterns.drop_outlier_stops(t.sql(_SNAPPED)).select("stop_id", "edge", "point_dist")


@query(
    f"""WITH RECURSIVE s AS ({_SNAPPED}), o AS (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY start_dist, stop_id) AS k FROM s),
w AS (SELECT edge, stop_id, k, 1 AS grp, start_dist AS anchor FROM o WHERE k = 1 UNION ALL SELECT o.edge, o.stop_id, o.k, w.grp + CASE WHEN o.start_dist > w.anchor + 40 THEN 1 ELSE 0 END, CASE WHEN o.start_dist > w.anchor + 40 THEN o.start_dist ELSE w.anchor END FROM w JOIN o ON o.edge = w.edge AND o.k = w.k + 1),
m AS (SELECT w.edge, w.grp, avg(start_dist) AS d, count(*) AS n FROM w JOIN s USING (edge, stop_id) GROUP BY 1, 2)
SELECT w.edge, w.grp::INT AS grp, w.stop_id, round(CASE WHEN n > 1 THEN d ELSE start_dist END, 4) AS start_dist, round(CASE WHEN n > 1 THEN 1000 - d ELSE end_dist END, 4) AS end_dist, round(CASE WHEN n > 1 THEN d ELSE x END, 4) AS x, y, CASE WHEN n > 1 THEN 'grouped' ELSE status END AS status FROM w JOIN m ON m.edge = w.edge AND m.grp = w.grp JOIN s ON s.stop_id = w.stop_id"""
)
def stops_clustered_on_edges(t: Tables) -> DataFrame:
    snapped = t.sql(_SNAPPED)
    groups = schedule.greedy_clusters(snapped, "edge", "start_dist", 40.0)
    y = 1000.0 * F.col("edge")
    edges = t.spark.range(1, 5).select(F.col("id").cast("int").alias("edge")).withColumn("geom", g.make_line(g.point(F.lit(0.0), y), g.point(F.lit(600.0), y), g.point(F.lit(1000.0), y)))
    out = patterns.cluster_stops(snapped, groups, edges)
    return out.select("edge", "grp", "stop_id", r("start_dist").alias("start_dist"), r("end_dist").alias("end_dist"), r("x").alias("x"), "y", "status")


_ON_NODES = f"SELECT stop_id, CAST(1000 * (stop_id % 7) AS DOUBLE) + CASE WHEN stop_id % 3 = 0 THEN 0.004 ELSE 0.0 END AS x, CAST(1000 * (stop_id % 6) AS DOUBLE) - CASE WHEN stop_id % 4 = 0 THEN 0.02 ELSE 0.0 END AS y FROM ({STOPS}) s"


@query(f"SELECT p.stop_id, name, z.node_id FROM ({_ON_NODES}) p JOIN ({NODES}) z ON sqrt((p.x - z.x) ** 2 + (p.y - z.y) ** 2) <= 0.01 JOIN ({_AT}) a ON a.stop_id = p.stop_id")
def stops_on_nodes(t: Tables) -> DataFrame:
    return patterns.stops_on_nodes(t.sql(_AT).drop("node_id"), t.sql(_ON_NODES), t.sql(NODES)).select("stop_id", "name", "node_id")


_DRAWN = "SELECT CAST(s_suppkey AS BIGINT) AS section_id, 'drawn' AS description, CAST((s_suppkey * 37) % 5000 AS DOUBLE) AS ax, CAST((s_suppkey * 11) % 5000 AS DOUBLE) AS ay, CAST((s_suppkey * 3) % 400 AS DOUBLE) AS bx, CAST((s_suppkey * 7) % 4100 AS DOUBLE) AS b_y FROM {supplier}"
_NEAREST = "(SELECT arg_min(node_id, (round(sqrt((x - {x}) ** 2 + (y - {y}) ** 2), 9), node_id)) FROM z WHERE sqrt((x - {x}) ** 2 + (y - {y}) ** 2) <= 100)"


@query(
    f"WITH z AS ({NODES}), d AS ({_DRAWN}), e AS (SELECT section_id, description, {_NEAREST.format(x='ax', y='ay')} AS i_node, {_NEAREST.format(x='bx', y='b_y')} AS j_node FROM d), o AS (SELECT CAST(c_custkey AS BIGINT) AS section_id, 'stored' AS description, CAST(c_nationkey AS BIGINT) AS i_node, CAST(NULL AS BIGINT) AS j_node FROM customer) "
    "SELECT * FROM (SELECT * FROM e UNION ALL SELECT * FROM o WHERE section_id NOT IN (SELECT section_id FROM e)) u WHERE section_id % 9 <> 0"
)
def sections_drawn(t: Tables) -> DataFrame:
    """Sections drawn by hand put in place of stored ones, and some deleted with their links."""
    drawn = t.sql(_DRAWN).withColumn("geom", g.make_line(g.point(F.col("ax"), F.col("ay")), g.point(F.col("bx"), F.col("b_y")))).select("section_id", "description", "geom")
    stored = t.table("customer").select(F.col("c_custkey").cast("long").alias("section_id"), F.lit("stored").alias("description"), F.array(F.col("c_nationkey").cast("long"), F.lit(None).cast("long")).alias("via_nodes"))
    now = network.upsert_sections(stored, network.sections_of_lines(drawn, t.sql(NODES)))
    left, _ = network.delete_sections(now, now.select("section_id"), now.where("section_id % 9 = 0"))
    return left.select("section_id", "description", F.col("via_nodes")[0].alias("i_node"), F.col("via_nodes")[1].alias("j_node"))


@query(f"SELECT stop_id, stop_mode, x, y FROM ({STOPS}) s")
def points_xy(t: Tables) -> DataFrame:
    points = t.sql(STOPS).select("stop_id", "stop_mode", g.point(F.col("x"), F.col("y")).alias("geom"))
    return tables.xy_view(points).select("stop_id", "stop_mode", "x", "y")


@query("SELECT DISTINCT l_partkey % 40 AS line, 'bus' AS mode FROM lineitem WHERE l_quantity < 25 UNION SELECT DISTINCT l_partkey % 40, 'tram' FROM lineitem WHERE l_quantity >= 49")
def combined_lines(t: Tables) -> DataFrame:
    rows = t.table("lineitem").select((F.col("l_partkey") % 40).alias("line"), "l_quantity")
    return tables.union_lines(tram=rows.where("l_quantity >= 49").select("line"), bus=rows.where("l_quantity < 25").select("line"))


_ON_SECTION = f"SELECT route_ver_id AS section_id, link_seq, q.link_id, link_reversed, CASE WHEN link_reversed THEN j_node ELSE i_node END AS i_node, CASE WHEN link_reversed THEN i_node ELSE j_node END AS j_node FROM ({ROUTE_LINKS}) q JOIN (SELECT link_id AS l, i_node, j_node FROM ({LINKS}) k) n ON n.l = q.link_id WHERE q.link_id % 5 <> 1"


@query(f"SELECT section_id, link_seq, link_id FROM (SELECT *, lag(j_node) OVER (PARTITION BY section_id ORDER BY link_seq) AS p FROM ({_ON_SECTION}) r) WHERE i_node <> p")
def vld_link_on_section_gap_before_link(t: Tables) -> DataFrame:
    return validation.gap_before_link(t.sql(_ON_SECTION), "section_id").select("section_id", "link_seq", "link_id")


@query(f"WITH l AS ({LINKS}) SELECT section_id, link_seq, r.link_id FROM ({_ON_SECTION}) r JOIN l ON l.link_id = r.link_id WHERE link_reversed AND oneway")
def vld_link_on_section_restricted_reverse_direction(t: Tables) -> DataFrame:
    return validation.restricted_reverse(t.sql(_ON_SECTION), t.links()).select("section_id", "link_seq", "link_id")


@query(f"SELECT section_id, link_seq, link_id FROM (SELECT *, lag(link_id) OVER w AS a, lag(link_reversed) OVER w AS b FROM ({_ON_SECTION}) r WINDOW w AS (PARTITION BY section_id ORDER BY link_seq)) WHERE link_id = a AND link_reversed <> b")
def vld_link_on_section_u_turn(t: Tables) -> DataFrame:
    return validation.u_turns(t.sql(_ON_SECTION), "section_id").select("section_id", "link_seq", "link_id")


@query(f"SELECT section_id, link_seq FROM (SELECT *, min(link_seq) OVER (PARTITION BY section_id) AS m FROM ({_ON_SECTION}) r) WHERE link_seq = m AND m <> 1")
def vld_link_on_section_first_link_seq_not_1(t: Tables) -> DataFrame:
    return validation.first_seq_not_1(t.sql(_ON_SECTION), "section_id", "link_seq").select("section_id", "link_seq")


@query(f"SELECT section_id, link_seq FROM (SELECT *, lag(link_seq) OVER (PARTITION BY section_id ORDER BY link_seq) AS p FROM ({_ON_SECTION}) r) WHERE link_seq - p <> 1")
def vld_link_on_section_link_seq_increment_not_1(t: Tables) -> DataFrame:
    return validation.increment_not_1(t.sql(_ON_SECTION), "section_id", "link_seq", first=None).select("section_id", "link_seq")
