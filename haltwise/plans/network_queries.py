"""Network, geometry, matching, routing and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.functions.scalar import epoch_us
from haltwise.operators import matching, network, routing, validation
from haltwise.plans.bindings import LINKS, NODES, ON_LINKS, POINTS, ROUTE_LINKS, STOP_ON_ROUTE, STOPS, Tables, r
from haltwise.plans.registry import registry

QUERIES, ORACLES, query = registry()

_DIRECTED = f"""l AS ({LINKS}), d AS (SELECT *, row_number() OVER (ORDER BY link_id, link_reversed)::BIGINT AS uniq_link_id FROM (
  SELECT link_id, false AS link_reversed, i_node, j_node, length_m, cost, x0, y0, x1, y1 FROM l UNION ALL SELECT link_id, true, j_node, i_node, length_m, cost, x1, y1, x0, y0 FROM l WHERE NOT oneway))"""


@query(f"WITH {_DIRECTED} SELECT uniq_link_id, link_id, link_reversed, i_node, j_node, cost, x0, y0 FROM d")
def link_directed(t: Tables) -> DataFrame:
    d = network.directed(t.links())
    p = g.start_point(F.col("geom"))
    return d.select(F.col("uniq_link_id").cast("long").alias("uniq_link_id"), "link_id", "link_reversed", "i_node", "j_node", "cost", p["x"].alias("x0"), p["y"].alias("y0"))


@query(
    f"""WITH l AS ({LINKS}), e AS (SELECT DISTINCT x, y FROM (SELECT x0 AS x, y0 AS y FROM l UNION ALL SELECT x1, y1 FROM l)), n AS (SELECT x, y, row_number() OVER (ORDER BY x, y)::INT AS node_id FROM e)
SELECT link_id, a.node_id AS i_node, b.node_id AS j_node FROM l JOIN n a ON a.x = x0 AND a.y = y0 JOIN n b ON b.x = x1 AND b.y = y1"""
)
def link_node_creation(t: Tables) -> DataFrame:
    links, _ = network.nodes_of_links(t.links().drop("i_node", "j_node"))
    return links.select("link_id", "i_node", "j_node")


_VIA_ROWS = f"SELECT route_ver_id, link_seq AS stop_seq, link_id AS stop_id, CASE WHEN link_id % 7 = 0 THEN NULL ELSE link_id % 25 END AS i_node, CASE WHEN link_id % 7 = 0 THEN NULL ELSE (link_id + 1) % 5 END AS j_node FROM ({ROUTE_LINKS}) q"
_MANUAL = f"SELECT route_ver_id, link_seq AS after_stop_seq, 1 AS sub_seq, link_id % 25 AS node_id FROM ({ROUTE_LINKS}) q WHERE link_seq = 2 AND route_ver_id % 3 = 0"


@query(
    f"""WITH s AS ({_VIA_ROWS}), o AS (SELECT *, CASE WHEN stop_seq = min(stop_seq) OVER (PARTITION BY route_ver_id) THEN i_node ELSE j_node END AS node_id FROM s),
k AS (SELECT * FROM (SELECT *, lag(node_id) OVER (PARTITION BY route_ver_id ORDER BY stop_seq) AS before FROM o) WHERE before IS NULL OR node_id <> before),
a AS (SELECT route_ver_id, stop_seq, 0 AS sub_seq, stop_id, node_id FROM k UNION ALL SELECT route_ver_id, after_stop_seq, sub_seq, NULL, node_id FROM ({_MANUAL}) m)
SELECT route_ver_id, row_number() OVER (PARTITION BY route_ver_id ORDER BY stop_seq, sub_seq)::BIGINT AS node_seq, stop_seq, sub_seq, stop_id, node_id FROM a"""
)
def vianodes_on_route(t: Tables) -> DataFrame:
    out = network.vianodes(t.sql(_VIA_ROWS), t.sql(_MANUAL))
    return out.select("route_ver_id", F.col("node_seq").cast("long").alias("node_seq"), "stop_seq", "sub_seq", "stop_id", "node_id")


@query(f"SELECT route_ver_id, link_seq, link_id, link_reversed, sum(length_m) OVER w - length_m AS start_m, sum(length_m) OVER w AS end_m FROM ({ROUTE_LINKS}) q WINDOW w AS (PARTITION BY route_ver_id ORDER BY link_seq ROWS UNBOUNDED PRECEDING)")
def route_link_cumulative(t: Tables) -> DataFrame:
    return network.cumulative_length(t.sql(ROUTE_LINKS), "route_ver_id").select("route_ver_id", "link_seq", "link_id", "link_reversed", "start_m", "end_m")


@query(f"""WITH q AS ({ROUTE_LINKS}), c AS (SELECT *, sum(length_m) OVER (PARTITION BY route_ver_id ORDER BY link_seq ROWS UNBOUNDED PRECEDING) - length_m AS start_m FROM q), s AS ({STOPS})
SELECT route_ver_id AS section_id, link_seq, stop_id, round(start_m + location_on_link * length_m, 4) AS location_m FROM c JOIN s ON s.link_id = c.link_id AND s.link_reversed = c.link_reversed""")
def section_stop_points(t: Tables) -> DataFrame:
    rows = t.sql(ROUTE_LINKS).withColumnRenamed("route_ver_id", "section_id")
    return network.section_stop_points(rows, t.sql(STOPS)).select("section_id", "link_seq", "stop_id", r("location_m").alias("location_m"))


_SECTION_NODES = "SELECT CAST(a AS BIGINT) AS section_id, CAST(a % 25 AS BIGINT) AS i, CAST((a * 7) % 25 AS BIGINT) AS j FROM (VALUES (1), (2), (3), (4), (5), (6), (12), (25)) AS v(a)"


def _sections(t: Tables) -> DataFrame:
    return t.sql(_SECTION_NODES).withColumn("via_nodes", F.array("i", F.lit(12), "j"))


@query(f"WITH s AS ({_SECTION_NODES}), n AS ({NODES}) SELECT section_id, i AS i_node, j AS j_node, a.x AS i_x, a.y AS i_y, b.x AS j_x, b.y AS j_y FROM s JOIN n a ON a.node_id = i JOIN n b ON b.node_id = j")
def section_ij_line(t: Tables) -> DataFrame:
    return network.section_line(_sections(t), t.sql(NODES)).select("section_id", "i_node", "j_node", "i_x", "i_y", "j_x", "j_y")


@query(f"WITH s AS ({_SECTION_NODES}), n AS ({NODES}) SELECT section_id, CASE WHEN a.x = b.x AND a.y = b.y THEN NULL ELSE round((degrees(atan2(b.x - a.x, b.y - a.y)) + 360) % 360, 4) END AS rotation FROM s JOIN n a ON a.node_id = i JOIN n b ON b.node_id = j")
def section_rotation(t: Tables) -> DataFrame:
    return network.section_rotation(network.section_line(_sections(t), t.sql(NODES))).select("section_id", r("rotation").alias("rotation"))


#: Distance, share and side of (px, py) on the straight link (x0, y0)-(x1, y1), in SQL.
_NEAR = """, least(1, greatest(0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS t, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2) AS raw_t,
 sign((x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)) AS side"""
_DIST = "sqrt((px - (x0 + t * (x1 - x0))) ** 2 + (py - (y0 + t * (y1 - y0))) ** 2)"


def _modes(t: Tables) -> DataFrame:
    return network.directed(t.links()).withColumn("link_modes", F.when(F.col("link_id") % 4 == 0, F.array(F.lit("bus"), F.lit("tram"))).otherwise(F.array(F.lit("bus"))))


_REF_LINKS = f"{_DIRECTED}, s AS ({STOPS}), c AS (SELECT stop_id, d.*, s.x AS px, s.y AS py FROM s JOIN d ON stop_mode = 'bus' OR d.link_id % 4 = 0), n AS (SELECT *{_NEAR} FROM c), k AS (SELECT *, {_DIST} AS dist FROM n)"


@query(f"WITH {_REF_LINKS}, b AS (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY round(dist, 6), link_id, link_reversed) AS k FROM k WHERE dist <= 150 AND side < 0 AND raw_t BETWEEN 0 AND 1) SELECT stop_id, link_id, link_reversed, round(t, 6) AS location_on_link, round(dist, 4) AS distance_from_link FROM b WHERE k = 1")
def stop_link_refs(t: Tables) -> DataFrame:
    out = network.stop_link_refs(t.sql(STOPS).select("stop_id", "x", "y", "stop_mode"), _modes(t), metres=150.0)
    return out.select("stop_id", "link_id", "link_reversed", r("location_on_link", 6).alias("location_on_link"), r("distance_from_link").alias("distance_from_link"))


@query(f"WITH {_REF_LINKS}, b AS (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY round(dist, 6), link_id, link_reversed) AS k FROM k WHERE dist <= 150 AND side < 0 AND raw_t BETWEEN 0 AND 1) SELECT s.stop_id, CASE WHEN NOT link_ref_manual AND b.link_id IS NOT NULL THEN b.link_id ELSE s.link_id END AS link_id FROM s LEFT JOIN b ON b.stop_id = s.stop_id AND k = 1")
def stop_link_refs_updated(t: Tables) -> DataFrame:
    stops = t.sql(STOPS).withColumn("distance_from_link", F.lit(None).cast("double"))
    refs = network.stop_link_refs(stops.select("stop_id", "x", "y", "stop_mode"), _modes(t), metres=150.0)
    return network.update_stop_refs(stops, refs).select("stop_id", "link_id")


@query(f"""WITH p AS (SELECT s_suppkey AS stop_id, (s_suppkey * 37) % 4000 + 0.0 AS px, (s_suppkey * 53) % 4000 + 0.0 AS py FROM supplier), n AS ({NODES}),
d AS (SELECT stop_id, node_id, sqrt((px - x) ** 2 + (py - y) ** 2) AS m FROM p, n) SELECT stop_id, arg_min(node_id, m * 1000 + node_id / 1000.0) AS node_id, round(min(m), 4) AS distance_m FROM d WHERE m <= 400 GROUP BY stop_id""")
def nearest_nodes(t: Tables) -> DataFrame:
    out = network.nearest_nodes(t.sql(STOPS), t.sql(NODES), 400.0, "stop_id")
    return out.select("stop_id", "node_id", r("distance_m").alias("distance_m"))


# Points of journeys around the links of their routes.
_ROUTED = f"SELECT link_id AS route_key, CAST(row_number() OVER (PARTITION BY link_id % 3 ORDER BY link_id) AS INT) AS link_seq, link_id, NOT oneway AND link_id % 2 = 0 AS link_reversed, link_id % 3 AS route_ver_id FROM ({LINKS}) l WHERE link_id % 2 = 0"
_CANDIDATES = f"""WITH p AS (SELECT *, x AS px, y AS py FROM ({POINTS}) q), lor AS ({_ROUTED}), l AS ({LINKS}),
c AS (SELECT p.jrnid, p.tst, link_seq, lor.link_id, link_reversed, px, py, x0, y0, x1, y1 FROM p JOIN lor ON lor.route_ver_id = p.jrnid % 3 JOIN l ON l.link_id = lor.link_id), n AS (SELECT *{_NEAR} FROM c),
k AS (SELECT *, {_DIST} AS dist FROM n), cand AS (SELECT jrnid, tst, link_seq, link_id, link_reversed, abs(t - CASE WHEN link_reversed THEN 1 ELSE 0 END) AS loc, CASE WHEN side > 0 THEN -1 ELSE 1 END * dist AS sd FROM k WHERE dist < 60 AND raw_t BETWEEN 0 AND 1)
"""


def _candidates(t: Tables) -> DataFrame:
    points = t.sql(POINTS)
    journeys = points.select("jrnid").distinct().withColumn("route_ver_id", F.col("jrnid") % 3)
    return matching.point_candidates(points, journeys, t.sql(_ROUTED), t.links(), 60.0)


@query(_CANDIDATES + "SELECT jrnid, epoch_us(tst) AS tst_us, link_seq, link_id, link_reversed, round(loc, 5) AS location_on_link, round(sd, 4) AS distance_from_link FROM cand")
def point_on_link_candidates(t: Tables) -> DataFrame:
    return _candidates(t).select("jrnid", epoch_us(F.col("tst")).alias("tst_us"), "link_seq", "link_id", "link_reversed", r("location_on_link", 5).alias("location_on_link"), r("distance_from_link").alias("distance_from_link"))


@query(_CANDIDATES + ", b AS (SELECT *, row_number() OVER (PARTITION BY jrnid, tst ORDER BY abs(sd), link_seq) AS k FROM cand) SELECT jrnid, epoch_us(tst) AS tst_us, link_seq, link_id, round(sd, 4) AS distance_from_link FROM b WHERE k = 1")
def points_on_link_best(t: Tables) -> DataFrame:
    return matching.points_on_links(_candidates(t)).select("jrnid", epoch_us(F.col("tst")).alias("tst_us"), "link_seq", "link_id", r("distance_from_link").alias("distance_from_link"))


_PLACED = f"WITH {_DIRECTED}, p AS ({ON_LINKS}), q AS (SELECT jrnid, tst, p.x, p.y, x0 + location_on_link * (x1 - x0) AS qx, y0 + location_on_link * (y1 - y0) AS qy FROM p JOIN d ON d.link_id = p.link_id AND d.link_reversed = p.link_reversed)"


@query(_PLACED + " SELECT jrnid, epoch_us(tst) AS tst_us, round(qx, 3) AS x, round(qy, 3) AS y FROM q")
def point_geom_interpolated(t: Tables) -> DataFrame:
    out = matching.point_geometry(t.sql(ON_LINKS), network.directed(t.links()))
    return out.select("jrnid", epoch_us(F.col("tst")).alias("tst_us"), r("place.x", 3).alias("x"), r("place.y", 3).alias("y"))


@query(_PLACED + " SELECT jrnid, epoch_us(tst) AS tst_us, round(sqrt((x - qx) ** 2 + (y - qy) ** 2), 3) AS line_m FROM q")
def point_to_link_line_length(t: Tables) -> DataFrame:
    placed = matching.point_geometry(t.sql(ON_LINKS).drop("x", "y"), network.directed(t.links()))
    out = matching.point_to_link_lines(placed, t.sql(POINTS))
    return out.select("jrnid", epoch_us(F.col("tst")).alias("tst_us"), r("line_m", 3).alias("line_m"))


@query(f"WITH l AS ({LINKS}) SELECT node_id, sum(CASE WHEN oneway AND NOT o THEN 1 ELSE 0 END)::BIGINT AS owein, sum(CASE WHEN oneway AND o THEN 1 ELSE 0 END)::BIGINT AS oweout, sum(CASE WHEN NOT oneway AND NOT o THEN 1 ELSE 0 END)::BIGINT AS twein, sum(CASE WHEN NOT oneway AND o THEN 1 ELSE 0 END)::BIGINT AS tweout FROM (SELECT i_node AS node_id, true AS o, oneway FROM l UNION ALL SELECT j_node, false, oneway FROM l) GROUP BY node_id")
def vertex_degrees(t: Tables) -> DataFrame:
    return network.vertex_degrees(t.links())


_PATHS = f"""WITH RECURSIVE {_DIRECTED}, w AS (SELECT i_node AS s, j_node AS node, cost, [i_node, j_node] AS seen, [uniq_link_id] AS path FROM d WHERE i_node IN (0, 7)
  UNION ALL SELECT s, j_node, w.cost + d.cost, list_append(seen, j_node), list_append(path, uniq_link_id) FROM w JOIN d ON d.i_node = w.node WHERE NOT list_contains(seen, j_node) AND len(path) < 10),
best AS (SELECT s, node, cost, path, row_number() OVER (PARTITION BY s, node ORDER BY cost, path) AS k FROM w)"""


@query(_PATHS + " SELECT s AS i_node, node AS j_node, min(cost) AS cost, count(*)::BIGINT AS n_links FROM (SELECT s, node, cost, unnest(path) AS p FROM best WHERE k = 1) GROUP BY s, node")
def dijkstra_costs(t: Tables) -> DataFrame:
    """Cheapest paths from two nodes to all others."""
    nodes = t.sql(NODES).select(F.col("node_id").alias("j_node"))
    pairs = nodes.withColumn("i_node", F.explode(F.array(F.lit(0), F.lit(7)))).where("i_node <> j_node")
    return routing.paths_for_pairs(pairs, network.directed(t.links())).groupBy("i_node", "j_node").agg(F.min("cost").alias("cost"), F.count("*").alias("n_links"))


@query(_PATHS + " SELECT s AS i_node, node AS j_node, path_seq::INT AS path_seq, path[path_seq]::BIGINT AS uniq_link_id FROM (SELECT s, node, path, unnest(generate_series(1, len(path))) AS path_seq FROM best WHERE k = 1)")
def one_to_many_paths(t: Tables) -> DataFrame:
    nodes = t.sql(NODES).select(F.col("node_id").alias("j_node"))
    pairs = nodes.withColumn("i_node", F.explode(F.array(F.lit(0), F.lit(7)))).where("i_node <> j_node")
    return routing.paths_for_pairs(pairs, network.directed(t.links())).select("i_node", "j_node", "path_seq", "uniq_link_id")


_VIAS = "SELECT CAST(k AS BIGINT) AS section_id, CAST(s AS INT) AS node_seq, CASE WHEN k = 4 AND s = 2 THEN NULL WHEN k = 3 THEN CAST(0 AS BIGINT) WHEN s = 1 THEN CAST(0 AS BIGINT) WHEN s = 2 THEN CAST(7 AS BIGINT) ELSE CAST(10 + 2 * k AS BIGINT) END AS node_id FROM (VALUES (1), (2), (3), (4), (5)) AS a(k) CROSS JOIN (VALUES (1), (2), (3)) AS b(s)"


@query(
    _PATHS
    + f""", v AS ({_VIAS}), pr AS (SELECT section_id, node_seq AS k2, node_id AS i, lead(node_id) OVER (PARTITION BY section_id ORDER BY node_seq) AS j FROM v WHERE section_id NOT IN (3, 4)),
st AS (SELECT section_id, k2, path, unnest(generate_series(1, len(path))) AS ps FROM pr JOIN best ON s = i AND node = j AND k = 1 WHERE j IS NOT NULL)
SELECT section_id, row_number() OVER (PARTITION BY section_id ORDER BY k2, ps)::BIGINT AS link_seq, link_id, link_reversed FROM st JOIN d ON d.uniq_link_id = path[ps]"""
)
def dijkstra_via_nodes(t: Tables) -> DataFrame:
    out = routing.paths_via_nodes(t.sql(_VIAS), network.directed(t.links()), "section_id")
    return out.select("section_id", F.col("link_seq").cast("long").alias("link_seq"), "link_id", "link_reversed")


#: The whole network, and next to it its rows with the two links that join them, where chains are long.
_CHAINED = f"SELECT link_id, i_node, j_node FROM ({LINKS}) w UNION ALL SELECT link_id + 100, i_node + 100, j_node + 100 FROM ({LINKS}) z WHERE link_id % 2 = 1 OR link_id IN (2, 12)"


@query(f"""WITH RECURSIVE l AS ({_CHAINED}), e AS (SELECT link_id, i_node AS n FROM l UNION ALL SELECT link_id, j_node FROM l),
i AS (SELECT min(link_id) AS a, max(link_id) AS b FROM e GROUP BY n HAVING count(*) = 2 AND min(link_id) <> max(link_id)), m AS (SELECT a AS u, b AS v FROM i UNION SELECT b, a FROM i),
c AS (SELECT link_id AS s, link_id AS x FROM l UNION SELECT s, v FROM c JOIN m ON u = x) SELECT s AS link_id, min(x) AS chain_id FROM c GROUP BY s""")
def contracted_links(t: Tables) -> DataFrame:
    return routing.contract_chains(t.sql(_CHAINED))


_NEAR_NODES = f"SELECT node_id, CASE WHEN node_id % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE x END AS x, CASE WHEN node_id % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE y END AS y FROM ({NODES}) n"


@query(f"WITH n AS ({_NEAR_NODES}) SELECT a.node_id FROM n a JOIN n b ON a.x = b.x AND a.y = b.y AND a.node_id <> b.node_id")
def vld_node_duplicated_node(t: Tables) -> DataFrame:
    return validation.duplicated_nodes(t.sql(_NEAR_NODES))


@query(f"WITH n AS ({_NEAR_NODES}), l AS ({LINKS}) SELECT link_id, i_node FROM l JOIN n ON node_id = i_node WHERE NOT (x = x0 AND y = y0)")
def vld_link_i_node_mismatch(t: Tables) -> DataFrame:
    return validation.end_node_mismatch(t.links(), t.sql(_NEAR_NODES), "i")


@query(f"WITH n AS ({_NEAR_NODES}), l AS ({LINKS}) SELECT link_id, j_node FROM l JOIN n ON node_id = j_node WHERE NOT (x = x1 AND y = y1)")
def vld_link_j_node_mismatch(t: Tables) -> DataFrame:
    return validation.end_node_mismatch(t.links(), t.sql(_NEAR_NODES), "j")


@query(f"SELECT link_id FROM (SELECT link_id, i_node, CASE WHEN link_id % 9 = 0 THEN i_node ELSE j_node END AS j_node FROM ({LINKS}) q) WHERE i_node = j_node")
def vld_link_start_end_same_point(t: Tables) -> DataFrame:
    return validation.same_start_end(t.links().withColumn("j_node", F.when(F.col("link_id") % 9 == 0, F.col("i_node")).otherwise(F.col("j_node")))).select("link_id")


@query(f"SELECT stop_id FROM ({STOPS}) s WHERE link_id IS NULL")
def vld_stop_no_link_ref(t: Tables) -> DataFrame:
    return validation.stops_without_link(t.sql(STOPS)).select("stop_id")


@query(f"SELECT stop_id FROM ({STOPS}) s WHERE link_id IS NOT NULL AND (link_reversed IS NULL OR location_on_link IS NULL)")
def vld_stop_incomplete_link_ref(t: Tables) -> DataFrame:
    return validation.stops_incomplete_link(t.sql(STOPS)).select("stop_id")


@query(f"SELECT route_ver_id, stop_seq, stop_id, tie FROM (SELECT *, min(stop_seq) OVER (PARTITION BY route_ver_id) AS m FROM ({STOP_ON_ROUTE}) s) WHERE stop_seq = m AND m <> 1")
def vld_stop_on_route_first_stop_seq_not_1(t: Tables) -> DataFrame:
    return validation.first_seq_not_1(t.sql(STOP_ON_ROUTE), "route_ver_id", "stop_seq")


@query(f"SELECT route_ver_id, stop_seq, stop_id, tie FROM (SELECT *, lag(stop_seq, 1, 0) OVER (PARTITION BY route_ver_id ORDER BY stop_seq, tie, stop_id) AS p FROM ({STOP_ON_ROUTE}) s) WHERE stop_seq - p <> 1")
def vld_stop_on_route_stop_seq_increment_not_1(t: Tables) -> DataFrame:
    return validation.increment_not_1(t.sql(STOP_ON_ROUTE), "route_ver_id", "stop_seq", order=("tie", "stop_id"))


@query(f"WITH s AS ({STOPS}) SELECT route_ver_id, stop_seq, stop_id, tie FROM ({STOP_ON_ROUTE}) r WHERE stop_id IN (SELECT stop_id FROM s WHERE link_id IS NULL OR link_reversed IS NULL OR location_on_link IS NULL)")
def vld_stop_on_route_no_link_ref_on_stop(t: Tables) -> DataFrame:
    return validation.no_link_on_stop(t.sql(STOP_ON_ROUTE), t.sql(STOPS)).select("route_ver_id", "stop_seq", "stop_id", "tie")


_ROUTE_NODES = f"SELECT q.*, CASE WHEN link_reversed THEN j_node ELSE i_node END AS i_node, CASE WHEN link_reversed THEN i_node ELSE j_node END AS j_node FROM ({ROUTE_LINKS}) q JOIN (SELECT link_id AS l, i_node, j_node FROM ({LINKS}) k) n ON n.l = q.link_id"


@query(f"SELECT route_ver_id, link_seq, link_id FROM (SELECT *, lag(j_node) OVER (PARTITION BY route_ver_id ORDER BY link_seq) AS p FROM ({_ROUTE_NODES}) r) WHERE i_node <> p")
def vld_link_on_route_gap_before_link(t: Tables) -> DataFrame:
    return validation.gap_before_link(t.sql(_ROUTE_NODES), "route_ver_id").select("route_ver_id", "link_seq", "link_id")


@query(f"WITH l AS ({LINKS}) SELECT route_ver_id, link_seq, r.link_id FROM ({_ROUTE_NODES}) r JOIN l ON l.link_id = r.link_id WHERE link_reversed AND oneway")
def vld_link_on_route_restricted_reverse_direction(t: Tables) -> DataFrame:
    return validation.restricted_reverse(t.sql(_ROUTE_NODES), t.links()).select("route_ver_id", "link_seq", "link_id")


@query(f"SELECT route_ver_id, link_seq, link_id FROM (SELECT *, lag(link_id) OVER w AS a, lag(link_reversed) OVER w AS b FROM ({ROUTE_LINKS}) r WINDOW w AS (PARTITION BY route_ver_id ORDER BY link_seq)) WHERE link_id = a AND link_reversed <> b")
def vld_link_on_route_u_turn(t: Tables) -> DataFrame:
    return validation.u_turns(t.sql(ROUTE_LINKS), "route_ver_id").select("route_ver_id", "link_seq", "link_id")


@query(f"SELECT route_ver_id, link_seq FROM (SELECT *, min(link_seq) OVER (PARTITION BY route_ver_id) AS m FROM ({ROUTE_LINKS}) r WHERE link_id % 4 <> 0) WHERE link_seq = m AND m <> 1")
def vld_link_on_route_first_link_seq_not_1(t: Tables) -> DataFrame:
    return validation.first_seq_not_1(t.sql(ROUTE_LINKS).where("link_id % 4 <> 0"), "route_ver_id", "link_seq").select("route_ver_id", "link_seq")


@query(f"SELECT route_ver_id, link_seq FROM (SELECT *, lag(link_seq) OVER (PARTITION BY route_ver_id ORDER BY link_seq) AS p FROM ({ROUTE_LINKS}) r WHERE link_id % 4 <> 0) WHERE link_seq - p <> 1")
def vld_link_on_route_link_seq_increment_not_1(t: Tables) -> DataFrame:
    return validation.increment_not_1(t.sql(ROUTE_LINKS).where("link_id % 4 <> 0"), "route_ver_id", "link_seq", first=None).select("route_ver_id", "link_seq")


@query(f"WITH r AS ({_ROUTE_NODES}), v AS (SELECT DISTINCT route_ver_id, route_ver_id % 25 AS node_id FROM r) SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.route_ver_id = v.route_ver_id AND (i_node = node_id OR j_node = node_id))")
def vld_vianode_missed_by_links_on_route(t: Tables) -> DataFrame:
    rows = t.sql(_ROUTE_NODES)
    via = rows.select("route_ver_id", (F.col("route_ver_id") % 25).alias("node_id")).distinct()
    return validation.missed_by_links(via, rows, "route_ver_id").select("route_ver_id", "node_id")


@query(f"SELECT route_ver_id, after_stop_seq FROM (SELECT DISTINCT route_ver_id, 1 + route_ver_id % 7 AS after_stop_seq FROM ({STOP_ON_ROUTE}) a) m WHERE NOT EXISTS (SELECT 1 FROM ({STOP_ON_ROUTE}) s WHERE s.route_ver_id = m.route_ver_id AND s.stop_seq = m.after_stop_seq)")
def vld_manual_vianode_after_stop_seq_mismatch(t: Tables) -> DataFrame:
    s = t.sql(STOP_ON_ROUTE)
    manual = s.select("route_ver_id", (1 + F.col("route_ver_id") % 7).alias("after_stop_seq")).distinct()
    return validation.after_seq_mismatch(manual, s).select("route_ver_id", "after_stop_seq")


@query(f"SELECT stop_id, concat_ws(',', CASE WHEN link_id IS NULL THEN 'no_link_ref' END, CASE WHEN link_id IS NOT NULL AND (link_reversed IS NULL OR location_on_link IS NULL) THEN 'incomplete_link_ref' END) AS errors FROM ({STOPS}) s")
def validate_all_errors(t: Tables) -> DataFrame:
    missing = F.col("link_id").isNull()
    rules = [("no_link_ref", missing), ("incomplete_link_ref", ~missing & (F.col("link_reversed").isNull() | F.col("location_on_link").isNull()))]
    return validation.label_errors(t.sql(STOPS), rules).select("stop_id", F.array_join("errors", ",").alias("errors"))
