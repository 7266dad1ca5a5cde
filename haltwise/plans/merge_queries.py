"""Merged lines and the contracted network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.operators import contraction, linemerge, network
from haltwise.plans.bindings import Tables, r
from haltwise.plans.registry import registry

QUERIES, ORACLES, query = registry()

#: Streets: one link a customer, from a node to the next or seven back, every third against that; so there are chains, rings and crossings.
STREETS = """
SELECT link_id, CASE WHEN turned THEN b ELSE a END AS i_node, CASE WHEN turned THEN a ELSE b END AS j_node, oneway, CASE WHEN oneway THEN 'FT' ELSE 'B' END AS way, mode
FROM (SELECT 1000000 + c_custkey AS link_id, c_custkey AS a, CASE WHEN c_nationkey % 6 = 0 AND c_custkey > 7 THEN c_custkey - 7 ELSE c_custkey + 1 END AS b,
  c_custkey % 3 = 0 AS turned, c_nationkey % 5 = 0 AND floor(c_custkey / 40) % 2 = 0 AS oneway, CASE WHEN c_mktsegment < 'F' THEN 'bus' ELSE 'tram' END AS mode FROM {customer}) q"""
#: Nodes lie in rows of fifty; each link has a corner between its ends.
_PLACED = f"""
SELECT *, CAST(i_node % 50 * 20 AS DOUBLE) AS x0, CAST(floor(i_node / 50) * 30 AS DOUBLE) AS y0, CAST(j_node % 50 * 20 AS DOUBLE) AS x1, CAST(floor(j_node / 50) * 30 AS DOUBLE) AS y1,
  CAST((i_node % 50 + j_node % 50) * 10 AS DOUBLE) + 0.5 AS xm, CAST((floor(i_node / 50) + floor(j_node / 50)) * 15 AS DOUBLE) + 2 AS ym FROM ({STREETS}) s"""
_LENGTH = "sqrt((xm - x0) ** 2 + (ym - y0) ** 2) + sqrt((x1 - xm) ** 2 + (y1 - ym) ** 2)"


def _streets(t: Tables) -> DataFrame:
    at = lambda x, y: g.point(F.col(x), F.col(y))
    line = g.make_line(at("x0", "y0"), at("xm", "ym"), at("x1", "y1"))
    return t.sql(_PLACED).select("link_id", "i_node", "j_node", "oneway", "way", "mode", line.alias("geom")).withColumn("cost", g.length(F.col("geom")))


def _walks(edges: str, inner: str) -> str:
    """CTEs for DuckDB: `listed` (start, arc, k, n, first, last) of the lists of arcs kept; edges: grp, id, a, b; a vertex is a row of (grp, node).

    Lists are walked step by step from their starts, rings after a cut at the smallest node.
    """
    return f"""e AS ({edges}), arcs AS (SELECT 2 * id AS arc, grp, a AS v, b AS u FROM e UNION ALL SELECT 2 * id + 1, grp, b, a FROM e),
i AS (SELECT grp, v, min(arc) AS p, max(arc) AS q FROM arcs GROUP BY grp, v HAVING count(*) = 2 AND {inner}),
n0 AS (SELECT xor(p, 1::BIGINT) AS arc, q AS nxt FROM i UNION ALL SELECT xor(q, 1::BIGINT), p FROM i),
w0 AS (SELECT arc FROM arcs WHERE arc NOT IN (SELECT nxt FROM n0) UNION ALL SELECT n0.nxt FROM w0 JOIN n0 USING (arc)),
rings AS (SELECT arc, arc AS x FROM arcs WHERE arc NOT IN (SELECT arc FROM w0) UNION SELECT rings.arc, n0.nxt FROM rings JOIN n0 ON n0.arc = rings.x),
low AS (SELECT r.arc, min(a.u) AS m FROM rings r JOIN arcs a ON a.arc = r.x GROUP BY r.arc),
nx AS (SELECT n0.* FROM n0 JOIN arcs USING (arc) LEFT JOIN low USING (arc) WHERE m IS NULL OR m <> u),
w AS (SELECT arc AS start, arc, 1 AS k FROM arcs WHERE arc NOT IN (SELECT nxt FROM nx) UNION ALL SELECT start, nx.nxt, k + 1 FROM w JOIN nx USING (arc)),
ends AS (SELECT start, max(k) AS n, start // 2 AS first, max_by(arc, k) // 2 AS last FROM w GROUP BY start),
listed AS (SELECT w.*, n, first, last FROM w JOIN ends USING (start) WHERE first < last OR (first = last AND start % 2 = 0))"""


_OPEN = "true"
_FORBIDDEN = """SELECT v FROM (SELECT v, sum((oneway AND o)::INT) AS oo, sum((oneway AND NOT o)::INT) AS oi, sum((NOT oneway)::INT) AS tw FROM (SELECT i_node AS v, true AS o, oneway FROM l UNION ALL SELECT j_node, false, oneway FROM l) GROUP BY v) d
WHERE NOT ((oo = 1 AND oi = 1 AND tw = 0) OR (oo = 0 AND oi = 0 AND tw = 2))"""


@query(
    f"""WITH RECURSIVE s AS ({_PLACED}), {_walks("SELECT mode AS grp, link_id AS id, {'x': x0, 'y': y0} AS a, {'x': x1, 'y': y1} AS b FROM s", _OPEN)},
m AS (SELECT first AS chain, n AS n_edges, 2 * sum(arc % 2) > n AS turned, string_agg((arc // 2)::VARCHAR, ' ' ORDER BY k) AS fwd, string_agg((arc // 2)::VARCHAR, ' ' ORDER BY k DESC) AS bwd, round(sum({_LENGTH}), 4) AS length_m,
  min_by(CASE WHEN arc % 2 = 0 THEN {{'x': x0, 'y': y0}} ELSE {{'x': x1, 'y': y1}} END, k) AS p, max_by(CASE WHEN arc % 2 = 0 THEN {{'x': x1, 'y': y1}} ELSE {{'x': x0, 'y': y0}} END, k) AS q, any_value(mode) AS mode
  FROM listed JOIN s ON s.link_id = arc // 2 GROUP BY start, first, n)
SELECT mode, chain, n_edges::BIGINT AS n_edges, length_m, (2 * n_edges + 1)::BIGINT AS n_points, CASE WHEN turned THEN q.x ELSE p.x END AS x, CASE WHEN turned THEN q.y ELSE p.y END AS y FROM m"""
)
def merged_lines(t: Tables) -> DataFrame:
    """Streets of each mode merged where two ends meet: chains and rings."""
    lines = linemerge.merge_lines(_streets(t).select("mode", F.col("link_id").alias("edge_id"), "geom"), "mode")
    p = g.start_point(F.col("geom"))
    return lines.select("mode", "chain", "n_edges", r(g.length(F.col("geom"))).alias("length_m"), F.size("geom").cast("long").alias("n_points"), p["x"].alias("x"), p["y"].alias("y"))


@query(
    f"""WITH RECURSIVE l AS ({STREETS}), f AS ({_FORBIDDEN}), {_walks("SELECT 0 AS grp, link_id AS id, i_node AS a, j_node AS b FROM l", "v NOT IN (SELECT v FROM f)")}
SELECT arc // 2 AS link_id, first AS chain, k::BIGINT AS pos, n::BIGINT AS n, arc % 2 = 1 AS reversed FROM listed"""
)
def ranked_chains(t: Tables) -> DataFrame:
    """Each link's chain between forbidden vertices, and its place and direction there."""
    links = t.sql(STREETS)
    out = linemerge.chains(links.select(F.col("link_id").alias("edge_id"), F.col("i_node").alias("a"), F.col("j_node").alias("b")), contraction.forbidden_vertices(links).select(F.col("node_id").alias("v")))
    return out.withColumnRenamed("edge_id", "link_id")


_CONTRACTED = f"""WITH RECURSIVE l AS ({_PLACED}), f AS ({_FORBIDDEN}), {_walks("SELECT 0 AS grp, link_id AS id, i_node AS a, j_node AS b FROM l", "v NOT IN (SELECT v FROM f)")},
st AS (SELECT dense_rank() OVER (ORDER BY first) AS g, k, n, v, u, arc FROM listed JOIN arcs USING (arc) WHERE n > 1),
con AS (SELECT -g AS grp, min_by(v, k) AS source, max_by(u, k) AS target, any_value(n) AS n FROM st GROUP BY g), un AS (SELECT -g AS grp, v AS vertex FROM st WHERE k > 1),
pairs AS (SELECT grp, source AS i, vertex AS j FROM con JOIN un USING (grp) UNION SELECT grp, vertex, target FROM con JOIN un USING (grp) UNION SELECT grp, target, vertex FROM con JOIN un USING (grp)
  UNION SELECT grp, vertex, source FROM con JOIN un USING (grp) UNION SELECT a.grp, a.vertex, b.vertex FROM un a JOIN un b ON a.grp = b.grp AND a.vertex <> b.vertex)"""


@query(_CONTRACTED + " SELECT grp, source, target, n::BIGINT AS n_edges FROM con")
def contraction_groups(t: Tables) -> DataFrame:
    links = _streets(t)
    return contraction.linear_contraction(links, contraction.forbidden_vertices(links)).groups.select("grp", "source", "target", "n_edges")


@query(_CONTRACTED + " SELECT link_id, grp, i_node, j_node FROM l JOIN pairs ON i_node = i AND j_node = j")
def contracted_edges_to_merge(t: Tables) -> DataFrame:
    """Links of each contracted edge, found by pairs of its vertices."""
    links = _streets(t)
    return contraction.edges_of_contracted(contraction.linear_contraction(links, contraction.forbidden_vertices(links)), links)


@query(
    _CONTRACTED
    + f""", al AS (SELECT l.*, coalesce(grp, link_id) AS mg FROM l LEFT JOIN pairs ON i_node = i AND j_node = j)
SELECT abs(mg) AS id, mg < 0 AS is_contracted, min(way) AS oneway, min(mode) AS mode, count(*) AS n_edges, round(sum({_LENGTH}), 4) AS length_m FROM al GROUP BY mg"""
)
def contracted_nw(t: Tables) -> DataFrame:
    """All links, linear ones merged."""
    out = contraction.contracted_network(_streets(t))
    return out.select("id", "is_contracted", "oneway", "mode", "n_edges", r(g.length(F.col("geom"))).alias("length_m"))
