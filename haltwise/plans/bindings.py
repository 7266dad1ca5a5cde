"""The test tables as transit data: SQL that Spark and DuckDB both run.

{events} and the like stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haltwise.functions import geometry as g

POINTS = """
SELECT user_id AS jrnid, ts AS tst, event_id AS obs_id,
  CASE WHEN event_type IN ('click', 'purchase') THEN true WHEN event_type = 'error' THEN NULL ELSE false END AS drst,
  CAST(sum(CAST(floor(value / 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS odo,
  value / 10 AS represents_time_s, value * 10 AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) * 40 AS y
FROM {events}"""
ON_LINKS = f"""
SELECT *, CAST(floor(odo / 4) AS INT) + 1 AS link_seq, CAST(odo % 4 AS DOUBLE) / 4 AS location_on_link,
  1 + CAST(floor(odo / 4) AS INT) % 40 AS link_id, CAST(floor(odo / 4) AS INT) % 2 = 1 AS link_reversed
FROM ({POINTS}) p"""
JOURNEYS = """
SELECT user_id AS jrnid, CAST(user_id % 10 AS STRING) AS route, CAST(1 + user_id % 2 AS INT) AS dir, CAST(user_id % 7 AS INT) AS oper, CAST(user_id AS INT) AS veh, min(ts) AS start_tst
FROM {events} GROUP BY user_id"""
NODES = """
SELECT CAST(n_nationkey AS BIGINT) AS node_id, CAST((n_nationkey % 5) * 1000 AS DOUBLE) AS x, CAST(floor(n_nationkey / 5) * 1000 AS DOUBLE) AS y FROM {nation}"""
LINKS = f"""
SELECT link_id, i_node, j_node, link_id % 3 = 0 AS oneway, CAST(1000 + (link_id * link_id) % 97 AS DOUBLE) AS cost,
  CAST(1000 AS DOUBLE) AS length_m, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1
FROM (SELECT CAST(2 * n_nationkey + 1 AS BIGINT) AS link_id, CAST(n_nationkey AS BIGINT) AS i_node, CAST(n_nationkey + 1 AS BIGINT) AS j_node FROM {{nation}} WHERE n_nationkey % 5 < 4
  UNION ALL SELECT CAST(2 * n_nationkey + 2 AS BIGINT), CAST(n_nationkey AS BIGINT), CAST(n_nationkey + 5 AS BIGINT) FROM {{nation}} WHERE n_nationkey < 20) l
JOIN ({NODES}) a ON a.node_id = l.i_node JOIN ({NODES}) b ON b.node_id = l.j_node"""
EDGE_POINTS = """
SELECT l_orderkey AS jrnid, CAST(l_linenumber AS INT) AS link_seq, l_shipdate AS tst, l_discount * 10 AS location_on_link FROM {lineitem}"""
EDGE_LINKS = """
SELECT o_orderkey AS jrnid, CAST(s AS INT) AS link_seq, CAST(100 * s + o_orderkey % 50 AS DOUBLE) AS length_m, CAST(1 + (o_orderkey + s) % 40 AS BIGINT) AS link_id, (o_orderkey + s) % 2 = 0 AS link_reversed
FROM {orders} CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7)) AS v(s)"""
#: Routes: an order's lines in a total order.
ROUTE_LINKS = """
SELECT l_orderkey AS route_ver_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS link_seq,
  CAST(1 + l_partkey % 40 AS BIGINT) AS link_id, l_suppkey % 2 = 1 AS link_reversed, CAST(l_quantity AS DOUBLE) AS length_m FROM {lineitem}"""
STOPS = """
SELECT s_suppkey AS stop_id, CAST((s_suppkey * 37) % 4000 AS DOUBLE) AS x, CAST((s_suppkey * 53) % 4000 AS DOUBLE) AS y, CASE WHEN s_suppkey % 4 = 0 THEN 'tram' ELSE 'bus' END AS stop_mode,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(1 + s_suppkey % 40 AS BIGINT) END AS link_id,
  CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 2 = 1 END AS link_reversed,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(s_suppkey % 10 AS DOUBLE) / 10 END AS location_on_link, CAST(0.2 AS DOUBLE) AS radius_share, s_suppkey % 6 = 0 AS link_ref_manual
FROM {supplier}"""
STOP_ON_ROUTE = """
SELECT l_orderkey AS route_ver_id, CAST(l_linenumber AS INT) AS stop_seq, l_suppkey AS stop_id, l_partkey AS tie FROM {lineitem}"""
VERSIONS = """
SELECT o_custkey AS route, CAST(1 AS INT) AS dir, o_orderkey AS route_ver_id, CAST(o_orderdate AS DATE) AS valid_from,
  CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS valid_until FROM {orders}"""
CALENDAR = """
SELECT c_custkey AS service_id, CAST(min(o_orderdate) AS DATE) AS start_date, CAST(max(o_orderdate) AS DATE) AS end_date,
  c_custkey % 2 = 1 AS sunday, floor(c_custkey / 2) % 2 = 1 AS monday, floor(c_custkey / 4) % 2 = 1 AS tuesday, floor(c_custkey / 8) % 2 = 1 AS wednesday,
  floor(c_custkey / 16) % 2 = 1 AS thursday, floor(c_custkey / 32) % 2 = 1 AS friday, floor(c_custkey / 64) % 2 = 1 AS saturday
FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey"""
EXCEPTIONS = """
SELECT DISTINCT o_custkey AS service_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS exception_type FROM {orders}"""
STOP_TIMES = """
SELECT l_orderkey AS trip_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS stop_sequence,
  CAST(l_suppkey % 3 AS BIGINT) AS stop_id, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS departure_s,
  CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) - 1 AS arrival_s,
  CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS DOUBLE) AS shape_dist FROM {lineitem}"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Tables:
    """The bindings over one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in TABLES if "{" + t + "}" in text})

    def links(self) -> DataFrame:
        return self.sql(LINKS).withColumn("geom", g.make_line(g.point(F.col("x0"), F.col("y0")), g.point(F.col("x1"), F.col("y1"))))


def duck(text: str) -> str:
    """A binding for DuckDB."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
