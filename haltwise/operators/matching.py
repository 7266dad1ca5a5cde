"""Matching of points to the links of their journey's route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.functions.scalar import journey_id, local_time


def route_versions_asof(rows: DataFrame, versions: DataFrame, keys: tuple[str, ...], day: str, how: str = "inner") -> DataFrame:
    """rows with the version valid on their day: equal keys, valid_from <= day < valid_until (null: open)."""
    v = versions.select(*keys, "route_ver_id", "valid_from", "valid_until")
    on = [rows[k] == v[k] for k in keys] + [rows[day] >= v["valid_from"], v["valid_until"].isNull() | (rows[day] < v["valid_until"])]
    joined = rows.join(v, on, how)
    for k in keys:
        joined = joined.drop(v[k])
    return joined


def check_journeys(journeys: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with route_ver_id, rejected with a reason): the id must be that of its fields, and a version valid on the local day."""
    named = journeys.withColumn("_id", journey_id(F.col("route"), F.col("dir"), F.col("start_tst"), F.col("oper"), F.col("veh"))).withColumn("_day", F.to_date(local_time(F.col("start_tst"))))
    wrong = named.where(F.col("_id") != F.col("jrnid"))
    joined = route_versions_asof(named.where(F.col("_id") == F.col("jrnid")), versions, ("route", "dir"), "_day", "left")
    drop = ("_id", "_day", "valid_from", "valid_until")
    accepted = joined.where(F.col("route_ver_id").isNotNull()).drop(*drop)
    none = joined.where(F.col("route_ver_id").isNull()).select(*journeys.columns, F.lit("no route version").alias("reason"))
    return accepted, none.unionByName(wrong.select(*journeys.columns, F.lit("id does not match").alias("reason")))


def point_candidates(points: DataFrame, journeys: DataFrame, route_links: DataFrame, links: DataFrame, metres: float = 20.0) -> DataFrame:
    """Links of a point's route within a distance and not beyond their ends.

    The join is by route version (the links of one route) and by the grid cells that a link passes within the distance,
    so points meet the links near them and no row is made for the others. The distance is negative on the left of the
    undirected link; the location is along the directed link.
    """
    size = 4.0 * metres
    # A little beyond the distance, so that no rounding at a cell's side loses a point.
    cells = F.array_distinct(F.flatten(F.transform(g.line_segments(F.col("geom")), lambda s: g.segment_cells(s["a"], s["b"], size, metres * 1.001))))
    boxed = links.select("link_id", "geom", g.box(F.col("geom")).alias("_box"), cells.alias("_cells"))
    passed = route_links.select("route_ver_id", "link_seq", "link_id", "link_reversed").join(boxed, "link_id").withColumn("_cell", F.explode("_cells")).drop("_cells")
    on_grid = passed.withColumns({"_cx": F.col("_cell.cx"), "_cy": F.col("_cell.cy")}).drop("_cell")
    routed = points.join(journeys.select("jrnid", "route_ver_id"), "jrnid").withColumns({"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)})
    pairs = routed.join(on_grid, ["route_ver_id", "_cx", "_cy"]).where(g.near_box(F.col("_box"), F.col("x"), F.col("y"), metres))
    # Given out as a row of its own, what is nearest is worked out once for the filter and the columns.
    near = pairs.withColumn("_n", F.explode(F.array(g.nearest(F.col("geom"), g.point(F.col("x"), F.col("y"))))))
    hit = (F.col("_n.distance") < metres) & ~F.col("_n.beyond")
    share = F.try_divide(F.col("_n.along"), g.length(F.col("geom")))
    return near.where(hit).select(
        "jrnid", "tst", "link_seq", "link_id", "link_reversed", F.abs(share - F.col("link_reversed").cast("int")).alias("location_on_link"), (F.when(F.col("_n.side") > 0, -1).otherwise(1) * F.col("_n.distance")).alias("distance_from_link")
    )


def points_on_links(candidates: DataFrame) -> DataFrame:
    """The nearest candidate of each point; ties go to the earlier link."""
    order = F.struct(F.abs("distance_from_link").alias("d"), "link_seq")
    row = F.struct("link_seq", "link_id", "link_reversed", "location_on_link", "distance_from_link")
    return candidates.groupBy("jrnid", "tst").agg(F.min_by(row, order).alias("_r")).select("jrnid", "tst", "_r.*")


def point_geometry(points: DataFrame, directed: DataFrame) -> DataFrame:
    """Points with their place on the directed link."""
    joined = points.join(directed.select("link_id", "link_reversed", "geom"), ["link_id", "link_reversed"])
    return joined.withColumn("place", g.interpolate(F.col("geom"), F.col("location_on_link"))).drop("geom")


def point_to_link_lines(placed: DataFrame, raw: DataFrame) -> DataFrame:
    """The straight line from each raw point to its place on the link, and its length."""
    line = g.make_line(g.point(F.col("x"), F.col("y")), F.col("place"))
    return placed.join(raw.select("jrnid", "tst", "x", "y"), ["jrnid", "tst"]).withColumn("geom", line).withColumn("line_m", g.length(F.col("geom")))


def best_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
