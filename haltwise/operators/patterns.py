"""Paths of stop patterns on the network: directed segments, shapes, lengths, rules on them, views and transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.operators.network import _grid_join
from haltwise.operators.rawpoints import invalidate, propagate_invalidations


def path_segments(paths: DataFrame, links: DataFrame) -> DataFrame:
    """Directed links of node pair paths: i_node, j_node, path_seq, link_id, from_node, to_node, reversed.

    paths: i_node, j_node (the pair), path_seq, node_id, link_id that leaves the node, -1 at the end.
    links: link_id, i_node, j_node.
    """
    w = Window.partitionBy("i_node", "j_node").orderBy("path_seq")
    steps = paths.withColumn("to_node", F.lead("node_id").over(w)).where("link_id > -1").withColumnRenamed("node_id", "from_node")
    ends = links.select("link_id", F.col("i_node").alias("_i"), F.col("j_node").alias("_j"))
    against = (F.col("to_node") == F.col("_i")) & (F.col("from_node") == F.col("_j"))
    return steps.join(ends, "link_id").select("i_node", "j_node", "path_seq", "link_id", "from_node", "to_node", against.alias("reversed"))


def pattern_paths(stops: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments of every stop pair of a pattern; pairs without a path have none. stops: ptid, stop_seq, i_node, j_node."""
    return stops.select("ptid", "stop_seq", "i_node", "j_node").join(segments, ["i_node", "j_node"]).select("ptid", "stop_seq", "path_seq", "link_id", "from_node", "to_node", "reversed")


def _pair(paths: DataFrame) -> list[str]:
    """What a path belongs to: a stop of a pattern, or a pair of nodes, whose path all stops between them share and which is worked out once."""
    return ["ptid", "stop_seq"] if "ptid" in paths.columns else ["i_node", "j_node"]


def path_found(stops: DataFrame, paths: DataFrame) -> DataFrame:
    """stops with path_found: whether the stop pair has a path. paths: of pattern_paths or path_segments."""
    have = paths.select(*_pair(paths)).distinct().withColumn("path_found", F.lit(True))
    return stops.drop("path_found").join(have, _pair(paths), "left").withColumn("path_found", F.coalesce("path_found", F.lit(False)))


def stop_shapes(stops: DataFrame, patterns: DataFrame, shapes: DataFrame) -> DataFrame:
    """stops with shape_geom: the part of the pattern's shape between the shares i_dist and j_dist; null without a shape."""
    lines = patterns.select("ptid", "shape_id").join(shapes.select("shape_id", g.marks(F.col("geom")).alias("_line")), "shape_id")
    part = F.when(F.col("_line").isNotNull() & F.col("j_dist").isNotNull(), g.substring_of_marks(F.col("_line"), F.col("i_dist"), F.col("j_dist")))
    return stops.join(lines.select("ptid", "_line"), "ptid", "left").withColumn("shape_geom", part).drop("_line")


def paths_with_geometry(paths: DataFrame, links: DataFrame) -> DataFrame:
    """Segments with the geometry of their link in the direction of travel; links unknown to the network keep null."""
    geom = F.when(F.col("reversed"), g.reverse(F.col("_g"))).otherwise(F.col("_g"))
    return paths.join(links.select("link_id", F.col("geom").alias("_g")), "link_id", "left").withColumn("geom", geom).drop("_g")


def stops_with_geometry(stops: DataFrame, located: DataFrame) -> DataFrame:
    """stops with geom: their segments' lines joined in order, a vertex that two lines share once. One row holds one stop pair's path.

    located: paths of pattern_paths or path_segments with their geometry.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path_seq", "geom"))), lambda x: x["geom"])
    meets = lambda i: F.get(F.get(parts, i - 1), F.size(F.get(parts, i - 1)) - 1) == F.get(F.get(parts, i), 0)
    joined = F.flatten(F.transform(parts, lambda p, i: F.when(F.coalesce(meets(i), F.lit(False)), F.slice(p, 2, F.size(p))).otherwise(p)))
    lines = located.where(F.col("geom").isNotNull()).groupBy(*_pair(located)).agg(joined.alias("geom"))
    return stops.join(lines, _pair(located), "left")


def ratio(network: Column, shape: Column) -> Column:
    """Network length by shape length: null without a shape, 0 for a shape without extent."""
    return F.when(shape.isNull(), F.lit(None)).when(shape == 0, F.lit(0.0)).otherwise(F.try_divide(network, shape))


def network_lengths(stops: DataFrame, paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """stops with nw_len, the sum of their path's links. paths: of pattern_paths or path_segments; lengths: link_id, length_m."""
    along = paths.join(lengths.select("link_id", F.col("length_m").alias("_m")), "link_id").groupBy(*_pair(paths)).agg(F.sum("_m").alias("nw_len"))
    return stops.join(along, _pair(paths), "left")


def stop_lengths(stops: DataFrame, paths: DataFrame, links: DataFrame) -> DataFrame:
    """stops with nw_len, shape_len and nw_vs_shape_coeff. Lengths of links are summed, so no geometry is built."""
    out = network_lengths(stops, paths, links.select("link_id", g.length(F.col("geom")).alias("length_m"))).withColumn("shape_len", F.when(F.col("shape_geom").isNotNull(), g.length(F.col("shape_geom"))))
    return out.withColumn("nw_vs_shape_coeff", ratio(F.col("nw_len"), F.col("shape_len")))


def pattern_lengths(stops: DataFrame) -> DataFrame:
    """ptid, shape_len_total, nw_len_total and nw_vs_shape_coeff of whole patterns, from stops with their lengths; of checked stops also n_invalid, how many have a reason."""
    checked = [F.count_if(F.size("invalid_reasons") > 0).alias("n_invalid")] if "invalid_reasons" in stops.columns else []
    out = stops.groupBy("ptid").agg(F.sum("shape_len").alias("shape_len_total"), F.sum("nw_len").alias("nw_len_total"), *checked)
    return out.withColumn("nw_vs_shape_coeff", ratio(F.col("nw_len_total"), F.col("shape_len_total")))


def _with_reasons(df: DataFrame) -> DataFrame:
    return df if "invalid_reasons" in df.columns else df.withColumn("invalid_reasons", F.array().cast("array<string>"))


def check_stops(stops: DataFrame) -> DataFrame:
    """stops with invalid_reasons: no path, or one much longer or shorter than the shape (bounds are fixed values)."""
    stops = _with_reasons(stops)
    for reason, rule in (
        ("No network path", ~F.col("path_found")),
        ("Network path too long", F.col("nw_vs_shape_coeff") > 1.2),
        ("Network path too short", F.col("nw_vs_shape_coeff") < 0.8),
    ):
        stops = invalidate(stops, reason, rule)
    return stops


def check_pattern_lengths(patterns: DataFrame) -> DataFrame:
    """patterns with invalid_reasons: stops with reasons (n_invalid of pattern_lengths), or paths longer or shorter than the shape."""
    patterns = invalidate(_with_reasons(patterns), "Invalid records in stage_gtfs.pattern_stops", F.col("n_invalid") > 0)
    for reason, rule in (("Network path too long", F.col("nw_vs_shape_coeff") > 1.1), ("Network path too short", F.col("nw_vs_shape_coeff") < 0.9)):
        patterns = invalidate(patterns, reason, rule)
    return patterns


def check_templates(stops: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stops, templates) with invalid_reasons: no positive time between two stops."""
    stops = invalidate(stops, "Non-positive driving time", F.col("ij_seconds") <= 0)
    return stops, propagate_invalidations(stops, templates, ["ttid"], "stage_gtfs.template_stops")


def transfer_templates(templates: DataFrame, patterns: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(templates, their starts): valid ones whose pattern has been transferred."""
    kept = templates.where(F.size("invalid_reasons") == 0).join(patterns.select("ptid").distinct(), "ptid", "left_semi")
    return kept, starts.join(kept.select("ttid"), "ttid", "left_semi")


def segment_shapes(segments: DataFrame, patterns: DataFrame, directed: DataFrame) -> DataFrame:
    """Segments with their pattern's attributes and directed link's geometry. directed: link_id, reversed, geom."""
    return segments.join(patterns, "ptid").join(directed.select("link_id", "reversed", "geom"), ["link_id", "reversed"])


def pattern_shapes(shapes: DataFrame, attributes: list[str]) -> DataFrame:
    """The line of each pattern through all points of its segments in order."""
    line = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("segno", "geom"))), lambda x: x["geom"]))
    return shapes.groupBy("ptid", *attributes).agg(line.alias("geom"))


def pattern_stop_places(segments: DataFrame, patterns: DataFrame, stops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stops of patterns, once each, in the order of the last segment that names them. segments: ptid, segno, i_stop, j_stop."""
    named = segments.select("ptid", "segno", F.explode(F.array("i_stop", "j_stop")).alias("stop_id")).where("stop_id IS NOT NULL")
    once = named.groupBy("ptid", "stop_id").agg(F.max("segno").alias("segno"))
    order = F.row_number().over(Window.partitionBy("ptid").orderBy("segno", "stop_id"))
    return once.withColumn("stop_seq", order).drop("segno").join(patterns, "ptid").join(stops, "stop_id").join(nodes.select("node_id", "x", "y"), "node_id")


def stops_with_mode(stops: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Stops that are served, with a mode of the routes there; of several the first by name."""
    modes = trips.select("trip_id", "route_id").join(routes.select("route_id", "mode"), "route_id")
    served = stop_times.select("trip_id", "stop_id").join(modes.select("trip_id", "mode"), "trip_id")
    return stops.join(served.groupBy("stop_id").agg(F.min("mode").alias("mode")), "stop_id")


def mode_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mode").agg(F.count("*").alias("n"))


def drop_outlier_stops(snapped: DataFrame, metres: float = 20.0) -> DataFrame:
    """Stops not farther from their edge than a distance; an unknown distance stays."""
    return snapped.where(~F.coalesce(F.col("point_dist") > metres, F.lit(False)))


def snap_near_nodes(snapped: DataFrame, edges: DataFrame, metres: float = 10.0) -> DataFrame:
    """Stops nearer to an end of their edge than a distance moved to that end, the nearer one (of equals the start).

    snapped: stop_id, edge, start_dist, end_dist, x, y, status; edges: edge, geom. Stops on an end, or without an edge, stay.
    """
    met = snapped.join(edges.select("edge", F.col("geom").alias("_g")), "edge", "left")
    a, b, line = F.col("start_dist"), F.col("end_dist"), F.col("_g")
    start = line.isNotNull() & (a > 0) & (a < metres) & (a <= b)
    end = line.isNotNull() & (b > 0) & (b < metres) & (b < a)
    p, q, size = g.start_point(line), g.end_point(line), g.length(line)
    new = {"start_dist": (F.lit(0.0), size), "end_dist": (size, F.lit(0.0)), "x": (p["x"], q["x"]), "y": (p["y"], q["y"]), "status": (F.lit("moved to edge start"), F.lit("moved to edge end"))}
    return met.select(*[F.when(start, new[c][0]).when(end, new[c][1]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in snapped.columns])


def cluster_stops(snapped: DataFrame, groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Stops moved to the mean place of their group on the edge, where the group has several: new start_dist, end_dist, x, y, status.

    snapped: stop_id, edge, start_dist, end_dist, x, y, status; groups: edge, stop_id, grp; edges: edge, geom.
    """
    rows = snapped.join(groups.select("edge", "stop_id", "grp"), ["edge", "stop_id"], "left")
    mean = rows.groupBy("edge", "grp").agg(F.avg("start_dist").alias("_d"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    met = rows.join(mean, ["edge", "grp"], "left").join(edges.select("edge", F.col("geom").alias("_g")), "edge", "left")
    place = g.interpolate(F.col("_g"), F.try_divide(F.col("_d"), g.length(F.col("_g"))))
    moved = F.col("_d").isNotNull() & F.col("_g").isNotNull()
    new = {"start_dist": F.col("_d"), "end_dist": g.length(F.col("_g")) - F.col("_d"), "x": place["x"], "y": place["y"], "status": F.lit("grouped")}
    return met.select(*[F.when(moved, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in snapped.columns], "grp")


def stops_on_nodes(stops: DataFrame, snapped: DataFrame, nodes: DataFrame, metres: float = 0.01) -> DataFrame:
    """Stops with each node where their snapped place lies. stops: stop_id and attributes; snapped: stop_id, x, y."""
    places = snapped.select("stop_id", F.col("x").alias("px"), F.col("y").alias("py"))
    near = _grid_join(places, nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny")), metres)
    met = near.where(F.hypot(F.col("px") - F.col("nx"), F.col("py") - F.col("ny")) <= metres).select("stop_id", "node_id")
    return stops.join(met, "stop_id")


def stop_nodes(stops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stops with the place of their node."""
    return stops.join(nodes.select("node_id", "x", "y"), "node_id")
