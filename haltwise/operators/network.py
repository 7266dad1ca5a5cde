"""The link-node network: construction, directed views, routes, sections and stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltwise.functions import geometry as g

#: Width of the strips in which places are numbered, and ids of links that are numbered together.
STRIP_M, LINKS_AT_ONCE = 1000.0, 1 << 16


def numbered(df: DataFrame, name: str, bucket: Column, *order: str, size: str | None = None) -> DataFrame:
    """df with dense numbers from 1 by `order`; bucket grows with it and is never smaller for a later row.

    Rows are numbered within their bucket after the count of the buckets before, so
    only one row a bucket is ever sorted in one task. With a column `size`, a row takes that many numbers and has the first.
    """
    parts = df.withColumn("_b", F.coalesce(bucket.cast("long"), F.lit(-(1 << 63))))
    count = F.count("*") if size is None else F.sum(size)
    before = F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.groupBy("_b").agg(count.alias("count")).select("_b", F.coalesce(before, F.lit(0)).alias("_o"))
    w = Window.partitionBy("_b").orderBy(*order)
    own = F.row_number().over(w) if size is None else F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size) + 1
    return parts.withColumn("_n", own).join(offsets, "_b").withColumn(name, F.col("_n") + F.col("_o")).drop("_b", "_n", "_o")


def nodes_of_links(links: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links with i_node and j_node, nodes): endpoints become nodes, existing nodes at the same place are used.

    New ids are dense in the order of (x, y) after the largest existing id.
    """
    ends = links.select("link_id", F.explode(F.array(g.start_point(F.col("geom")), g.end_point(F.col("geom")))).alias("p")).select(F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()
    if nodes is None:
        nodes = ends.limit(0).select(F.lit(0).alias("node_id"), "x", "y")
    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("top"))
    new = numbered(ends.join(nodes, ["x", "y"], "left_anti"), "n", F.floor(F.col("x") / STRIP_M), "x", "y")
    grown = nodes.select("node_id", "x", "y").unionByName(new.join(F.broadcast(top)).select((F.col("n") + F.col("top")).cast("int").alias("node_id"), "x", "y"))
    at = lambda name: grown.select(F.col("node_id").alias(f"{name}_node"), F.struct("x", "y").alias(f"_{name}"))
    out = links.withColumn("_i", g.start_point(F.col("geom"))).withColumn("_j", g.end_point(F.col("geom"))).join(at("i"), "_i").join(at("j"), "_j").drop("_i", "_j")
    return out, grown


def ends_at_places(links: DataFrame) -> DataFrame:
    """Nodes of links by place: x, y, n_out and n_in, the links that start and end there. Counted by place in one shuffle, so none needs an id."""
    end = lambda p, out: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(out).alias("o"))
    ends = links.select(F.explode(F.array(end(g.start_point(F.col("geom")), 1), end(g.end_point(F.col("geom")), 0))).alias("e")).select("e.*").where("x IS NOT NULL AND y IS NOT NULL")
    return ends.groupBy("x", "y").agg(F.sum("o").alias("n_out"), F.sum(1 - F.col("o")).alias("n_in"))


def directed(links: DataFrame) -> DataFrame:
    """Every link forwards, and backwards unless it is (or may be) one-way; numbered by (link_id, link_reversed)."""
    geom = [F.col("geom")] if "geom" in links.columns else []
    length = [c for c in ("length_m", "cost") if c in links.columns]
    forth = links.select("link_id", F.lit(False).alias("link_reversed"), F.col("i_node"), F.col("j_node"), *length, *geom)
    back = links.where(~F.col("oneway")).select("link_id", F.lit(True).alias("link_reversed"), F.col("j_node").alias("i_node"), F.col("i_node").alias("j_node"), *length, *[F.reverse("geom").alias("geom") for _ in geom])
    both = numbered(forth.unionByName(back), "uniq_link_id", F.floor(F.col("link_id") / LINKS_AT_ONCE), "link_id", "link_reversed")
    return both.withColumn("uniq_link_id", F.col("uniq_link_id").cast("int"))


def stops_on_route(stop_on_route: DataFrame, route_versions: DataFrame, stops: DataFrame, links: DataFrame) -> DataFrame:
    """Stops of route versions in order with their version's fields and the link they refer to, if any."""
    out = route_versions.join(stop_on_route, "route_ver_id").join(stops, "stop_id")
    return out.join(links.select("link_id", "link_reversed", "i_node", "j_node", "length_m"), ["link_id", "link_reversed"], "left")


def vianodes(stop_rows: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Nodes that a route passes, in order: (route_ver_id, node_seq, stop_seq, sub_seq, stop_id, node_id).

    stop_rows: route_ver_id, stop_seq, stop_id, i_node, j_node. The first stop
    starts from its link's first node, others go to its last. A node equal to
    the one before is left out; so is a missing node after a known one.
    """
    w = Window.partitionBy("route_ver_id").orderBy("stop_seq")
    first = F.col("stop_seq") == F.min("stop_seq").over(Window.partitionBy("route_ver_id"))
    own = stop_rows.withColumn("node_id", F.when(first, F.col("i_node")).otherwise(F.col("j_node")))
    own = own.withColumn("_before", F.lag("node_id").over(w)).where(F.col("_before").isNull() | (F.col("node_id") != F.col("_before")))
    rows = own.select("route_ver_id", "stop_seq", F.lit(0).alias("sub_seq"), "stop_id", "node_id")
    if manual is not None:
        rows = rows.unionByName(manual.select("route_ver_id", F.col("after_stop_seq").alias("stop_seq"), "sub_seq", F.lit(None).cast("long").alias("stop_id"), "node_id"))
    seq = F.row_number().over(Window.partitionBy("route_ver_id").orderBy("stop_seq", "sub_seq"))
    return rows.withColumn("node_seq", seq)


def cumulative_length(rows: DataFrame, parent: str, seq: str = "link_seq", order: tuple[str, ...] = ()) -> DataFrame:
    """rows (with length_m) plus start_m and end_m along their route or section."""
    w = Window.partitionBy(parent).orderBy(seq, *order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end_m", F.sum("length_m").over(w)).withColumn("start_m", F.col("end_m") - F.col("length_m"))


def section_line(sections: DataFrame, nodes: DataFrame) -> DataFrame:
    """First and last via node of each section with their places, and the straight line between them."""
    i, j = F.element_at("via_nodes", 1), F.element_at("via_nodes", -1)
    at = lambda name: nodes.select(F.col("node_id").alias(f"{name}_node"), F.col("x").alias(f"{name}_x"), F.col("y").alias(f"{name}_y"))
    out = sections.withColumn("i_node", i).withColumn("j_node", j).join(at("i"), "i_node").join(at("j"), "j_node")
    return out.withColumn("geom", g.make_line(g.point(F.col("i_x"), F.col("i_y")), g.point(F.col("j_x"), F.col("j_y"))))


def section_rotation(lines: DataFrame) -> DataFrame:
    """Bearing of each section's line in degrees."""
    return lines.withColumn("rotation", F.degrees(g.azimuth(g.start_point(F.col("geom")), g.end_point(F.col("geom")))))


def nearest_nodes(points: DataFrame, nodes: DataFrame, metres: float, key: str) -> DataFrame:
    """The nearest node within a distance of each point (x, y); by a grid of that size, so only neighbouring cells are compared."""
    near = _grid_join(points.select(key, F.col("x").alias("px"), F.col("y").alias("py")), nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny")), metres)
    d = F.hypot(F.col("px") - F.col("nx"), F.col("py") - F.col("ny"))
    return near.withColumn("distance_m", d).where(F.col("distance_m") <= metres).groupBy(key).agg(F.min_by("node_id", F.struct("distance_m", "node_id")).alias("node_id"), F.min("distance_m").alias("distance_m"))


def _grid_join(points: DataFrame, others: DataFrame, size: float) -> DataFrame:
    """Pairs in the same or neighbouring cells; the points are dealt once, the other side to nine cells."""
    cell = lambda c: F.floor(F.col(c) / size)
    left = points.withColumn("_cx", cell("px")).withColumn("_cy", cell("py"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    right = others.withColumn("_d", F.explode(around)).select("*", (cell("nx") + F.col("_d.a")).alias("_cx"), (cell("ny") + F.col("_d.b")).alias("_cy")).drop("_d")
    return left.join(right, ["_cx", "_cy"]).drop("_cx", "_cy")


def link_cells(links: DataFrame, size: float, margin: float) -> DataFrame:
    """Links with each grid cell that they pass within a margin, once."""
    cells = F.flatten(F.transform(g.line_segments(F.col("geom")), lambda s: g.segment_cells(s["a"], s["b"], size, margin)))
    return links.withColumn("_c", F.explode(F.array_distinct(cells))).withColumn("_cx", F.col("_c.cx")).withColumn("_cy", F.col("_c.cy")).drop("_c")


def stop_link_refs(stops: DataFrame, links: DataFrame, metres: float = 20.0, cell: float = 500.0) -> DataFrame:
    """The nearest directed link on whose right-hand side a stop lies, of its mode, within a distance.

    stops: stop_id, x, y, stop_mode; links: link_id, link_reversed, link_modes, geom.
    Candidates meet by grid cell, never as all pairs. Ties go to the smaller link.
    """
    s = stops.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    pairs = s.join(link_cells(links.select("link_id", "link_reversed", "link_modes", "geom"), cell, metres), ["_cx", "_cy"]).where(F.array_contains("link_modes", F.col("stop_mode")))
    n = g.nearest(F.col("geom"), g.point(F.col("x"), F.col("y")))
    found = pairs.withColumn("_n", n).where((F.col("_n.distance") <= metres) & (F.col("_n.side") < 0) & ~F.col("_n.beyond"))
    best = F.struct(F.col("_n.distance").alias("distance_from_link"), "link_id", "link_reversed", F.try_divide(F.col("_n.along"), g.length(F.col("geom"))).alias("location_on_link"))
    return found.groupBy("stop_id").agg(F.min(best).alias("_b")).select("stop_id", "_b.link_id", "_b.link_reversed", "_b.location_on_link", "_b.distance_from_link")


def update_stop_refs(stops: DataFrame, refs: DataFrame) -> DataFrame:
    """Stops with new references, except those set by hand and those without a match, which keep theirs."""
    names = ("link_id", "link_reversed", "location_on_link", "distance_from_link")
    new = refs.select("stop_id", *[F.col(c).alias(f"_{c}") for c in names])
    use = ~F.coalesce("link_ref_manual", F.lit(False)) & F.col("_link_id").isNotNull()
    joined = stops.join(new, "stop_id", "left")
    return joined.select(*[F.when(use, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in stops.columns])


#: Stops that are sent to every task, 64 bytes each at most (64 MB): rows of sections then meet them where they are. More are joined by a shuffle.
STOPS_EVERYWHERE = 1_000_000


def _few(stops: DataFrame) -> DataFrame:
    """stops to be sent to all tasks, if a count finds that they are few."""
    return F.broadcast(stops) if stops.limit(STOPS_EVERYWHERE + 1).count() <= STOPS_EVERYWHERE else stops


def _by_link(rows: DataFrame) -> DataFrame:
    """The rows of each task by their link, without a shuffle.

    Rows of a section are narrow and few next to what they give: those of one link then meet the same stops one after the other, so that the result is written in a fraction of the bytes.
    """
    # Spark leaves out a sort below a join, but not below a condition that counts rows; this one holds for all.
    return rows.sortWithinPartitions("link_id", "link_reversed").where(F.monotonically_increasing_id() >= 0)


def section_stop_points(section_links: DataFrame, stops: DataFrame) -> DataFrame:
    """Stops of sections by their distance from the section's start. section_links: section_id, link_seq, link_id, link_reversed, length_m."""
    placed = _by_link(cumulative_length(section_links, "section_id"))
    return placed.join(_few(stops.select("stop_id", "link_id", "link_reversed", "location_on_link")), ["link_id", "link_reversed"]).withColumn("location_m", F.col("start_m") + F.col("location_on_link") * F.col("length_m"))


def stop_places(stops: DataFrame, links: DataFrame) -> DataFrame:
    """Stops with their place on the link. stops: link_id, link_reversed, location_on_link; links: both directions, with geom."""
    lines = links.select("link_id", "link_reversed", F.col("geom").alias("_g"))
    return stops.join(lines, ["link_id", "link_reversed"]).withColumn("place", g.interpolate(F.col("_g"), F.col("location_on_link"))).drop("_g")


def section_stop_places(section_links: DataFrame, placed: DataFrame) -> DataFrame:
    """Stops of sections with their place on the link: section_id, link_seq, stop_id, place. placed: stops as `stop_places` gives them.

    A stop's place is worked out once, before it meets the sections.
    """
    return _by_link(section_links).join(_few(placed.select("link_id", "link_reversed", "stop_id", "place")), ["link_id", "link_reversed"]).select("section_id", "link_seq", "stop_id", "place")


def via_arrays(vianodes: DataFrame, key: str) -> DataFrame:
    """The nodes of each route in order as one array, and whether any is missing: such routes are not routed."""
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("node_seq", "node_id"))), lambda n: n["node_id"])
    return vianodes.groupBy(key).agg(F.bool_or(F.col("node_id").isNull()).alias("has_null_nodes"), nodes.alias("via_nodes"))


def line_of_links(rows: DataFrame, parent: str, seq: str = "link_seq") -> DataFrame:
    """One line per parent from the geometries of its links in order."""
    joined = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("geom").alias("g")))), lambda r: r["g"])
    return rows.groupBy(parent).agg(F.flatten(joined).alias("geom")).withColumn("length_m", g.length(F.col("geom")))


def vertex_degrees(edges: DataFrame) -> DataFrame:
    """One-way links in and out and two-way links in and out of each node. edges: i_node, j_node, oneway."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("i_node").alias("node_id"), F.lit(True).alias("out")), F.struct(F.col("j_node").alias("node_id"), F.lit(False).alias("out")))).alias("e"), "oneway").select("e.*", "oneway")
    count = lambda c: F.sum(c.cast("long"))
    one, out = F.col("oneway"), F.col("out")
    return ends.groupBy("node_id").agg(count(one & ~out).alias("owein"), count(one & out).alias("oweout"), count(~one & ~out).alias("twein"), count(~one & out).alias("tweout"))


def snap_topology(links: DataFrame, tolerance: float = 0.01, lines: DataFrame | None = None) -> DataFrame:
    """Links with vertex ids by endpoints rounded to a tolerance; ids are dense in the order of the rounded places.

    lines: the same lines before steps that need not be taken again to find their ends.
    """
    r = lambda p: F.struct(F.round(p["x"] / tolerance).alias("x"), F.round(p["y"] / tolerance).alias("y"))
    ends = lambda df: df.withColumn("_s", r(g.start_point(F.col("geom")))).withColumn("_t", r(g.end_point(F.col("geom"))))
    keyed = ends(links)
    places = numbered(ends(links if lines is None else lines).select(F.explode(F.array("_s", "_t")).alias("p")).distinct(), "id", F.floor(F.col("p.x") * tolerance / STRIP_M), "p").withColumn("id", F.col("id").cast("int"))
    a, b = places.select(F.col("p").alias("_s"), F.col("id").alias("source")), places.select(F.col("p").alias("_t"), F.col("id").alias("target"))
    return keyed.join(a, "_s").join(b, "_t").drop("_s", "_t")


def raw_network(lines: DataFrame, first_id: int = 1_000_000, tolerance: float = 0.01) -> DataFrame:
    """Street lines as edges to route on: id, cost, reverse_cost (-1: closed), oneway, mode, geom, source and target.

    lines: osm_id, mode, oneway, geom. Ids are dense after first_id in the order of osm_id, mode and geometry, as lines may share an osm_id.
    """
    ids = numbered(lines, "id", F.floor(F.col("osm_id") / LINKS_AT_ONCE), "osm_id", "mode", "geom", "oneway")
    cost = g.length(F.col("geom"))
    edges = ids.select((F.col("id") + first_id).alias("id"), cost.alias("cost"), F.when(F.col("oneway") == "FT", -1.0).otherwise(cost).alias("reverse_cost"), "oneway", "mode", "geom")
    return snap_topology(edges, tolerance, lines)


def one_way(oneway: Column) -> Column:
    """Direction code of a line: B for both, FT along it."""
    return F.when(oneway == "yes", F.lit("FT")).otherwise(F.lit("B"))


def sections_of_lines(lines: DataFrame, nodes: DataFrame, metres: float = 100.0) -> DataFrame:
    """Drawn sections with via_nodes: the nodes nearest to the line's ends, null where none is within the distance."""
    at = lambda end: lines.select("section_id", end["x"].alias("x"), end["y"].alias("y"))
    first = nearest_nodes(at(g.start_point(F.col("geom"))), nodes, metres, "section_id").select("section_id", F.col("node_id").alias("_i"))
    last = nearest_nodes(at(g.end_point(F.col("geom"))), nodes, metres, "section_id").select("section_id", F.col("node_id").alias("_j"))
    return lines.join(first, "section_id", "left").join(last, "section_id", "left").withColumn("via_nodes", F.array("_i", "_j")).drop("_i", "_j", "geom")


def upsert_sections(sections: DataFrame, drawn: DataFrame) -> DataFrame:
    """sections with the drawn ones in place of those of the same id, or added."""
    return sections.join(drawn.select("section_id"), "section_id", "left_anti").select(*sections.columns).unionByName(drawn.select(*sections.columns))


def delete_sections(sections: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, their links) without the sections gone."""
    return tuple(x.join(gone.select("section_id").distinct(), "section_id", "left_anti") for x in (sections, links))
