"""Validation rules of the network: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltwise.functions import geometry as g


def duplicated_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes at the place of another: k such nodes are each given k - 1 times."""
    n = F.count("*").over(Window.partitionBy("x", "y"))
    return nodes.withColumn("_n", n).where("_n > 1").select("node_id", F.explode(F.sequence(F.lit(2), F.col("_n"))).alias("_k")).drop("_k")


def end_node_mismatch(links: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Links whose first (i) or last (j) point is not at their node."""
    p = g.start_point(F.col("geom")) if end == "i" else g.end_point(F.col("geom"))
    n = nodes.select(F.col("node_id").alias(f"{end}_node"), "x", "y")
    return links.join(n, f"{end}_node").where(~((p["x"] == F.col("x")) & (p["y"] == F.col("y")))).select("link_id", f"{end}_node")


def same_start_end(links: DataFrame) -> DataFrame:
    return links.where(F.col("i_node") == F.col("j_node"))


def stops_without_link(stops: DataFrame) -> DataFrame:
    return stops.where(F.col("link_id").isNull())


def stops_incomplete_link(stops: DataFrame) -> DataFrame:
    return stops.where(F.col("link_id").isNotNull() & (F.col("link_reversed").isNull() | F.col("location_on_link").isNull()))


def first_seq_not_1(rows: DataFrame, parent: str, seq: str) -> DataFrame:
    """Rows that are first of their parent with another number than 1."""
    w = Window.partitionBy(parent)
    return rows.withColumn("_m", F.min(seq).over(w)).where((F.col(seq) == F.col("_m")) & (F.col("_m") != 1)).drop("_m")


def increment_not_1(rows: DataFrame, parent: str, seq: str, first: int | None = 0, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose number is not one more than the one before (before the first: `first`, or no rule where None)."""
    before = F.lag(seq).over(Window.partitionBy(parent).orderBy(seq, *order))
    before = F.coalesce(before, F.lit(first)) if first is not None else before
    return rows.withColumn("_p", before).where(F.col(seq) - F.col("_p") != 1).drop("_p")


def no_link_on_stop(stop_on_route: DataFrame, stops: DataFrame) -> DataFrame:
    """Stops of routes that lack a (complete) link reference."""
    bad = stops_without_link(stops).select("stop_id").union(stops_incomplete_link(stops).select("stop_id")).distinct()
    return stop_on_route.join(bad, "stop_id", "left_semi")


def gap_before_link(rows: DataFrame, parent: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Links that do not begin at the node where the one before ended. rows: parent, link_seq, i_node, j_node."""
    before = F.lag("j_node").over(Window.partitionBy(parent).orderBy("link_seq", *order))
    return rows.withColumn("_p", before).where(F.col("i_node") != F.col("_p")).drop("_p")


def restricted_reverse(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Uses of a one-way link backwards."""
    return rows.where("link_reversed").join(links.where("oneway").select("link_id"), "link_id", "left_semi")


def u_turns(rows: DataFrame, parent: str, order: tuple[str, ...] = ()) -> DataFrame:
    """A link followed by itself in the other direction."""
    w = Window.partitionBy(parent).orderBy("link_seq", *order)
    return rows.withColumn("_l", F.lag("link_id").over(w)).withColumn("_r", F.lag("link_reversed").over(w)).where((F.col("link_id") == F.col("_l")) & (F.col("link_reversed") != F.col("_r"))).drop("_l", "_r")


def missed_by_links(vianodes: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """Via nodes that none of the parent's links touches."""
    # Links stay one row each and meet the parent's nodes in the join's condition: no table of distinct nodes is held.
    ends = rows.select(F.col(parent).alias("_parent"), F.col("i_node").alias("_i"), F.col("j_node").alias("_j"))
    touched = (F.col(parent) == F.col("_parent")) & ((F.col("node_id") == F.col("_i")) | (F.col("node_id") == F.col("_j")))
    return vianodes.join(ends, touched, "left_anti")


def after_seq_mismatch(manual: DataFrame, stop_on_route: DataFrame) -> DataFrame:
    """Manual via nodes placed after a stop that the route does not have."""
    s = stop_on_route.select("route_ver_id", F.col("stop_seq").alias("after_stop_seq"))
    return manual.join(s, ["route_ver_id", "after_stop_seq"], "left_anti")


def label_errors(rows: DataFrame, rules: list[tuple[str, Column]], column: str = "errors") -> DataFrame:
    """Sets the error labels of each row anew from all rules in one pass."""
    return rows.withColumn(column, F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules])))


def overlapping_versions(versions: DataFrame) -> DataFrame:
    """Versions of a route and direction that begin before an earlier one has ended."""
    w = Window.partitionBy("route", "dir").orderBy("valid_from", "route_ver_id")
    reach = F.max("valid_until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return versions.withColumn("_r", reach).where(F.col("valid_from") < F.col("_r")).drop("_r")
