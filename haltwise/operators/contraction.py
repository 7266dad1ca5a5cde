"""The contracted network: linear edges between intersections merged into one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.operators import linemerge
from haltwise.operators.network import LINKS_AT_ONCE, numbered, vertex_degrees


def forbidden_vertices(links: DataFrame) -> DataFrame:
    """node_id of the vertices where contraction has to stop: all but those on the way of one one-way or two-way line."""
    one, two = F.struct("owein", "oweout"), F.struct("twein", "tweout")
    pair = lambda a, b: F.struct(F.lit(a).cast("long"), F.lit(b).cast("long"))
    passing = ((one == pair(1, 1)) & (two == pair(0, 0))) | ((one == pair(0, 0)) & ((two == pair(1, 1)) | (two == pair(2, 0)) | (two == pair(0, 2))))
    return vertex_degrees(links).where(~passing).select("node_id")


@dataclass
class Contraction:
    """groups: grp, source, target, n_edges, cost; inner: grp, vertex, seq; ranks: the place of every link in its chain."""

    groups: DataFrame
    inner: DataFrame
    ranks: DataFrame


def linear_contraction(links: DataFrame, forbidden: DataFrame | None = None) -> Contraction:
    """Chains of two edges or more as contracted edges. links: link_id, i_node, j_node, cost.

    grp is -1, -2, ... by the chain's smaller end edge. A ring starts and ends at its smallest node.
    """
    outer = None if forbidden is None else forbidden.select(F.col("node_id").alias("v"))
    edges = links.select(F.col("link_id").cast("long").alias("edge_id"), F.col("i_node").alias("a"), F.col("j_node").alias("b"))
    every = linemerge.chains(edges, outer)
    ranks = every.where("n > 1")
    heads = numbered(ranks.where("pos = 1").select("chain"), "k", F.floor(F.col("chain") / LINKS_AT_ONCE), "chain").select("chain", (-F.col("k")).alias("grp"))
    costs = links.select(F.col("link_id").cast("long").alias("edge_id"), "cost")
    steps = ranks.join(edges, "edge_id").join(costs, "edge_id").join(heads, "chain").select("grp", "pos", "n", "cost", F.when(F.col("reversed"), F.col("b")).otherwise(F.col("a")).alias("s"), F.when(F.col("reversed"), F.col("a")).otherwise(F.col("b")).alias("t"))
    ends = steps.groupBy("grp").agg(F.max(F.when(F.col("pos") == 1, F.col("s"))).alias("source"), F.max(F.when(F.col("pos") == F.col("n"), F.col("t"))).alias("target"), F.count("*").alias("n_edges"), F.sum("cost").alias("cost"))
    return Contraction(ends, steps.where("pos > 1").select("grp", F.col("s").alias("vertex"), (F.col("pos") - 1).alias("seq")), every)


def edges_of_contracted(made: Contraction, links: DataFrame) -> DataFrame:
    """link_id, grp, i_node, j_node of the links between vertices of a contracted edge, one of them an inner one.

    These are the links that match a pair of (source, vertex), (vertex, target), their reverses, or two different inner
    vertices. An inner vertex belongs to one edge alone, so links meet it by equality and no pairs within an edge are made.
    """
    of = made.inner.select("grp", "vertex")
    at = lambda end: of.select(F.col("grp").alias(f"g{end}"), F.col("vertex").alias(f"{end}_node"))
    met = links.select("link_id", "i_node", "j_node").join(at("i"), "i_node", "left").join(at("j"), "j_node", "left")
    inside = met.where("gi = gj AND i_node <> j_node").select("link_id", F.col("gi").alias("grp"), "i_node", "j_node")
    ends = made.groups.select("grp", F.explode(F.array_distinct(F.array("source", "target"))).alias("end"))
    # A link with one inner vertex has its other end at the edge's source or target.
    mixed = met.where("(gi IS NULL) <> (gj IS NULL)").withColumn("grp", F.coalesce("gi", "gj")).withColumn("end", F.when(F.col("gi").isNull(), F.col("i_node")).otherwise(F.col("j_node")))
    return inside.unionByName(mixed.join(ends, ["grp", "end"]).select("link_id", "grp", "i_node", "j_node"))


def contracted_network(links: DataFrame, grid: float = 0.001) -> DataFrame:
    """id, oneway, mode, is_contracted, n_edges, geom of the network with linear edges merged.

    links: link_id, i_node, j_node, oneway (boolean), way (its code), mode, cost, geom (from i_node to j_node). Codes and
    modes are merged by the minimum. Contracted edges have the ids 1, 2, ..., so those of the links must be larger than their number.
    """
    made = linear_contraction(links, forbidden_vertices(links))
    of = edges_of_contracted(made, links).select("link_id", "grp")
    rows = links.join(of, "link_id", "left").withColumn("grp", F.coalesce("grp", "link_id"))
    about = rows.groupBy("grp").agg(F.min("way").alias("oneway"), F.min("mode").alias("mode"))
    lines = linemerge.lines_of_chains(rows.select("grp", F.col("link_id").cast("long").alias("edge_id"), g.snap_to_grid(F.col("geom"), grid).alias("geom")), made.ranks, "grp")
    return lines.join(about, "grp").select(F.abs("grp").alias("id"), "oneway", "mode", (F.col("grp") < 0).alias("is_contracted"), "n_edges", "geom")
