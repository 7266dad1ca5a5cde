"""Stops snapped to the nearest link at any distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.operators.network import link_cells
from haltwise.sources.folders import Steps

#: How much wider cells get from level to level, and by how much bounds may be off.
WIDER, SLACK_M = 4, 1e-4


def snap_to_links(stops: DataFrame, links: DataFrame, cell: float = 500.0, same_mode: bool = False) -> DataFrame:
    """stop_id, link_id, dist, loc of the nearest link; ties (to a micrometre) go to the smaller link.

    Links are indexed by the grid cells that they pass, with ever wider cells above. Stops go
    down from the few widest cells: of the cells below, those stay that may hold something as near as
    the nearest farthest corner, for there is a link in every cell. In the narrowest cells, stops meet the links. Every
    join is by equality of cells, of which a stop keeps a few at each level however far away its link is.
    With `same_mode`, only links whose link_modes hold the stop_mode count, by an index
    of each mode. Stops without a place, or without any link of their mode, have no row.
    """
    mode = lambda c: F.col(c) if same_mode else F.lit("")
    placed = stops.where("x IS NOT NULL AND y IS NOT NULL").select("stop_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), mode("stop_mode").alias("mode"))
    steps = Steps(stops.sparkSession)
    modes = F.explode(F.array_distinct("link_modes")) if same_mode else F.lit("")
    index = steps.write(link_cells(links.select("link_id", "geom"), cell, SLACK_M).join(links.select("link_id", modes.alias("mode")), "link_id").select("mode", "link_id", F.col("_cx").alias("cx"), F.col("_cy").alias("cy")), "index")
    span = index.agg(*[F.max(c) - F.min(c) for c in ("cx", "cy")]).first()
    top = 0 if span[0] is None else max(0, math.ceil(math.log(max(*span, 1), WIDER)))

    def level(k: int) -> DataFrame:
        return index.select("mode", *[F.floor(F.col(c) / WIDER**k).alias(c) for c in ("cx", "cy")]).distinct()

    # Four cells a mode at most.
    near = placed.join(F.broadcast(level(top)), "mode")
    for k in range(top - 1, -1, -1):
        below = level(k).select("mode", F.col("cx").alias("_x"), F.col("cy").alias("_y"), F.floor(F.col("cx") / WIDER).alias("cx"), F.floor(F.col("cy") / WIDER).alias("cy"))
        size = cell * WIDER**k
        low, high = _bounds(size, F.col("_x"), F.col("_y"))
        met = near.join(below, ["mode", "cx", "cy"]).select("stop_id", "x", "y", "mode", F.col("_x").alias("cx"), F.col("_y").alias("cy"), low.alias("low"), high.alias("high"))
        bound = F.min("high").over(Window.partitionBy("stop_id", "x", "y"))
        near = met.withColumn("bound", bound).where(F.col("low") <= F.col("bound") + 3 * SLACK_M).select("stop_id", "x", "y", "mode", "cx", "cy")
    pairs = near.join(index, ["mode", "cx", "cy"]).select("stop_id", "x", "y", "link_id").distinct()
    out = steps.write(_best(pairs.join(links.select("link_id", "geom"), "link_id")), "snapped")
    steps.keep_only(out)
    return out


def _bounds(size: float, cx: Column, cy: Column) -> tuple[Column, Column]:
    """The least and greatest distance of a place (x, y) from a cell."""
    near, far = [], []
    for v, c in ((F.col("x"), cx), (F.col("y"), cy)):
        before, after = c * size - v, v - (c + 1) * size
        near.append(F.greatest(before, after, F.lit(0.0)))
        far.append(F.greatest(-before, -after))
    return F.hypot(*near), F.hypot(*far)


def _best(pairs: DataFrame) -> DataFrame:
    n = g.nearest(F.col("geom"), g.point(F.col("x"), F.col("y")))
    rows = pairs.withColumn("_n", n)
    order = F.struct(F.round("_n.distance", 6).alias("d"), "link_id")
    loc = F.coalesce(F.try_divide(F.col("_n.along"), g.length(F.col("geom"))), F.lit(0.0))
    return rows.groupBy("stop_id").agg(F.min_by(F.struct("link_id", F.col("_n.distance").alias("dist"), loc.alias("loc")), order).alias("_b")).select("stop_id", "_b.*")
