"""Edits of the network as batch functions: patches, moves, snapping, splits, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.operators.network import link_cells


def patch(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """rows with the values of a small table of corrections where it has them (null: no correction)."""
    fixed = [c for c in patches.columns if c != key]
    p = patches.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in fixed])
    joined = rows.join(p, rows[key] == p["_k"], "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fixed else rows[c] for c in rows.columns])


def within_box(nodes: DataFrame, x_low: float, y_low: float, x_high: float, y_high: float) -> tuple[DataFrame, DataFrame]:
    """(nodes inside the box, nodes outside)."""
    inside = F.col("x").between(x_low, x_high) & F.col("y").between(y_low, y_high)
    return nodes.where(inside), nodes.where(~inside)


def move_nodes(links: DataFrame, moves: DataFrame) -> DataFrame:
    """Links stretched so that moved nodes (node_id, x, y) are their ends again; the other end stays."""
    at = lambda end: moves.select(F.col("node_id").alias(f"{end}_node"), g.point(F.col("x"), F.col("y")).alias(f"_{end}"))
    line = F.col("geom")
    moved_i = links.join(at("i"), "i_node", "left").withColumn("geom", g.stretched(line, g.end_point(line), g.start_point(line), F.col("_i")))
    moved_j = moved_i.join(at("j"), "j_node", "left").withColumn("geom", g.stretched(line, g.start_point(line), g.end_point(line), F.col("_j")))
    return moved_j.select(*links.columns)


def record_history(old: DataFrame, new: DataFrame, key: str, value: str, history: str) -> DataFrame:
    """new values with the old ones appended to the history where they changed."""
    o = old.select(key, F.col(value).alias("_old"), F.col(history).alias("_h"))
    joined = new.select(key, value).join(o, key, "left")
    have = F.coalesce("_h", F.array().cast("array<string>"))
    changed = F.col("_old").isNotNull() & ~F.col(value).eqNullSafe(F.col("_old"))
    return joined.select(key, value, F.when(changed, F.array_append(have, F.col("_old").cast("string"))).otherwise(have).alias(history))


def touching_ends(links: DataFrame, cell: float = 500.0, tolerance: float = 0.01) -> DataFrame:
    """(link_id, other_id, share) where an end of link `other_id` lies on the inside of `link_id`; candidates meet by grid cell."""
    ends = links.select(F.col("link_id").alias("other_id"), F.explode(F.array(g.start_point(F.col("geom")), g.end_point(F.col("geom")))).alias("p"))
    ends = ends.withColumn("_cx", F.floor(F.col("p.x") / cell)).withColumn("_cy", F.floor(F.col("p.y") / cell))
    pairs = link_cells(links.select("link_id", "geom"), cell, tolerance).join(ends, ["_cx", "_cy"]).where("link_id <> other_id")
    n = g.nearest(F.col("geom"), F.col("p"))
    share = F.try_divide(F.col("_n.along"), g.length(F.col("geom")))
    return pairs.withColumn("_n", n).where(F.col("_n.distance") <= tolerance).withColumn("share", share).where((F.col("share") > 1e-9) & (F.col("share") < 1 - 1e-9)).select("link_id", "other_id", "share").distinct()


def cut_out(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Geometries of parts (link_id, part, lo, hi) of links."""
    return parts.join(links.select("link_id", "geom"), "link_id").withColumn("geom", g.substring(F.col("geom"), F.col("lo"), F.col("hi")))


def split_rings(links: DataFrame) -> DataFrame:
    """Closed lines as two halves: link_id, part (0 where open), geom."""
    line = F.col("geom")
    ring = (g.start_point(line) == g.end_point(line)) & (F.size(line) > 2)
    half = lambda part, lo, hi: F.struct(F.lit(part).alias("part"), g.substring(line, F.lit(lo), F.lit(hi)).alias("geom"))
    parts = F.when(ring, F.array(half(1, 0.0, 0.5), half(2, 0.5, 1.0))).otherwise(F.array(F.struct(F.lit(0).alias("part"), line.alias("geom"))))
    return links.select("link_id", F.explode(parts).alias("_p")).select("link_id", "_p.part", "_p.geom")


def cost_of(line: Column, oneway: Column) -> tuple[Column, Column]:
    """(cost, reverse cost) of a link: its length, and -1 backwards on a one-way link."""
    cost = g.length(line)
    return cost, F.when(oneway, F.lit(-1.0)).otherwise(cost)


def linear_locations(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Relative and absolute location of matched points along their segment and pattern. segments: ptid, segno, geom, dist_lo."""
    joined = points.join(segments, ["ptid", "segno"])
    share = g.locate(F.col("geom"), g.point(F.col("x"), F.col("y")))
    return joined.withColumn("seg_rel_loc", share).withColumn("pt_abs_loc", F.col("dist_lo") + F.col("seg_rel_loc") * g.length(F.col("geom"))).drop("geom", "dist_lo")


def transfer_segments(segments: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, report): complete segments whose key is not there yet, and how many were offered and added by journey."""
    whole = segments.where("enter_ts IS NOT NULL AND exit_ts IS NOT NULL AND thru_s >= 0")
    new = whole.join(existing.select("jrnid", "enter_ts"), ["jrnid", "enter_ts"], "left_anti")
    count = lambda df, name: df.groupBy("jrnid").agg(F.count("*").alias(name))
    report = count(segments, "n_offered").join(count(new, "n_added"), "jrnid", "left").select("jrnid", "n_offered", F.coalesce("n_added", F.lit(0)).alias("n_added"))
    return new, report
