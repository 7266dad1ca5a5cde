"""Edges in any order and direction put together to lines: list ranking by pointer doubling.

Every edge e is two arcs, 2e along it and 2e + 1 against it. Where exactly two arcs leave an
inner vertex, what arrives by the reverse of one goes on by the other. So arcs form lists, each
with its mirror; doubling the pointers gives every arc the end of its list and its distance from
there, in rounds that grow with the logarithm of the longest list. Lists without
an end are rings; they are found when a round neither ends a list nor finds a smaller vertex, and
are cut at their smallest vertex. Nothing is gathered before lines are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.sources.folders import Steps


def successors(edges: DataFrame, outer: DataFrame | None = None) -> DataFrame:
    """arc, next (null at a list's end), to (the vertex where the arc arrives). edges: edge_id, a, b.

    Vertices of `outer` (column v) end lists, as do those where not exactly two arcs leave.
    """
    arcs = edges.select(F.explode(F.array(F.struct((2 * F.col("edge_id")).alias("arc"), F.col("a").alias("v"), F.col("b").alias("to")), F.struct((2 * F.col("edge_id") + 1).alias("arc"), F.col("b").alias("v"), F.col("a").alias("to")))).alias("e")).select("e.*")
    inner = arcs.groupBy("v").agg(F.count("*").alias("n"), F.min("arc").alias("p"), F.max("arc").alias("q")).where("n = 2")
    if outer is not None:
        inner = inner.join(outer.select("v").distinct(), "v", "left_anti")
    turn = lambda back, on: F.struct(F.col(back).bitwiseXOR(F.lit(1)).alias("arc"), F.col(on).alias("next"))
    after = inner.select(F.explode(F.array(turn("p", "q"), turn("q", "p"))).alias("e")).select("e.*")
    return arcs.select("arc", "to").join(after, "arc", "left")


def ranked(lists: DataFrame, steps: Steps) -> DataFrame:
    """arc, last (the last arc of its list) and dist (arcs from there). lists: arc, next, to; a written table."""
    end = F.col("next").isNull()
    state = lists.select("arc", "to", F.col("next").alias("jump"), F.when(end, 0).otherwise(1).cast("long").alias("dist"), F.when(end, F.col("arc")).alias("last"), F.col("to").alias("least"))
    done, open_ = [state.where("jump IS NULL")], steps.write(state.where("jump IS NOT NULL"), "open")
    left = open_.count()
    while left:
        ahead = reduce(DataFrame.unionByName, done, open_).select(F.col("arc").alias("jump"), F.col("jump").alias("j"), F.col("dist").alias("d"), F.col("last").alias("l"), F.col("least").alias("m"))
        smaller = F.least("least", "m")
        met = open_.join(ahead, "jump").select("arc", "to", F.col("j").alias("jump"), (F.col("dist") + F.col("d")).alias("dist"), F.col("l").alias("last"), smaller.alias("least"), (smaller < F.col("least")).alias("moved"))
        new = steps.write(met, "ranked")
        found = new.agg(F.count_if(F.col("jump").isNotNull()).alias("left"), F.count_if("moved").alias("moved")).first()
        if found["left"] == left and not found["moved"]:
            rings = lists.join(open_.select("arc", "least"), "arc").select("arc", "to", F.when(F.col("to") != F.col("least"), F.col("next")).alias("next"))
            done.append(ranked(steps.write(rings, "rings"), steps))
            break
        done.append(new.where("jump IS NULL").drop("moved"))
        open_, left = new.where("jump IS NOT NULL").drop("moved"), found["left"]
    return reduce(DataFrame.unionByName, [d.select("arc", "last", "dist") for d in done])


def chains(edges: DataFrame, outer: DataFrame | None = None) -> DataFrame:
    """edge_id, chain, pos (from 1), n (edges of the chain), reversed. edges: edge_id (long, each once), a, b (vertices that compare).

    A chain is named by the smaller one of its two end edges and begins there; a chain of one edge lies along it.
    """
    steps = Steps(edges.sparkSession)
    ranks = ranked(steps.write(successors(edges, outer), "lists"), steps)
    ways = ranks.groupBy(F.shiftright("arc", 1).alias("edge_id")).agg(*[F.max(F.when(F.col("arc") % 2 == d, F.struct(F.shiftright("last", 1).alias("edge"), "dist"))).alias(f"w{d}") for d in (0, 1)])
    back = F.col("w0.edge") < F.col("w1.edge")
    first, ahead = F.least("w0.edge", "w1.edge"), F.when(back, F.col("w0.dist")).otherwise(F.col("w1.dist"))
    out = steps.write(ways.select("edge_id", first.alias("chain"), (ahead + 1).alias("pos"), (F.col("w0.dist") + F.col("w1.dist") + 1).alias("n"), back.alias("reversed")), "chains")
    steps.keep_only(out)
    return out


def joined_lines(parts: Column) -> Column:
    """One line through lines in order; a vertex that two of them share stands there once."""
    meets = lambda i: F.get(F.get(parts, i - 1), F.size(F.get(parts, i - 1)) - 1) == F.get(F.get(parts, i), 0)
    return F.flatten(F.transform(parts, lambda p, i: F.when(F.coalesce(meets(i), F.lit(False)), F.slice(p, 2, F.size(p))).otherwise(p)))


def lines_of_chains(lines: DataFrame, ranks: DataFrame, *keys: str) -> DataFrame:
    """One line a chain: keys, chain, n_edges, geom. It runs as most of its edges do (of equals: from its smaller end edge)."""
    part = F.when(F.col("reversed"), g.reverse(F.col("geom"))).otherwise(F.col("geom"))
    rows = lines.select(*keys, "edge_id", "geom").join(ranks, "edge_id").withColumn("geom", part)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "geom"))), lambda p: p["geom"])
    merged = rows.groupBy(*keys, "chain").agg(F.count("*").alias("n_edges"), parts.alias("parts"), (2 * F.count_if("reversed") > F.count("*")).alias("turned"))
    line = joined_lines(F.col("parts"))
    return merged.select(*keys, "chain", "n_edges", F.when(F.col("turned"), g.reverse(line)).otherwise(line).alias("geom"))


def merge_lines(lines: DataFrame, group: str, grid: float = 0.001) -> DataFrame:
    """Lines of each group merged where exactly two of its ends meet: group, chain, n_edges, geom.

    lines: group, edge_id (long, each once), geom. Ends meet where they are equal after all points have been
    snapped to the grid. Rings begin at their smallest (x, y). Lines without two different points are left out.
    """
    snapped = lines.select(group, "edge_id", g.snap_to_grid(F.col("geom"), grid).alias("geom")).where(F.size("geom") > 1)
    at = lambda end: F.struct(F.col(group), end(F.col("geom")).alias("p"))
    ranks = chains(snapped.select("edge_id", at(g.start_point).alias("a"), at(g.end_point).alias("b")))
    return lines_of_chains(snapped, ranks, group)
