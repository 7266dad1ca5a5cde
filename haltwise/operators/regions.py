"""Shortest paths on networks of any size: searches within regions, labels across their borders.

Nodes are dealt to regions of a bounded number of nodes, in the order of their ids (which
`network.nodes_of_links` gives by place). A round settles, for each source, what it can
reach inside the regions that its new labels have come to, and sends a label over every edge that leaves
them. A label that is no better than the one its node has, or costs more than the source's
farthest target, goes no further; so rounds grow with the borders on a path, not with
its links, and between rounds only labels of border nodes and targets are kept. A task
holds one region's edges and one source's labels there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.operators.network import LINKS_AT_ONCE, numbered
from haltwise.operators.routing import Graph, search
from haltwise.sources.folders import Steps

#: Nodes of a region, and sources that share a task's region.
REGION_NODES, SOURCES_AT_ONCE = 50_000, 500
#: What comes to a region's task, in this order: its edges, then by source its targets there and its labels.
_IN = "region long, slot long, source long, node long, cost double, path array<long>, top double, link long, other long, away long"
_OUT = "source long, node long, region long, cost double, path array<long>"


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _IN sorted by region, slot and source (edges have none and come first) to labels: with a region over borders, without one at targets."""
    key = graph = at = None
    edges: list[tuple] = []
    targets: set[int] = set()
    starts: dict[int, tuple[float, tuple[int, ...]]] = {}
    away: dict[int, list[tuple[float, int, int, int]]] = {}
    limit = float("inf")

    def labels() -> Iterator[tuple]:
        if not starts:
            return
        for n, (c, p) in search(graph, starts, limit=limit).items():
            if n in targets:
                yield at, n, None, c, list(p)
            for step, link, j, region in away.get(n, ()):
                if c + step <= limit:
                    yield at, j, region, c + step, [*p, link]

    for b in batches:
        out: list[tuple] = []
        for region, slot, source, node, cost, path, top, link, other, other_region in zip(*(c.to_pylist() for c in b.columns)):
            if (region, slot) != key or source != at:
                out.extend(labels())
                targets, starts, at = set(), {}, source
                if (region, slot) != key:
                    key, edges, away, graph = (region, slot), [], {}, None
            if source is None:
                if other_region == region:
                    edges.append((node, other, link, cost))
                else:
                    away.setdefault(node, []).append((cost, link, other, other_region))
                continue
            if graph is None:
                cols = list(zip(*edges)) or [(), (), (), ()]
                graph = Graph(*(np.array(c, t) for c, t in zip(cols, (np.int64, np.int64, np.int64, np.float64))))
                edges = []
            if path is None:
                targets.add(node)
            else:
                limit = float("inf") if top is None else top
                label = (cost, tuple(path))
                starts[node] = min(label, starts.get(node, label))
        if out:
            yield _rows(out)
    yield _rows(list(labels()))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["source", "node", "region", "cost", "path"])


def regions_of(edges: DataFrame, size: int = REGION_NODES) -> DataFrame:
    """(node, region) of all ends of edges: so many nodes each, in the order of their ids."""
    ends = edges.select(F.explode(F.array("i_node", "j_node")).alias("node")).distinct()
    return numbered(ends, "k", F.floor(F.col("node") / LINKS_AT_ONCE), "node").select("node", F.floor((F.col("k") - 1) / size).alias("region"))


def paths_by_region(pairs: DataFrame, edges: DataFrame, size: int = REGION_NODES) -> DataFrame:
    """(i_node, j_node, cost, path_seq, uniq_link_id) of the shortest path of each pair, ties to the smaller link list.

    pairs: i_node, j_node, distinct; edges: i_node, j_node, uniq_link_id, cost, all open.
    """
    steps = Steps(pairs.sparkSession)
    of = steps.write(regions_of(edges, size), "regions")
    at = lambda node, region: of.select(F.col("node").alias(node), F.col("region").alias(region))
    wide = steps.write(edges.join(at("i_node", "region"), "i_node").join(at("j_node", "away"), "j_node"), "edges")
    aims = steps.write(pairs.where("i_node <> j_node").select(F.col("i_node").alias("source"), F.col("j_node").alias("node")).join(of, "node"), "aims")
    sources = aims.select("source").distinct()
    slots = max(1, -(-sources.count() // SOURCES_AT_ONCE))
    slot = F.pmod(F.xxhash64("source"), F.lit(slots))

    # Of each source and node the best label so far; of each source and target too.
    frontier = steps.write(sources.join(at("source", "region"), "source").select("source", F.col("source").alias("node"), "region", F.lit(0.0).alias("cost"), F.array().cast("array<long>").alias("path")), "frontier")
    best, found = frontier, None
    while not frontier.isEmpty():
        tops = aims.select("source", "node") if found is None else aims.select("source", "node").join(found, ["source", "node"], "left")
        top = F.max(F.coalesce(F.lit(float("inf")) if found is None else F.col("cost"), F.lit(float("inf"))))
        tops = steps.write(tops.groupBy("source").agg(top.alias("top")), "tops")
        entries = frontier.join(tops, "source").where("cost <= top")
        visited = entries.select("region", "source").distinct()
        come = entries.unionByName(aims.join(visited, ["region", "source"], "left_semi"), allowMissingColumns=True).withColumn("slot", slot)
        active = come.select("region", "slot").distinct()
        graphs = wide.join(active, "region").select("region", "slot", F.col("i_node").alias("node"), "cost", F.col("uniq_link_id").alias("link"), F.col("j_node").alias("other"), "away")
        names = [f.split()[0] for f in _IN.split(", ")]
        both = come.unionByName(graphs, allowMissingColumns=True).select(*names)
        # Nulls come first: edges before sources; a source's targets (no path) before its labels.
        sent = both.repartition("region", "slot").sortWithinPartitions("region", "slot", "source", F.col("path").isNotNull())
        new = steps.write(sent.mapInArrow(_settled, _OUT), "labels")
        least = lambda df, *keys: df.groupBy(*keys).agg(F.min(F.struct("cost", "path")).alias("_b")).select(*keys, "_b.cost", "_b.path")
        hits = new.where("region IS NULL").select("source", "node", "cost", "path")
        now_found = steps.write(least(hits if found is None else found.unionByName(hits), "source", "node"), "found")
        offers = least(new.where("region IS NOT NULL"), "source", "node", "region")
        known = best.select("source", "node", F.struct("cost", "path").alias("_k"))
        better = offers.join(known, ["source", "node"], "left").where(F.col("_k").isNull() | (F.struct("cost", "path") < F.col("_k"))).drop("_k")
        better = steps.write(better, "frontier")
        now_best = steps.write(least(best.select(*better.columns).unionByName(better), "source", "node", "region"), "best")
        steps.keep_only(of, wide, aims, better, now_best, now_found)
        frontier, best, found = better, now_best, now_found
    if found is None:
        return steps.spark.createDataFrame([], "i_node long, j_node long, cost double, path_seq int, uniq_link_id long")
    rows = found.select(F.col("source").alias("i_node"), F.col("node").alias("j_node"), "cost", F.posexplode("path").alias("k", "uniq_link_id"))
    steps.keep_only(found)
    return rows.select("i_node", "j_node", "cost", (F.col("k") + 1).alias("path_seq"), "uniq_link_id")
