"""Shortest paths over the directed network, and contraction of linear chains.

The edge list of a street network goes with the tasks as long as a count of its rows
keeps a bound; the work, one search per source, is dealt out. Beyond the bound the network is
searched region by region (`regions`), with the same result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Directed edges that are sent with the tasks at most: 24 bytes each, 120 MB in all, and 8 a node.
MAX_EDGES = 5_000_000


class Graph:
    """Directed edges in arrays, those of one node together: nodes (sorted), first (of each node, and the end), links, ends and costs."""

    def __init__(self, i_node: np.ndarray, j_node: np.ndarray, link: np.ndarray, cost: np.ndarray):
        order = np.argsort(i_node, kind="stable")
        self.nodes, first = np.unique(i_node[order], return_index=True)
        self.first = np.append(first, len(order))
        self.links, self.ends, self.costs = link[order], j_node[order], cost[order]

    def leaving(self, node: int) -> Iterable[tuple[float, int, int]]:
        """(cost, link, end) of the edges from a node."""
        k = int(np.searchsorted(self.nodes, node))
        if k == len(self.nodes) or self.nodes[k] != node:
            return ()
        own = slice(int(self.first[k]), int(self.first[k + 1]))
        return zip(self.costs[own].tolist(), self.links[own].tolist(), self.ends[own].tolist())


def open_edges(edges: DataFrame) -> DataFrame:
    """i_node, j_node, uniq_link_id, cost of the edges that can be used: one with a null or negative cost is closed."""
    typed = edges.select(*[F.col(c).cast("long").alias(c) for c in ("i_node", "j_node", "uniq_link_id")], F.col("cost").cast("double").alias("cost")).dropna()
    return typed.where("cost >= 0 AND NOT isnan(cost)")


def graph_of(edges: DataFrame) -> Graph:
    """The graph of open edges, whose number the caller has checked, as it comes to the driver."""
    rows = edges.toArrow()
    return Graph(*(rows.column(c).to_numpy() for c in ("i_node", "j_node", "uniq_link_id", "cost")))


def search(graph: Graph, starts: dict[int, tuple[float, tuple[int, ...]]], targets: set[int] | None = None, limit: float = float("inf")) -> dict[int, tuple[float, tuple[int, ...]]]:
    """Cost and links to each node (or target) reached from labelled starts within a limit; equal costs go to the smaller link list.

    A node keeps its cost and the edge it is reached by, or its label if it is a start; lists are made of these
    edges at the end, and where two ways to a node cost the same. A better list
    of equal cost is passed on like a better cost, so links without a cost are right too.
    """
    cost = {n: c for n, (c, _) in starts.items() if c <= limit}
    by: dict[int, tuple[int, int]] = {}
    heap = [(c, n) for n, c in cost.items()]
    heapq.heapify(heap)
    passed: dict[int, tuple[float, int]] = {}
    changed = dict.fromkeys(cost, 0)
    left = set(targets) if targets is not None else None

    def path(node: int) -> tuple[int, ...]:
        out = []
        while node in by:
            link, node = by[node]
            out.append(link)
        return (*starts[node][1], *reversed(out))

    while heap:
        c, node = heapq.heappop(heap)
        if c > limit:
            break
        if c > cost[node] or passed.get(node) == (c, changed[node]):
            continue
        again = node in passed
        passed[node] = (c, changed[node])
        if left is not None:
            left.discard(node)
            if not left:
                # What costs the same may still give a smaller list.
                limit = c
        for step, link, j in graph.leaving(node):
            new, old = c + step, cost.get(j)
            if new > limit:
                continue
            if old is None or new < old or (new == old and (again if by.get(j) == (link, node) else (*path(node), link) < path(j))):
                cost[j], by[j] = new, (link, node)
                changed[j] = changed.get(j, 0) + 1
                heapq.heappush(heap, (new, j))
    found = passed if targets is None else [t for t in targets if t in passed]
    return {n: (cost[n], path(n)) for n in found}


def shortest(graph: Graph, source: int, targets: set[int] | None = None) -> dict[int, tuple[float, tuple[int, ...]]]:
    """Cost and links from source to each node (or target) reached."""
    return search(graph, {source: (0.0, ())}, targets)


def paths_for_pairs(pairs: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(i_node, j_node, cost, path_seq, uniq_link_id) of the shortest path of each distinct pair; one search per source.

    A pair of equal nodes, or without a path, has no rows. A network of more than max_edges
    edges isn't sent to the tasks as a whole but searched region by region.
    """
    distinct = pairs.select(F.col("i_node").cast("long"), F.col("j_node").cast("long")).dropna().distinct()
    open_ = open_edges(edges)
    if open_.limit(max_edges + 1).count() > max_edges:
        from haltwise.operators.regions import paths_by_region

        return paths_by_region(distinct, open_)
    shared = pairs.sparkSession.sparkContext.broadcast(graph_of(open_))

    def find(df: pd.DataFrame) -> pd.DataFrame:
        source = int(df["i_node"].iloc[0])
        found = shortest(shared.value, source, {int(j) for j in df["j_node"]} - {source})
        return pd.DataFrame([(source, j, c, k, link) for j, (c, p) in found.items() for k, link in enumerate(p, 1)], columns=["i_node", "j_node", "cost", "path_seq", "uniq_link_id"])

    return distinct.groupBy("i_node").applyInPandas(find, "i_node long, j_node long, cost double, path_seq int, uniq_link_id long")


def two_way(links: DataFrame) -> DataFrame:
    """Directed edges of links with a cost and a reverse cost; a negative or null one closes that direction.

    links: link_id, i_node, j_node, cost, rcost. uniq_link_id is twice the link's id, one more against it.
    """
    way = lambda i, j, cost, back: F.struct((2 * F.col("link_id") + back).cast("long").alias("uniq_link_id"), F.lit(bool(back)).alias("link_reversed"), F.col(i).alias("i_node"), F.col(j).alias("j_node"), F.col(cost).cast("double").alias("cost"))
    both = F.explode(F.array(way("i_node", "j_node", "cost", 0), way("j_node", "i_node", "rcost", 1)))
    return links.select("link_id", both.alias("e")).select("link_id", "e.*").where("cost >= 0")


def network_paths(pairs: DataFrame, links: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """Nodes and links of the shortest paths of distinct pairs: i_node, j_node, path_seq, node_id, link_id (-1 at the end), agg_cost before it.

    links as in `two_way`; each source is searched once for all its targets.
    """
    edges = two_way(links)
    steps = paths_for_pairs(pairs, edges, max_edges).join(edges.select("uniq_link_id", "link_id", F.col("i_node").alias("node_id"), F.col("j_node").alias("_to"), F.col("cost").alias("_c")), "uniq_link_id")
    w = Window.partitionBy("i_node", "j_node").orderBy("path_seq")
    so_far = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = steps.select("i_node", "j_node", "path_seq", "node_id", "link_id", (so_far - F.col("_c")).alias("agg_cost"), so_far.alias("_after"), F.lead("path_seq").over(w).isNull().alias("_end"), "_to")
    own = F.struct("path_seq", "node_id", F.col("link_id").cast("long").alias("link_id"), "agg_cost")
    end = F.struct((F.col("path_seq") + 1).alias("path_seq"), F.col("_to").alias("node_id"), F.lit(-1).cast("long").alias("link_id"), F.col("_after").alias("agg_cost"))
    return rows.select("i_node", "j_node", F.explode(F.when(F.col("_end"), F.array(own, end)).otherwise(F.array(own))).alias("e")).select("i_node", "j_node", "e.*")


def via_pairs(vianodes: DataFrame, key: str) -> DataFrame:
    """Consecutive nodes of each route or section: (key, pair_seq, i_node, j_node)."""
    w = Window.partitionBy(key).orderBy("node_seq")
    return vianodes.select(key, F.row_number().over(w).alias("pair_seq"), F.col("node_id").alias("i_node"), F.lead("node_id").over(w).alias("j_node")).where(F.col("j_node").isNotNull())


def paths_via_nodes(vianodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Links of the path through each key's nodes in order: (key, link_seq, link_id, link_reversed).

    If any consecutive pair has no path (or is one node twice) the key has no
    rows; so has a key with a missing node. Pairs are routed once however many
    keys share them.
    """
    bad_nodes = vianodes.where(F.col("node_id").isNull()).select(key).distinct()
    pairs = via_pairs(vianodes.join(bad_nodes, key, "left_anti"), key)
    paths = paths_for_pairs(pairs, edges)
    routed = paths.select("i_node", "j_node").distinct()
    failed = pairs.join(routed, ["i_node", "j_node"], "left_anti").select(key).distinct()
    steps = pairs.join(failed, key, "left_anti").join(paths, ["i_node", "j_node"]).join(edges.select("uniq_link_id", "link_id", "link_reversed"), "uniq_link_id")
    seq = F.row_number().over(Window.partitionBy(key).orderBy("pair_seq", "path_seq"))
    return steps.select(key, seq.alias("link_seq"), "link_id", "link_reversed")


def replace_paths(current: DataFrame, keys: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """current with the rows of `keys` replaced by new ones: also emptied where there are none; unknown keys are skipped by the caller's keys."""
    return current.join(keys.select(key).distinct(), key, "left_anti").unionByName(new.select(*current.columns))


def contract_chains(links: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """(link_id, chain_id): links joined through nodes of degree two form one chain, named by its smallest link.

    links: link_id, i_node, j_node. Labels spread along chains by pointer
    jumping until nothing changes, so rounds grow with the logarithm of a
    chain's length.
    """
    from haltwise.operators.chains import smallest_labels

    ends = links.select("link_id", F.explode(F.array("i_node", "j_node")).alias("node"))
    inner = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("link_id").alias("a"), F.max("link_id").alias("b")).where("n = 2 AND a <> b")
    if forbidden is not None:
        inner = inner.join(forbidden.select(F.col("node_id").alias("node")), "node", "left_anti")
    labels = smallest_labels(inner.select(F.col("a").alias("v"), F.col("b").alias("u")))
    return links.join(labels.select(F.col("node").alias("link_id"), "label"), "link_id", "left").select("link_id", F.coalesce("label", "link_id").alias("chain_id"))
