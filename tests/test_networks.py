"""Line merging, contraction and routing by region against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from haltwise.operators import contraction, linemerge, network, regions, routing
from haltwise.sources.folders import Steps

LINES = "grp string, edge_id long, geom array<struct<x:double,y:double>>"


def merged_by_hand(rows):
    """Sets of (group, edges in order, closed) up to direction, by walking from edge to edge."""
    at = collections.defaultdict(list)
    for grp, e, geom in rows:
        at[(grp, geom[0])].append((e, 0))
        at[(grp, geom[-1])].append((e, 1))
    by = {e: (grp, geom) for grp, e, geom in rows}
    seen, out = set(), set()

    def on(e, end):
        grp, geom = by[e]
        ends = at[(grp, geom[-1] if end else geom[0])]
        other = [x for x in ends if x != (e, end)]
        return other[0] if len(ends) == 2 else None

    def walk(e, end):
        path = [e]
        seen.add(e)
        while (nxt := on(e, 1 - end)) and nxt[0] not in seen:
            e, end = nxt
            seen.add(e)
            path.append(e)
        return path

    for closed in (False, True):
        for _, e, _ in rows:
            for end in (0, 1):
                if e not in seen and (closed or on(e, end) is None):
                    p = walk(e, end)
                    out.add((by[e][0], frozenset(p)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_lines(spark, seed):
    rnd = random.Random(seed)
    rows, k = [], 0
    ids = rnd.sample(range(10_000), 2000)

    def add(grp, a, b, mid=None):
        nonlocal k
        line = [a, b] if mid is None else [a, mid, b]
        rows.append((grp, ids[k], line if rnd.random() < 0.5 else line[::-1]))
        k += 1

    for c, n in enumerate([1, 2, 3, 64, 65, 127]):
        for i in range(n):
            add("chain", (float(i), 10.0 * c), (float(i + 1), 10.0 * c), (i + 0.5, 10.0 * c + 1))
    for c, n in enumerate([1, 2, 3, 8, 33]):
        places = [(float(i), 10.0 * c) for i in range(n)]
        for i in range(n):
            add("ring", places[i], places[(i + 1) % n], (i + 0.5, 10.0 * c - 1))
    for i in range(3):
        add("star", (0.0, 0.0), (1.0 + i, 1.0))
    nodes = [(float(rnd.randint(0, 30)), float(rnd.randint(0, 2))) for _ in range(60)]
    for _ in range(60):
        a, b = rnd.sample(nodes, 2)
        if a != b:
            add("any", a, b)
    rnd.shuffle(rows)
    got = linemerge.merge_lines(spark.createDataFrame(rows, LINES), "grp").collect()
    ranks = linemerge.chains(spark.createDataFrame([(e, (g, *p[0]), (g, *p[-1])) for g, e, p in rows], "edge_id long, a struct<g:string,x:double,y:double>, b struct<g:string,x:double,y:double>"))
    parts = collections.defaultdict(list)
    for r in ranks.collect():
        parts[r.chain].append(r)
    of = {e: g for g, e, _ in rows}
    assert {(of[c], frozenset(r.edge_id for r in rs)) for c, rs in parts.items()} == merged_by_hand(rows)
    lines = {e: p for _, e, p in rows}
    for r in got:
        steps = sorted(parts[r.chain], key=lambda s: s.pos)
        assert [s.pos for s in steps] == list(range(1, r.n_edges + 1)) and {s.n for s in steps} == {r.n_edges} and r.chain == min(steps[0].edge_id, steps[-1].edge_id)
        line = []
        for s in steps:
            part = lines[s.edge_id][::-1] if s.reversed else lines[s.edge_id]
            assert not line or line[-1] == part[0]
            line += part[1:] if line else part
        if 2 * sum(s.reversed for s in steps) > r.n_edges:
            line = line[::-1]
        assert [tuple(p) for p in r.geom] == line
        if r.grp == "ring":
            assert tuple(r.geom[0]) == tuple(r.geom[-1]) == min(p for p in line if p[1] % 10 == 0)


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    names = []
    write = Steps.write
    monkeypatch.setattr(Steps, "write", lambda self, df, name: names.append(name) or write(self, df, name))
    edges = spark.range(0, 1000).select(F.col("id").alias("edge_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = linemerge.chains(edges)
    assert got.where("chain = 0 AND n = 1000 AND pos = edge_id + 1 AND NOT reversed").count() == 1000
    assert names.count("ranked") <= 11


def test_ends_meet_on_the_grid_and_empty_lines_go(spark):
    rows = [("a", 1, [(0.0, 0.0), (1.0, 0.00004)]), ("a", 2, [(2.0, 0.0), (1.0002, 0.0)]), ("a", 3, [(5.0, 5.0), (5.0001, 5.0)]), ("a", 4, None)]
    got = linemerge.merge_lines(spark.createDataFrame(rows, LINES), "grp", 0.001).collect()
    assert [(r.chain, r.n_edges, [tuple(p) for p in r.geom]) for r in got] == [(1, 2, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)])]
    assert linemerge.merge_lines(spark.createDataFrame([], LINES), "grp").count() == 0


def links_of(spark, rows):
    line = F.array(*[F.struct(F.col(c).cast("double").alias("x"), F.lit(0.0).alias("y")) for c in ("i_node", "j_node")])
    return spark.createDataFrame(rows, "link_id long, i_node long, j_node long, oneway boolean, way string, mode string").withColumn("cost", F.lit(1.0)).withColumn("geom", line)


def test_contraction_keeps_forbidden_vertices(spark):
    """One-way and two-way lines, a change between them, opposing one-way links, a crossing, a ring."""
    two, one = (False, "B"), (True, "FT")
    rows = [(101, 1, 2, *two, "tram"), (102, 3, 2, *two, "bus"), (103, 3, 4, *two, "tram")]
    rows += [(104, 4, 5, *one, "bus"), (105, 5, 6, *one, "bus"), (106, 7, 6, *one, "bus")]
    rows += [(107, 20, 21, *two, "bus"), (108, 20, 22, *two, "bus"), (109, 20, 23, *two, "bus"), (110, 30, 31, *two, "bus"), (111, 31, 32, *two, "bus"), (112, 32, 30, *two, "bus")]
    links = links_of(spark, rows)
    made = contraction.linear_contraction(links, contraction.forbidden_vertices(links))
    got = {(r.source, r.target, r.n_edges) for r in made.groups.collect()}
    assert got == {(1, 4, 3), (4, 6, 2), (30, 30, 3)}
    assert {r.grp for r in made.groups.collect()} == {-1, -2, -3}
    out = {(r.id, r.is_contracted): r for r in contraction.contracted_network(links).collect()}
    assert len(out) == 3 + 4
    assert (out[1, True].mode, out[1, True].oneway, out[1, True].n_edges) == ("bus", "B", 3)
    assert [p.x for p in out[2, True].geom] == [4.0, 5.0, 6.0] and out[2, True].oneway == "FT"
    assert {k for k, c in out if not c} == {106, 107, 108, 109}


def graph_rows(seed, zero):
    rnd = random.Random(seed)
    return [(k, rnd.randint(0, 40), rnd.randint(0, 40), float(rnd.choice([0, 1, 1, 2] if zero else [1, 1, 2, 3])), rnd.choice([-1.0, 1.0, 2.0])) for k in range(130)]


@pytest.mark.parametrize(("seed", "zero", "size"), [(1, False, 5), (2, False, 3), (3, True, 5), (4, True, 1000)])
def test_regions_give_the_rows_of_one_search(spark, seed, zero, size):
    edges = routing.two_way(spark.createDataFrame(graph_rows(seed, zero), "link_id long, i_node long, j_node long, cost double, rcost double"))
    pairs = spark.createDataFrame([(i, j) for i in (0, 3, 17, 99) for j in range(0, 41, 2)], "i_node long, j_node long")
    want = {tuple(r) for r in routing.paths_for_pairs(pairs, edges).collect()}
    got = {tuple(r) for r in regions.paths_by_region(pairs, routing.open_edges(edges), size).select("i_node", "j_node", "cost", "path_seq", "uniq_link_id").collect()}
    assert got == want and want


def test_beyond_the_bound_regions_are_searched(spark):
    edges = routing.two_way(spark.createDataFrame(graph_rows(5, False), "link_id long, i_node long, j_node long, cost double, rcost double"))
    pairs = spark.createDataFrame([(1, 2), (5, 9), (5, 5), (None, 3), (2, 77)], "i_node long, j_node long")
    want = {tuple(r) for r in routing.paths_for_pairs(pairs, edges).collect()}
    assert {tuple(r) for r in routing.paths_for_pairs(pairs, edges, max_edges=10).select("i_node", "j_node", "cost", "path_seq", "uniq_link_id").collect()} == want
    assert regions.paths_by_region(pairs.limit(0), routing.open_edges(edges)).count() == 0


def test_network_paths_with_reverse_costs(spark):
    links = spark.createDataFrame([(1, 10, 11, 5.0, -1.0), (2, 12, 11, 9.0, 2.0), (3, 10, 12, 8.0, 1.0)], "link_id long, i_node long, j_node long, cost double, rcost double")
    pairs = spark.createDataFrame([(10, 12), (12, 10), (11, 10)], "i_node long, j_node long")
    got = sorted(tuple(r) for r in routing.network_paths(pairs, links).collect())
    assert got == [(10, 12, 1, 10, 1, 0.0), (10, 12, 2, 11, 2, 5.0), (10, 12, 3, 12, -1, 7.0), (11, 10, 1, 11, 2, 0.0), (11, 10, 2, 12, 3, 2.0), (11, 10, 3, 10, -1, 3.0), (12, 10, 1, 12, 3, 0.0), (12, 10, 2, 10, -1, 1.0)]


def test_contracted_links_have_long_chains(spark):
    """All 40 links of the network, and the 22 of its rows, whose chains are longer than the two links at a corner."""
    from haltwise.plans import catalog

    sizes = catalog.queries()["contracted_links"](spark, "/root/testdata/sf0.001").groupBy("chain_id").count().collect()
    assert sum(r["count"] for r in sizes) == 62 and max(r["count"] for r in sizes) > 2


def test_places_of_stops_are_worked_out_before_they_meet_sections(spark):
    line = "link_id long, link_reversed boolean, geom array<struct<x:double,y:double>>"
    links = spark.createDataFrame([(1, False, [(0.0, 0.0), (10.0, 0.0)]), (1, True, [(10.0, 0.0), (0.0, 0.0)])], line)
    stops = spark.createDataFrame([(7, 1, False, 0.25), (8, 1, True, 0.25), (9, 2, False, 0.5)], "stop_id long, link_id long, link_reversed boolean, location_on_link double")
    rows = spark.createDataFrame([(s, 1, 1, s == 2) for s in (1, 2, 3)], "section_id long, link_seq int, link_id long, link_reversed boolean")
    placed = network.stop_places(stops, links)
    got = network.section_stop_places(rows, placed)
    assert sorted((r.section_id, r.stop_id, r.place.x, r.place.y) for r in got.collect()) == [(1, 7, 2.5, 0.0), (2, 8, 7.5, 0.0), (3, 7, 2.5, 0.0)]
    # Sections are not shuffled to meet few stops.
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
