"""Rules for edits in batches against one edit after the other."""

import math
import random

import pytest
from pyspark.sql import functions as F

from haltwise.operators import edits

NODE = "node_id long, x double, y double"
LINK = "link_id long, i_node long, j_node long, oneway boolean, geom array<struct<x:double,y:double>>"
AREA = (300000.0, 6600000.0, 450000.0, 6750000.0)


def test_the_sample_edits(spark):
    """The documented valid and invalid edits, in their order."""
    new = [(1, 385443.0, 6671474.0), (2, 385403.0, 6671479.0), (3, 385103.0, 6671238.0), (4, 385048.0, 6671201.0), (5, 385063.0, 6671180.0), (6, 226574.0, 6928728.0), (7, 385443.5, 6671474.5)]
    nodes, bad = edits.insert_nodes(spark.createDataFrame([], NODE), spark.createDataFrame(new, NODE), AREA)
    assert {(r.node_id, r.reason) for r in bad.collect()} == {(6, "outside the area"), (7, "too close to an existing node")}
    assert {r.node_id for r in nodes.collect()} == {1, 2, 3, 4, 5}
    rows = [
        (1, 1, 2, False, [(385443.0, 6671474.0), (385403.0, 6671479.0)]),
        (2, 2, 2, False, [(385403.0, 6671479.0), (385403.0, 6671479.0)]),
        (4, None, None, False, [(385103.5, 6671238.2), (385048.2, 6671201.3)]),
        (5, None, None, True, [(385048.0, 6671201.0), (385063.0, 6671180.0)]),
        (6, None, None, False, [(385002.0, 6671100.0), (385021.0, 6671143.0)]),
    ]
    links, grown, gone = edits.insert_links(nodes, spark.createDataFrame(rows, LINK))
    assert [(r.link_id, r.reason) for r in gone.collect()] == [(2, "inode must not equal jnode")]
    got = {r.link_id: r for r in links.collect()}
    assert {k: (r.i_node, r.j_node) for k, r in got.items()} == {1: (1, 2), 4: (3, 4), 5: (4, 5), 6: (6, 7)}
    assert [tuple(p) for p in got[4].geom] == [(385103.0, 6671238.0), (385048.0, 6671201.0)]
    assert got[5].rcost == -1 and got[1].rcost == got[1].cost == pytest.approx(math.hypot(40, 5))
    assert {(r.node_id, r.x, r.y) for r in grown.where("node_id > 5").collect()} == {(6, 385002.0, 6671100.0), (7, 385021.0, 6671143.0)}
    asked = spark.createDataFrame([(1, 3, None), (4, None, 3), (5, 99, None), (6, 6, 7)], "link_id long, i_node long, j_node long")
    kept, refused = edits.update_references(links, grown, asked)
    assert {(r.link_id, r.reason) for r in refused.collect()} == {(1, "geom does not start from inode"), (4, "geom does not end to jnode"), (5, "inode does not exist")}
    assert {(r.link_id, r.i_node, r.j_node) for r in kept.collect()} == {(1, 1, 2), (4, 3, 4), (5, 4, 5), (6, 6, 7)}


def near(nodes, x, y):
    found = sorted((math.hypot(x - a, y - b), k) for k, (a, b) in nodes.items() if math.hypot(x - a, y - b) <= 1)
    return found[0][1] if found else None


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_one_after_the_other(spark, seed):
    rnd = random.Random(seed)
    place = lambda: (rnd.randint(0, 24) * 0.45, rnd.randint(0, 24) * 0.45)
    old = {k: (2.0 * k, 3.0 * k) for k in range(4)}
    new = {k: place() for k in range(10, 200)} | {k: (k * 0.9, 100.0) for k in range(200, 220)}
    kept = dict(old)
    for k, p in new.items():
        if near(kept, *p) is None:
            kept[k] = p
    df = lambda d: spark.createDataFrame([(k, *p) for k, p in d.items()], NODE)
    nodes, bad = edits.insert_nodes(df(old), df(new))
    assert {r.node_id: (r.x, r.y) for r in nodes.collect()} == kept
    assert {r.node_id for r in bad.collect()} == new.keys() - kept.keys()


@pytest.mark.parametrize("seed", [3, 4])
def test_links_one_after_the_other(spark, seed):
    rnd = random.Random(seed)
    place = lambda: (rnd.randint(0, 60) * 0.45, rnd.randint(0, 60) * 0.45)
    nodes = {5: (3.0, 3.0), 9: (10.0, 20.0), 2: (15.0, 4.0)}
    rows = [(k, rnd.choice([None, None, 5]), rnd.choice([None, None, 9]), False, [place(), (40.0, 40.0), place()]) for k in range(1, 90)]
    grown, want, loops = dict(nodes), {}, set()
    for k, i, j, _, line in rows:
        refs, made = [], {}
        for given, p in ((i, line[0]), (j, line[-1])):
            ref = near(grown, *p)
            if ref is None:
                ref = given
            if ref is None:
                ref = max(grown) + 1
                grown[ref] = p
            refs.append((ref, grown[ref] if near({ref: grown[ref]}, *p) is not None else p))
        (loops.add(k) if refs[0][0] == refs[1][0] else want.__setitem__(k, refs))
    links, got_nodes, gone = edits.insert_links(spark.createDataFrame([(k, *p) for k, p in nodes.items()], NODE), spark.createDataFrame(rows, LINK))
    assert {r.node_id: (r.x, r.y) for r in got_nodes.collect()} == grown
    assert {r.link_id for r in gone.collect()} == loops
    got = {r.link_id: ((r.i_node, tuple(r.geom[0])), (r.j_node, tuple(r.geom[-1]))) for r in links.collect()}
    assert got.keys() == want.keys()
    for k, refs in want.items():
        for (ref, at), (r, p) in zip(got[k], refs):
            assert ref == r and at == pytest.approx(p)


def test_empty_edits(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0)], NODE)
    kept, bad = edits.insert_nodes(nodes, nodes.limit(0), AREA)
    assert kept.count() == 1 and bad.count() == 0
    links, grown, gone = edits.insert_links(nodes, spark.createDataFrame([], LINK))
    assert (links.count(), grown.count(), gone.count()) == (0, 1, 0)
    many = spark.range(1, 400).select(F.col("id").alias("node_id"), F.lit(7.0).alias("x"), F.lit(7.0).alias("y"))
    assert {r.node_id for r in edits.insert_nodes(nodes, many)[0].collect()} == {1}
