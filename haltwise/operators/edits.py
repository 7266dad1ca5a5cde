"""Rules for edits of a network, applied to whole batches as if one edit came after the other.

New nodes and links are taken in the order of their ids; a link's start before its end. What an
earlier edit has put down counts for the later ones: of places closer than a distance the
first one stays, which is a greedy choice made in rounds over pairs that meet by grid cell. A
round settles every place whose earlier neighbours are settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.operators.editing import cost_of, within_box
from haltwise.operators.network import LINKS_AT_ONCE, _grid_join, numbered
from haltwise.sources.folders import Steps

#: Nodes are farther apart than this, and ends of links reach for nodes so near.
SNAP_M = 1.0


def first_apart(places: DataFrame, metres: float = SNAP_M) -> DataFrame:
    """The places (k, x, y) that stay when they are put down in the order of k and one within the distance of an earlier one that stayed is not."""
    steps = Steps(places.sparkSession)
    # Of equal places only the first can stay.
    first = steps.write(places.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.min("k").alias("k")).select("k", "x", "y"), "first")
    met = _grid_join(first.select(F.col("k").alias("hi"), F.col("x").alias("px"), F.col("y").alias("py")), first.select(F.col("k").alias("lo"), F.col("x").alias("nx"), F.col("y").alias("ny")), metres)
    near = met.where((F.col("lo") < F.col("hi")) & (F.hypot(F.col("px") - F.col("nx"), F.col("py") - F.col("ny")) <= metres)).select("lo", "hi")
    pairs, stays, gone = steps.write(near, "pairs"), None, None
    while not pairs.isEmpty():
        # Who is the earlier one of a pair and the later one of none stays, and its later neighbours go.
        sure = pairs.select(F.col("lo").alias("k")).distinct().join(pairs.select(F.col("hi").alias("k")), "k", "left_anti")
        new_gone = steps.write(pairs.join(sure.select(F.col("k").alias("lo")), "lo").select(F.col("hi").alias("k")).distinct(), "gone")
        gone = new_gone if gone is None else gone.unionByName(new_gone)
        rest = pairs.join(new_gone.select(F.col("k").alias("lo")), "lo", "left_anti").join(new_gone.select(F.col("k").alias("hi")), "hi", "left_anti")
        pairs = steps.write(rest.select("lo", "hi"), "pairs")
    stays = first if gone is None else first.join(gone, "k", "left_anti")
    out = steps.write(stays, "stays")
    steps.keep_only(out)
    return out


def nearest_earlier(places: DataFrame, nodes: DataFrame, metres: float = SNAP_M) -> DataFrame:
    """(k, node_id, x, y): the nearest node within the distance of each place (k, px, py); of equally near ones the smaller id.

    nodes: node_id, x, y, and since: only places of a larger k see the node (null: all do).
    """
    met = _grid_join(places.select("k", "px", "py"), nodes.select("node_id", "since", F.col("x").alias("nx"), F.col("y").alias("ny")), metres)
    d = F.hypot(F.col("px") - F.col("nx"), F.col("py") - F.col("ny"))
    seen = met.where((d <= metres) & (F.col("since").isNull() | (F.col("since") <= F.col("k"))))
    return seen.groupBy("k").agg(F.min_by(F.struct("node_id", F.col("nx").alias("x"), F.col("ny").alias("y")), F.struct(d, "node_id")).alias("n")).select("k", "n.*")


def insert_nodes(nodes: DataFrame, new: DataFrame, box: tuple[float, float, float, float] | None = None, metres: float = SNAP_M) -> tuple[DataFrame, DataFrame]:
    """(nodes with the new ones that keep the rules, the others with a reason). node_id, x, y; ids of new nodes are their order.

    Reasons: outside the area (x_low, y_low, x_high, y_high), or too close to a node that was there or came before.
    """
    inside, outside = within_box(new, *box) if box else (new, new.limit(0))
    places = inside.select(F.col("node_id").alias("k"), F.col("x").alias("px"), F.col("y").alias("py"))
    taken = nearest_earlier(places, nodes.select("node_id", "x", "y", F.lit(None).cast("long").alias("since")), metres)
    free = inside.join(taken.select(F.col("k").alias("node_id")), "node_id", "left_anti")
    stays = first_apart(free.select(F.col("node_id").alias("k"), "x", "y"), metres).select(F.col("k").alias("node_id"), "x", "y")
    close = inside.join(stays.select("node_id"), "node_id", "left_anti").withColumn("reason", F.lit("too close to an existing node"))
    return nodes.select("node_id", "x", "y").unionByName(stays), close.unionByName(outside.withColumn("reason", F.lit("outside the area")))


def insert_links(nodes: DataFrame, links: DataFrame, metres: float = SNAP_M) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links with references, geometry, cost and reverse cost; nodes with those created; links discarded with a reason).

    links: link_id, i_node, j_node (null where not given), oneway, geom; nodes: node_id, x, y. An end goes to the nearest node
    within the distance, and the line is stretched to it; else it keeps the node given; else a node is
    created, numbered after the others in the order of links. A link from a node to itself is discarded; nodes it has created stay.
    """
    steps = Steps(links.sparkSession)
    end = lambda no, at, given: F.struct(F.lit(no).alias("no"), at(F.col("geom")).alias("p"), F.col(given).cast("long").alias("given"))
    ends = links.select("link_id", F.explode(F.array(end(0, g.start_point, "i_node"), end(1, g.end_point, "j_node"))).alias("e")).select((2 * F.col("link_id") + F.col("e.no")).alias("k"), F.col("e.p.x").alias("px"), F.col("e.p.y").alias("py"), "e.given")
    ends = steps.write(ends, "ends")
    there = nodes.select(F.col("node_id").cast("long").alias("node_id"), "x", "y", F.lit(None).cast("long").alias("since"))
    near = steps.write(nearest_earlier(ends, there, metres), "near")
    rest = steps.write(ends.join(near.select("k"), "k", "left_anti"), "rest")
    free = rest.where("given IS NULL")
    made = first_apart(free.select("k", F.col("px").alias("x"), F.col("py").alias("y")), metres)
    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0)).cast("long").alias("top"))
    created = numbered(made, "n", F.floor(F.col("k") / LINKS_AT_ONCE), "k").join(F.broadcast(top)).select((F.col("top") + F.col("n")).alias("node_id"), "x", "y", F.col("k").alias("since"))
    created = steps.write(created, "created")
    own = nearest_earlier(rest, created, metres)
    refs = near.unionByName(own).select("k", F.col("node_id").alias("ref"), g.point(F.col("x"), F.col("y")).alias("at"))
    refs = steps.write(ends.select("k", "given").join(refs, "k", "left").select("k", F.coalesce("ref", "given").alias("ref"), "at"), "refs")
    of = lambda no, name: refs.where(F.col("k") % 2 == no).select(F.floor(F.col("k") / 2).alias("link_id"), F.col("ref").alias(f"{name}_node"), F.col("at").alias(f"_{name}"))
    met = links.drop("i_node", "j_node").join(of(0, "i"), "link_id").join(of(1, "j"), "link_id")

    line = F.col("geom")
    met = met.withColumn("geom", g.stretched(line, g.end_point(line), g.start_point(line), F.col("_i"))).withColumn("geom", g.stretched(line, g.start_point(line), g.end_point(line), F.col("_j")))
    cost, back = cost_of(line, F.col("oneway"))
    out = steps.write(met.drop("_i", "_j").withColumn("cost", cost).withColumn("rcost", back), "links")
    grown = nodes.select(F.col("node_id").cast("long").alias("node_id"), "x", "y").unionByName(created.select("node_id", "x", "y"))
    steps.keep_only(out, created)
    loop = F.coalesce(F.col("i_node") == F.col("j_node"), F.lit(False))
    return out.where(~loop), grown, out.where(loop).withColumn("reason", F.lit("inode must not equal jnode"))


def update_references(links: DataFrame, nodes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with the references that keep the rules, edits refused with a reason). edits: link_id, i_node, j_node (null: as it is), each link once.

    The nodes have to exist, to lie exactly at the line's ends, and to differ.
    """
    at = lambda name: nodes.select(F.col("node_id").alias(f"_{name}"), g.point(F.col("x"), F.col("y")).alias(f"_{name}_at"))
    asked = edits.select("link_id", F.col("i_node").alias("_ei"), F.col("j_node").alias("_ej"))
    new = links.join(asked, "link_id").withColumn("_i", F.coalesce("_ei", "i_node")).withColumn("_j", F.coalesce("_ej", "j_node")).join(at("i"), "_i", "left").join(at("j"), "_j", "left")
    line = F.col("geom")
    reason = (
        F.when(F.col("_i_at").isNull(), "inode does not exist")
        .when(g.start_point(line) != F.col("_i_at"), "geom does not start from inode")
        .when(F.col("_j_at").isNull(), "jnode does not exist")
        .when(g.end_point(line) != F.col("_j_at"), "geom does not end to jnode")
        .when(F.col("_i") == F.col("_j"), "inode must not equal jnode")
    )
    judged = new.withColumn("reason", reason)
    done = judged.where("reason IS NULL").select("link_id", "_i", "_j")
    out = links.join(done, "link_id", "left")
    kept = out.select(*[F.coalesce(F.col(f"_{c[0]}"), F.col(c)).alias(c) if c in ("i_node", "j_node") else F.col(c) for c in links.columns])
    return kept, judged.where("reason IS NOT NULL").select("link_id", F.col("_i").alias("i_node"), F.col("_j").alias("j_node"), "reason")
