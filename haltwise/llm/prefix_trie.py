"""The trie of all prefixes of conversations, by ROLLUP over positional columns of turn ids.

A turn's id is 128 bits of the SHA-256 of its role and text, with its text's
bytes beside it. A conversation is cut into blocks of COLUMNS turns, one row a
block with one column a position; a block is keyed by the node that the block
before ends at. One ROLLUP over the positions gives the nodes of all blocks at
once, grouping_id() tells how deep in its block a node lies. A node's key is
the exclusive or of 128 bits for each (position, turn) on its way, so that a block's
key is a running value along its conversation and no conversation is ever
gathered in one row.

A node is named by its smallest member c and its depth. Whatever lies deeper on
c's own way has c as its smallest member too, so the nodes of one name form a
chain, and only a chain's top has a parent of another name. Sums over subtrees
are sums along chains plus those of the chains that hang there; these are added up the
tree of chains by pointer doubling, whose rounds grow with the logarithm of its height.

The digest of the conversations that end at a node is made from pieces of sorted
ids: rows dealt by range become pieces where they lie, and a node's pieces pass
through its hash one after the other, so that a node with a third of all
conversations needs no list of them.

Defined results: a null role or text is empty; rows without an id belong to no
conversation and are left out; turns go by `turn` (null first), then role, then text, and rows
repeated in full are turns of their own; an id without turns is a member of the root; no
conversation, no node. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltwise.llm.common import Tables, crc_mod, stash

#: Turns in a block: so many positions are columns of the ROLLUP.
COLUMNS = 8
#: A rebuilt conversation takes fewer than so many turns of the first of so many ids.
HEADS, GROUP = 9, 5
_T = [f"t{i}" for i in range(1, COLUMNS + 1)]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), role, text of all turns with an id."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("pos", F.row_number().over(order).cast("long") - 1).select("conv_id", "pos", "role", "text")


def with_ids(turns: DataFrame) -> DataFrame:
    """conv_id, pos and the turn's id (a, b, bytes of the text) in place of role and text."""
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    part = lambda start: F.conv(F.substring(digest, start, 16), 16, -10).cast("long")
    return turns.select("conv_id", "pos", F.struct(part(1).alias("a"), part(17).alias("b"), F.octet_length("text").cast("long").alias("bytes")).alias("turn"))


def _key_of(pos: Column, turn: Column) -> tuple[Column, Column]:
    """What a turn at a position adds to the keys of all nodes below."""
    return tuple(F.xxhash64(F.lit(half), pos, turn["a"], turn["b"]) for half in (1, 2))


def _blocks(turns: DataFrame, convs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(blocks: conv_id, block, px, py, t1.., ends: conv_id, kx, ky)."""
    w = Window.partitionBy("conv_id").orderBy("pos")
    x, y = _key_of(F.col("pos"), F.col("turn"))
    so_far = lambda c: F.bit_xor(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    lead = [F.lead("turn", i).over(w).alias(t) for i, t in enumerate(_T[1:], 1)]
    seen = turns.select("conv_id", "pos", x.alias("x"), y.alias("y"), so_far(x).alias("kx"), so_far(y).alias("ky"), F.col("turn").alias(_T[0]), *lead)
    laid = tables.write(seen.where((F.col("pos") % COLUMNS == 0) | F.col(_T[1]).isNull()), "laid")
    first = laid.where(F.col("pos") % COLUMNS == 0)
    blocks = first.select("conv_id", F.floor(F.col("pos") / COLUMNS).alias("block"), F.col("kx").bitwiseXOR(F.col("x")).alias("px"), F.col("ky").bitwiseXOR(F.col("y")).alias("py"), *_T)
    bare = convs.join(first.where("pos = 0").select("conv_id"), "conv_id", "left_anti").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("block", "px", "py")])
    ends = laid.where(F.col(_T[1]).isNull()).select("conv_id", "kx", "ky")
    return blocks.unionByName(bare, allowMissingColumns=True), ends.unionByName(bare.select("conv_id", F.col("px").alias("kx"), F.col("py").alias("ky")))


def _nodes(blocks: DataFrame) -> DataFrame:
    """conv_id, depth, n_convs, weight, keys of the node and its parent, from one ROLLUP."""
    names = ", ".join(_T)
    rolled = blocks.sparkSession.sql(
        f"""SELECT block, px, py, {names}, {COLUMNS} - bit_count(grouping_id()) AS k, min(conv_id) AS conv_id, count(*) AS n_convs
        FROM {{blocks}} GROUP BY block, px, py, ROLLUP ({names})""",
        blocks=blocks,
    )
    k = F.col("k")
    last = reduce(lambda rest, i: F.when(k == i + 1, F.col(_T[i])).otherwise(rest), range(1, COLUMNS), F.when(k == 1, F.col(_T[0])))
    # A position that a conversation doesn't have is null too, and no node; the root stands in the first block only.
    real = rolled.withColumn("last", last).where(F.col("last").isNotNull() | ((k == 0) & (F.col("block") == 0)))
    keys = {"x": F.col("px"), "y": F.col("py"), "ux": F.col("px"), "uy": F.col("py")}
    for i, t in enumerate(_T):
        for c, z in zip(("x", "y"), _key_of(F.col("block") * COLUMNS + i, F.col(t))):
            keys[c] = keys[c].bitwiseXOR(F.when(k > i, z).otherwise(F.lit(0)))
            keys[f"u{c}"] = keys[f"u{c}"].bitwiseXOR(F.when(k > i + 1, z).otherwise(F.lit(0)))
    weight = (F.col("n_convs") - 1) * F.coalesce("last.bytes", F.lit(0))
    return real.select("conv_id", (F.col("block") * COLUMNS + k).cast("long").alias("depth"), "n_convs", weight.alias("weight"), keys["x"].alias("kx"), keys["y"].alias("ky"), keys["ux"].alias("ux"), keys["uy"].alias("uy"))


def _totals(sums: DataFrame, tables: Tables) -> DataFrame:
    """(c, leaves, saved) of each chain with all that hang below it; sums: c, up, leaves, saved."""
    now = tables.write(sums, "chains")
    while not now.where("up IS NOT NULL").isEmpty():
        sent = now.where("up IS NOT NULL").groupBy(F.col("up").alias("c")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        upper = now.where("up IS NOT NULL").select(F.col("c").alias("up"), F.col("up").alias("next"))
        grown = now.join(sent, "c", "left").join(upper, "up", "left")
        new = tables.write(grown.select("c", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "chains")
        tables.drop(now)
        now = new
    return now.drop("up")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one node as pieces of text: kx, ky, first id, ids joined by commas."""
    for b in batches:
        kx, ky, ids = (b.column(i).to_numpy() for i in range(3))
        if not len(ids):
            continue
        start = np.flatnonzero(np.r_[True, (kx[1:] != kx[:-1]) | (ky[1:] != ky[:-1])])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(ids)], pa.int32()), pc.cast(b.column(2), pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(kx[start]), pa.array(ky[start]), pa.array(ids[start]), pc.binary_join(lists, ",")], names=["kx", "ky", "first", "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a node over its pieces in order: a task holds a batch and the state of one hash."""
    key, state = None, None
    for b in batches:
        done: list[tuple[int, int, str]] = []
        for x, y, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
            if (x, y) == key:
                state.update(b"," + piece.encode())
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = (x, y), hashlib.sha256(piece.encode())
        yield _digest_rows(done)
    if key is not None:
        yield _digest_rows([(*key, state.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["kx", "ky", "ends_sha256"])


def _end_digests(ends: DataFrame) -> DataFrame:
    """(kx, ky, ends_sha256) of the nodes where conversations end."""
    dealt = ends.select("kx", "ky", "conv_id").repartitionByRange("kx", "ky", "conv_id").sortWithinPartitions("kx", "ky", "conv_id")
    pieces = dealt.mapInArrow(_pieces, "kx long, ky long, first long, piece string")
    return pieces.repartition("kx", "ky").sortWithinPartitions("kx", "ky", "first").mapInArrow(_digests, "kx long, ky long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (see the module).

    turns: conv_id, pos (from 0 without gaps), turn as `with_ids` makes it; convs: all conv_ids, once each.
    saved_tokens: what sharing the subtree's turns saves, in bytes of texts.
    """
    with Tables(turns.sparkSession) as tables:
        blocks, ends = _blocks(turns, convs, tables)
        nodes = tables.write(_nodes(blocks), "nodes")
        own = Window.partitionBy("conv_id").orderBy("depth")
        marked = nodes.withColumn("top", F.lag("depth").over(own).isNull()).withColumn("more", F.lead("depth").over(own).isNotNull())
        marked = tables.write(marked, "marked")
        tops = marked.where("top AND depth > 0").select(F.col("conv_id").alias("c"), F.col("ux").alias("kx"), F.col("uy").alias("ky"))
        hung = tables.write(tops.join(marked.select("kx", "ky", F.col("conv_id").alias("up"), F.col("depth").alias("at")), ["kx", "ky"]).select("c", "up", "at"), "hung")

        here = lambda df: df.withColumnsRenamed({"up": "conv_id", "at": "depth"})
        branches = here(hung.groupBy("up", "at").agg(F.count("*").alias("hung")))
        valued = marked.drop("ux", "uy").join(branches, ["conv_id", "depth"], "left").withColumn("n_children", F.col("more").cast("long") + F.coalesce("hung", F.lit(0)))
        valued = tables.write(valued.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "valued")
        sums = valued.groupBy(F.col("conv_id").alias("c")).agg(F.sum("leaf").alias("leaves"), F.sum("weight").alias("saved"))
        totals = _totals(sums.join(hung, "c", "left").select("c", "up", "leaves", "saved"), tables)
        below = here(hung.join(totals, "c").groupBy("up", "at").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")))

        deeper = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
        up_to = lambda c, more: F.sum(F.col(c) + F.coalesce(more, F.lit(0))).over(deeper)
        summed = valued.join(below, ["conv_id", "depth"], "left").withColumn("n_leaves", up_to("leaf", "l")).withColumn("saved_tokens", up_to("weight", "s"))
        named = summed.join(hung.select(F.col("c").alias("conv_id"), "up"), "conv_id", "left")
        parent = F.when(~F.col("top"), F.col("conv_id")).otherwise(F.col("up"))
        out = named.join(_end_digests(ends), ["kx", "ky"], "left").select(
            "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
        )
        return stash(out, "trie")


def node_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes with the role and text of their last turn; turns: conv_id, pos, role, text. The root has neither."""
    at = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "role", "text")
    return nodes.join(at, ["conv_id", "depth"], "left")


def trie_of(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are (columns conv_id, turn, role, text)."""
    convs = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return prefix_trie(with_ids(numbered_turns(conversations)), convs)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): each conversation c begins with the first h turns of c - c % GROUP and goes on with its own after its first h.

    turns: conv_id, pos, turn. Only turn ids move, and of each conversation HEADS - 1 of them at most as a beginning.
    """
    h = crc_mod("conv_id", HEADS)
    heads = turns.where(F.col("pos") < HEADS - 1).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "turn"))).alias("head"))
    convs = turns.select("conv_id").distinct()
    whose = convs.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    begun = whose.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").select("conv_id", "h", F.coalesce(F.slice("head", 1, F.col("h").cast("int")), F.array().cast(heads.schema["head"].dataType)).alias("head"))
    taken = begun.select("conv_id", F.explode("head").alias("_t")).select("conv_id", "_t.*")
    left = turns.join(begun.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "turn")
    return taken.unionByName(left), convs


def op11_prefix_trie(conversations: DataFrame) -> DataFrame:
    with Tables(conversations.sparkSession) as tables:
        turns = tables.write(with_ids(numbered_turns(conversations)), "turns")
        return prefix_trie(*rebuilt(turns))


#: crc32 of a string in UTF-8 in DuckDB, where the one row of `crc` that CRC_TABLE makes is joined.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc_sql(s: str) -> str:
    octets = f"list_transform(range(octet_length(encode({s}))), lambda i: ('0x' || substr(hex(encode({s})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295] || {octets}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE = f"""WITH {CRC_TABLE},
own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, p, {crc_sql("conv_id::VARCHAR")} % {HEADS} AS h FROM own, crc),
paths AS (SELECT a.conv_id, list_concat(coalesce(b.p[1:h], []), a.p[h + 1:]) AS p FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % {GROUP}),
prefixes AS (SELECT conv_id AS c, d, p[1:d] AS p, len(p) = d AS ends FROM (SELECT conv_id, p, unnest(range(len(p) + 1)) AS d FROM paths)),
nodes AS (SELECT p, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM prefixes GROUP BY p),
linked AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.p[1:n.depth] = n.p) AS n_children FROM nodes n LEFT JOIN nodes u ON n.depth > 0 AND u.p = n.p[1:n.depth - 1] AND u.depth = n.depth - 1),
below AS (SELECT p[1:d] AS p, d, sum((n_children = 0)::INT) AS n_leaves, sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(p[depth].text)) END) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM linked) GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM linked l JOIN below b ON b.p = l.p AND b.d = l.depth"""
