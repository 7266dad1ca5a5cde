"""Near duplicates by SimHash fingerprints, searched in BK-trees.

A fingerprint has 64 bits: each the majority of that bit over the XXH64 hashes of
a text's word shingles. Texts with one fingerprint are one class; classes whose
fingerprints differ in `radius` bits at most are linked.

In a BK-tree each child hangs at its parent by its distance from it, an integer;
by the triangle inequality a search at distance d from a node need only follow the
edges from d - radius to d + radius. Fingerprints of unrelated texts are all
about 32 bits apart, where such a tree alone would be walked as a whole. So the trees are sharded: the
bits are cut into radius + 2 blocks, of which two at least are equal in any linked
pair, and each pair of blocks deals the fingerprints to shards by its value. A shard of
more than SHARD fingerprints becomes several trees, and each of them is sent to the others'
tasks by a join on the shard, so no link is lost. Trees go by joins and not
through the driver, which may not hold the fingerprints of all documents.

Each task gives a forest of what it has linked, not the pairs; union-find with hooking and
pointer jumping makes components of the forests.

Defined results: a null or empty text, or one without words, has fingerprint zero, linked
like any other; fewer words than a shingle's length are one shingle; repeated rows and
rows that repeat an id are documents of their own; rows without an id have a fingerprint and
link others, and are named by those with an id (null if there are none). Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.llm.common import Tables, settings, stash, text_bytes
from haltwise.llm.near_duplicates import components

WORDS, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a tree, about; trees in a batch; pairs of a search and a node that are held at a time.
SHARD, TREES_AT_ONCE, VISITS_AT_ONCE = 4096, "256", 1 << 19
TEXTS_AT_ONCE = "2000"
#: Set bits of each byte, and texts' shingles from which bytes are counted before bits.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_MANY = 256


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included; A-Z lowered, words joined by one space."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(words, len(ends)) - 1 :])], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < _MANY:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t")).mapInArrow(_prints(words), "doc_id long, fp long")


class Forest:
    """BK-trees over fingerprints, tree k over rows bounds[k]..bounds[k + 1] - 1, all grown and searched level by level."""

    def __init__(self, prints: np.ndarray, bounds: np.ndarray):
        self.prints, self.bounds = prints, bounds
        n = len(prints)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at = np.repeat(bounds[:-1], np.diff(bounds))
        left = np.flatnonzero(at != np.arange(n))
        while len(left):
            code = at[left] * 128 + np.bitwise_count(prints[left] ^ prints[at[left]])
            order = np.argsort(code, kind="stable")
            left, code = left[order], code[order]
            first = np.r_[True, code[1:] != code[:-1]]
            child = left[first]
            parent[child], edge[child] = code[first] >> 7, code[first] & 127
            at[left] = child[np.cumsum(first) - 1]
            left = left[~first]
        inner = np.flatnonzero(parent >= 0)
        codes = parent[inner] * 128 + edge[inner]
        order = np.argsort(codes, kind="stable")
        #: Edges (parent, distance) in order, and the children they lead to.
        self.codes, self.children = codes[order], inner[order]

    def near(self, queries: np.ndarray, trees: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query's number, row) within the radius; query i is sought in tree trees[i]."""
        sizes = np.cumsum(np.diff(self.bounds)[trees])
        for some in np.split(np.arange(len(queries)), np.searchsorted(sizes, np.arange(VISITS_AT_ONCE, sizes[-1] if len(sizes) else 0, VISITS_AT_ONCE))):
            q, node = some, self.bounds[trees[some]]
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.prints[node]).astype(np.int64)
                hit = d <= radius
                yield q[hit], node[hit]
                low = np.searchsorted(self.codes, node * 128 + np.maximum(d - radius, 0))
                many = np.searchsorted(self.codes, node * 128 + np.minimum(d + radius, 127), side="right") - low
                ahead = np.cumsum(many) - many
                node = self.children[np.repeat(low - ahead, many) + np.arange(many.sum())]
                q = np.repeat(q, many)


def _unite(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the sets of u and v in root, which gives each row the smallest row of its set."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def _linked(prints: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero((root != np.arange(len(root))) & (prints != prints[root]))
    return pa.RecordBatch.from_arrays([pa.array(prints[some].view(np.int64)), pa.array(prints[root[some]].view(np.int64))], names=["u", "v"])


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, bounds) of a column of lists."""
    bounds = np.r_[0, np.cumsum(column.value_lengths().to_numpy())].astype(np.int64)
    return column.flatten().to_numpy().view(np.uint64), bounds


def _within(radius: int):
    """Links within each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, bounds = _rows(b.column(0))
            forest, root = Forest(prints, bounds), np.arange(len(prints))
            for q, node in forest.near(prints, np.repeat(np.arange(b.num_rows), np.diff(bounds)), radius):
                _unite(root, q, node)
            yield _linked(prints, root)

    return run


def _across(radius: int):
    """Links between the queries of one shard and the tree of another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (queries, own), (prints, bounds) = _rows(b.column(0)), _rows(b.column(1))
            forest, root = Forest(prints, bounds), np.arange(len(prints) + len(queries))
            for q, node in forest.near(queries, np.repeat(np.arange(b.num_rows), np.diff(own)), radius):
                _unite(root, q + len(prints), node)
            yield _linked(np.concatenate([prints, queries]), root)

    return run


def block_masks(radius: int) -> list[int]:
    """The bits of each pair of radius + 2 blocks, as signed longs."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if (m := a | b) >> 63 else m for a, b in combinations(blocks, 2)]


def links(prints: DataFrame, tables: Tables, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Forests (u, v) whose components are those of the distinct fingerprints (column fp) within the radius."""
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(block_masks(radius))])
    entries = prints.select("fp", F.explode(masks).alias("_e")).select("_e.t", "_e.v", "fp")
    shared = entries.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1")
    trees_of = F.ceil(F.col("n") / shard)
    live = entries.join(shared, ["t", "v"]).select("t", "v", trees_of.alias("trees"), F.pmod(F.xxhash64("fp"), trees_of).alias("tree"), "fp")
    trees = tables.write(live.groupBy("t", "v", "trees", "tree").agg(F.collect_list("fp").alias("fps")), "trees")
    large = trees.where("trees > 1")
    pairs = large.alias("l").join(large.alias("r"), (F.col("l.t") == F.col("r.t")) & (F.col("l.v") == F.col("r.v")) & (F.col("l.tree") < F.col("r.tree"))).select(F.col("l.fps").alias("q"), F.col("r.fps").alias("fps"))
    with settings(prints.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=TREES_AT_ONCE):
        inner = tables.write(trees.select("fps").mapInArrow(_within(radius), "u long, v long"), "within")
        outer = tables.write(pairs.mapInArrow(_across(radius), "u long, v long"), "across")
    tables.drop(trees)
    return inner.unionByName(outer)


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row (see the module)."""
    spark = docs.sparkSession
    with Tables(spark) as tables:
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=TEXTS_AT_ONCE):
            prints = tables.write(fingerprints(docs, words, id_col, text_col), "prints")
        classes = tables.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
        comp = components(links(classes, tables, radius, shard), tables)
        named = tables.write(classes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp")), "named")
        ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
        names = named.join(ids, "comp").select("fp", "component_id")
        out = prints.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
        return stash(out, "simhash")


def op12_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
