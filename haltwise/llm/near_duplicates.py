"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

Each element of a document's shingle set visits the signature's positions in
the order of a permutation of its own; at its j-th step it offers a value in
[j, j+1). The ranks of one element are thus correlated (all different), which
lowers the variance of the estimate, and once all positions are taken at step j
no later step can win, so large sets stop early.

Plan: rows with equal sets are one class. Signatures are cut into bands; classes
that share a band are in one bucket, whose leader is its smallest class. Links
are found leader by leader, never as all pairs of a bucket: first every class
against the leader that it shares most buckets with, then, where their
components still differ, against its other leaders, then members outside a
bucket's largest component against members of other components, until every pair
of different components in a bucket has been compared or cannot reach the
threshold (sizes; distance of packed signatures). Of the pairs with its other leaders, first one for each
two components is compared, then those that are still apart. Every link is confirmed on
full sets: a pair carries its member's set to its leader; the members of a bucket that are compared with
each other carry their own, and are tested where they meet. Components come from
union-find within partitions, hooking and pointer jumping across them.

Sets are made again only for classes that share a bucket, picked by a map of
hashes while the texts are read where they lie, so texts are never shuffled.
Large keys (copies of one text, a bucket of thousands, a leader) are joined with
tables that hold one row a key, which lets Spark split them over tasks; sums over
them are combined before the shuffle. Tables made on the way are removed at the end.

A pair at exactly the threshold shares no band with a probability of
(1 - 0.8^6)^42 = 3e-6 and is turned away by the packed signatures with less
than 1e-5; above the threshold both fall fast. (`tests` measure both.)

Defined results: null or empty text, or one without words, has an empty set and
is linked with nothing; fewer words than the shingle's length are one shingle;
rows without an id are linked with nothing and stay; rows that repeat an id are
documents of their own, so the id can be in two groups if the texts differ.
Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltwise.llm import shingles as sh
from haltwise.llm.common import Tables, in_map, map_of, map_place, may_hold, settings, stash, text_bytes

BANDS, ROWS = 42, 6
#: Positions of a signature (a power of two); the bands take BANDS * ROWS of them, the packed form all.
BITS = 8
M = 1 << BITS
#: Shingles that are signed at a time, and texts in a batch of the passes in Python.
SIGN_AT_ONCE = 30_000
TEXTS_AT_ONCE = "2000"
#: Packed signature: two bits a position, in 8 longs. Differing positions at a similarity of 0.8 are 0.15 of 256, +- 5.7
#: were they independent, and less so with correlated ranks; five deviations more are let pass.
PACKED = M * 2 // 64
MASK = 0x5555555555555555
#: Edges that a union-find holds at a time.
EDGES_AT_ONCE = 500_000


def _positions(key: np.ndarray, j: int) -> np.ndarray:
    """Where elements go at step j: a keyed bijection of 0..M-1, so that each visits every position once."""
    bits = np.uint64(M - 1)
    x = (np.uint64(j) ^ key) & bits
    x = (x * ((key >> np.uint64(9)) | np.uint64(1))) & bits
    x ^= x >> np.uint64(5)
    x = (x * ((key >> np.uint64(20)) | np.uint64(1)) + (key >> np.uint64(40))) & bits
    x ^= x >> np.uint64(4)
    return (x * ((key >> np.uint64(31)) | np.uint64(1))) & bits


def sign(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures, one row for each non-empty set."""
    d = len(sets)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(d * M, full, dtype=np.uint64)
    x = sh.mix(np.concatenate(sets) + np.uint64(0x51))
    row = np.repeat(np.arange(d, dtype=np.int64) * M, [len(s) for s in sets])
    key = sh.mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    j, block = 0, 1
    while j < M and len(x):
        for _ in range(min(block, M - j)):
            value = (np.uint64(j) << np.uint64(52)) | (sh.mix(x + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(12))
            np.minimum.at(sig, row + _positions(key, j).astype(np.int64), value)
            j += 1
        block = max(1, j // 2)
        open_rows = (sig.reshape(d, M) == full).any(axis=1)
        on = open_rows[row // M]
        x, key, row = x[on], key[on], row[on]
    return sig.reshape(d, M)


def bands_of(sig: np.ndarray) -> np.ndarray:
    """The bucket of each band of each signature."""
    acc = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        acc = sh.mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)[:, :, r])
    return acc


def packed_of(sig: np.ndarray) -> np.ndarray:
    """Two bits of each position, 32 positions a word."""
    two = (sh.mix(sig) & np.uint64(3)).reshape(len(sig), PACKED, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(two, axis=2)


SIGNED = "doc_id long, text_key long, n long, fp binary, bands array<long>, packed array<long>"


def _signatures(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64())), ("packed", pa.list_(pa.int64()))])

    def flush(ids: list, keys: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        some = [i for i, s in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        packed: list = [None] * len(sets)
        if some:
            sig = sign([sets[i] for i in some])
            for i, b, p in zip(some, bands_of(sig).view(np.int64), packed_of(sig).view(np.int64)):
                bands[i], packed[i] = b, p
        prints = [np.array([sh.mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(sh.mix(s + np.uint64(77))) if len(s) else 0], dtype=np.uint64).tobytes() for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((ids, keys, [len(s) for s in sets], prints, bands, packed), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small sets take more steps than large ones, so sets are signed together with others of their size.
        pools: dict[int, list] = {}
        for b in batches:
            for i, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = sh.shingle_set(t.as_py(), k)
                pool = pools.setdefault(len(s).bit_length() // 2, [0, [], [], []])
                pool[0] += len(s) + 20
                for to, x in zip(pool[1:], (i, key, s)):
                    to.append(x)
                if pool[0] >= SIGN_AT_ONCE:
                    yield flush(*pool[1:])
                    del pools[len(s).bit_length() // 2]
        for pool in pools.values():
            yield flush(*pool[1:])
        sh.forget()

    return run


def _sets(k: int, shared):
    """(doc_id, text_key, set) of the rows whose place is in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            at = np.flatnonzero(in_map(bits, b.column(3).to_numpy()))
            for some in np.array_split(at, len(at) // 300 + 1) if len(at) else ():
                part = b.take(pa.array(some))
                sets = [sh.shingle_set(t.as_py(), k).view(np.int64) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, type=pa.list_(pa.int64()))], names=["doc_id", "text_key", "set"])
        sh.forget()

    return run


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's edges, some at a time: (member, smallest member) for each member."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    def forest() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := find(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) >= EDGES_AT_ONCE:
            yield forest()
    yield forest()


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, comp) for the nodes of edges (u, v) that are not the smallest of their component.

    A round: union-find in each partition leaves a forest there, in which a node has few smaller neighbours
    (one for each partition at most); it hooks to the smallest, links the others to that one, and jumps to that one's parent.
    """
    used: list[DataFrame] = []
    while True:
        forest = tables.write(edges.select("u", "v").mapInArrow(_roots, "u long, v long"), "forest")
        parents = tables.write(forest.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")), "parents")
        tables.drop(*used)
        jumped = parents.join(parents.select(F.col("u").alias("m"), F.col("m").alias("up")), "m", "left")
        if jumped.where("up IS NOT NULL OR m <> most").isEmpty():
            tables.drop(forest)
            return parents.select(F.col("u").alias("node"), F.col("m").alias("comp"))
        rest = forest.join(parents, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, used = jumped.select("u", F.coalesce("up", "m").alias("v")).unionByName(rest), [forest, parents]


def most_differing(threshold: float) -> int:
    """Differing packed positions up to which a pair may be as similar as the threshold."""
    p = 3 / 4 * (1 - threshold)
    return int(M * p + 5 * (M * p * (1 - p)) ** 0.5)


def _close(threshold: float) -> Column:
    """Whether the packed signatures of l and r differ little enough."""
    differ = F.lit(0)
    for i in range(PACKED):
        x = F.col("l.packed")[i].bitwiseXOR(F.col("r.packed")[i])
        differ += F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(MASK)))
    return differ <= most_differing(threshold)


def _classes(docs: DataFrame, tables: Tables, shingle: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, named): doc_id, text_key, n, fp of each row; node, comp, doc_id (the smallest), fp, n of each class."""
    spark = docs.sparkSession
    t = text_bytes(text_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_key"), t.alias("t"))
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=TEXTS_AT_ONCE):
        signed = tables.write(src.mapInArrow(_signatures(shingle), SIGNED), "signed")
    rows = signed.select("doc_id", "text_key", "n", "fp")
    first = F.min(F.struct("doc_id", "text_key"))
    grouped = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp", "n").agg(first.alias("x"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
    # Numbers are given in order of writing and read from the table ever after.
    classes = tables.write(grouped.select(F.monotonically_increasing_id().alias("node"), "x.*", "n", "fp", "bands", "packed"), "classes")

    entries = classes.select("node", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("bucket", "leader")
    shared = tables.write(shared, "leaders")
    live = tables.write(entries.join(shared, "bucket"), "buckets")
    tables.drop(shared)
    pairs = tables.write(live.where("node <> leader").groupBy(F.col("node").alias("u"), F.col("leader").alias("v")).agg(F.count("*").alias("c")), "pairs")
    few = classes.select("node", "n", "packed")

    alive = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    alive = tables.write(classes.select("node", "doc_id", "text_key").join(alive, "node", "left_semi"), "alive")
    wanted = spark.sparkContext.broadcast(map_of(alive, "doc_id", "text_key"))
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=TEXTS_AT_ONCE):
        made = tables.write(src.select("doc_id", "text_key", "t", map_place("doc_id", "text_key").alias("p")).mapInArrow(_sets(shingle, wanted), "doc_id long, text_key long, set array<long>"), "sets")
    wanted.unpersist()
    # Rows repeated with id and text give the same set: one is enough.
    sets = tables.write(made.join(alive, ["doc_id", "text_key"]).select("node", "set").dropDuplicates(["node"]), "sets")
    tables.drop(made, alive)

    fits = (F.col("l.n") * 100 >= F.col("r.n") * percent) & (F.col("r.n") * 100 >= F.col("l.n") * percent)

    def near(of: DataFrame) -> DataFrame:
        """The pairs (u, v) that sizes and packed signatures leave."""
        left = of.join(few.select(F.col("node").alias("u"), F.struct("n", "packed").alias("l")), "u")
        return left.join(few.select(F.col("node").alias("v"), F.struct("n", "packed").alias("r")), "v").where(fits & _close(percent / 100)).select("u", "v")

    def confirmed(of: DataFrame) -> DataFrame:
        """The pairs (u, v) whose full sets reach the threshold; u's set goes to v."""
        one = of.join(sets.select(F.col("node").alias("u"), F.col("set").alias("su")), "u")
        two = one.join(sets.select(F.col("node").alias("v"), F.col("set").alias("sv")), "v")
        both = F.size(F.array_intersect("su", "sv"))
        return two.where(100 * both >= percent * (F.size("su") + F.size("sv") - both)).select("u", "v")

    def apart(of: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components cu and cv."""
        named = comp.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
        out = of.join(named, "u", "left").join(named.select(F.col("u").alias("v"), F.col("cu").alias("cv")), "v", "left")
        return out.withColumn("cu", F.coalesce("cu", "u")).withColumn("cv", F.coalesce("cv", "v")).where("cu <> cv")

    def one_between(of: DataFrame) -> DataFrame:
        """For each two components the pair that shares most buckets."""
        both = apart(of).groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b"))
        return both.agg(F.max(F.struct("c", "u", "v")).alias("x")).select("x.u", "x.v")

    def joined(new: DataFrame) -> DataFrame:
        return components(comp.select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(new), tables)

    best = pairs.groupBy("u").agg(F.max(F.struct("c", (-F.col("v")).alias("v"))).alias("x")).select("u", (-F.col("x.v")).alias("v"))
    comp = components(confirmed(near(best)), tables)
    comp = joined(confirmed(near(one_between(pairs))))
    comp = joined(confirmed(near(apart(pairs))))

    # Then what is outside a bucket's largest component: a few of each bucket against all, then all. Sets ride along with the
    # buckets' members, not with pairs: the join's condition ends with the test on full sets, so that it gives links only.
    size = lambda side: F.size(f"{side}.set")
    alike = F.size(F.array_intersect("l.set", "r.set")) * (100 + percent) >= percent * (size("l") + size("r"))
    apart_now = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.comp") != F.col("r.comp"))
    for slots in (8, None):
        now = live.join(comp, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
        parts = now.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("x"), F.count("*").alias("parts"))
        parts = tables.write(parts.where("parts > 1").select("bucket", F.col("x.comp").alias("major")), "parts")
        if parts.isEmpty():
            break
        open_ = tables.write(now.join(parts, "bucket").join(few, "node").join(sets, "node"), "open")
        minor = open_.where("comp <> major")
        if slots:
            slot = F.pmod(F.xxhash64("node"), F.lit(slots)).alias("slot")
            first = minor.groupBy("bucket", slot).agg(F.min("node").alias("node")).select("bucket", "node")
            minor = minor.join(first, ["bucket", "node"], "left_semi")
        met = open_.alias("r").join(minor.alias("l"), apart_now & fits & _close(percent / 100) & alike)
        new = tables.write(met.select(F.greatest("l.node", "r.node").alias("u"), F.least("l.node", "r.node").alias("v")).distinct(), "met")
        comp = joined(new)
        tables.drop(parts, open_, new)

    named = classes.select("node", "doc_id", "text_key", "fp", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return rows, tables.write(named, "named")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (see the module)."""
    with Tables(docs.sparkSession) as tables:
        rows, named = _classes(docs, tables, shingle, percent, id_col, text_col)
        least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        names = tables.write(named.select("fp", "n", "comp").join(tables.write(least, "least"), "comp").select("fp", "n", "component_id"), "names")
        component = F.coalesce("component_id", "doc_id")
        out = rows.join(names, ["fp", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
        return stash(out, "groups")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group (the smallest id, then text key), all columns kept.

    Rows equal in id and text are one document; rows without an id, and texts without words, stay.
    Only rows that a map of the keys to drop may hold are joined with those keys; the others are passed through where they lie.
    """
    spark = docs.sparkSession
    with Tables(spark) as tables:
        rows, named = _classes(docs, tables, shingle, percent, id_col, text_col)
        stays = tables.write(named.groupBy("comp").agg(F.min(F.struct("doc_id", "text_key")).alias("stays")), "stays")
        names = tables.write(named.select("fp", "n", "comp").join(stays, "comp").select("fp", "n", "stays"), "names")
        row = F.struct("doc_id", "text_key")
        gone = rows.join(names, ["fp", "n"]).where(F.col("doc_id").isNotNull() & (row != F.col("stays"))).select("doc_id", "text_key", F.lit(True).alias("gone"))
        # Kept documents that occur twice with id and text: all rows but one go.
        twice = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key", F.lit(False).alias("gone"))
        marked = stash(gone.distinct().unionByName(twice).groupBy("doc_id", "text_key").agg(F.max("gone").alias("gone")), "gone")
    bits = map_of(marked, "doc_id", "text_key")
    id_, text_key = F.col(id_col).cast("long"), F.xxhash64(text_bytes(text_col))
    place = F.pmod(F.xxhash64(id_, text_key), F.lit(bits.size * 8))
    held = F.coalesce(may_hold(spark, bits)(place), F.lit(False))
    sure = docs.where(~held)
    open_ = docs.where(held).select(F.struct(*docs.columns).alias("row"), id_.alias("doc_id"), text_key.alias("text_key"))
    met = open_.join(marked, ["doc_id", "text_key"], "left")
    out = sure.unionByName(met.where(F.col("gone").isNull()).select("row.*"))
    if marked.where(~F.col("gone")).isEmpty():
        return out
    return out.unionByName(met.where(~F.col("gone")).dropDuplicates(["doc_id", "text_key"]).select("row.*"))


def op3_near_duplicates(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, shingle=4, percent=80)
