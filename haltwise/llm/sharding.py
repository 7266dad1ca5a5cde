"""Contiguous shards of near-equal size over atomic groups of equal texts.

Groups are ordered by a digest of their text. The smallest capacity with which
a greedy walk over the ordered group sizes fits into the shards is found by
binary search, and the order is cut where that walk cuts. The driver never sees
the groups: it walks over *segments* (sums by digest prefix). A walk that treats
segments as atomic bounds the capacity from above, one that may cut inside them
bounds it from below; segments in which a cut can still fall are refined by
longer prefixes until none is left, so that cuts are exact.

Defined results: a null text counts as an empty one (size 1, checksum 0, grouped
with it); an empty table gives no rows; repeated ids are rows of their own; a
group larger than an even share makes its shard as large as itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haltwise.llm.common import stash, text_bytes

FIRST_DIGITS = 3
#: Parts of the rows that are numbered independently: 256 by order, 64 by id, so that a hot group is spread.
SLOT_DIGITS, SLOT_SALTS = 2, 64


@dataclass(frozen=True)
class Segment:
    prefix: str
    size: int
    groups: int
    largest: int


def walk(segments: list[Segment], capacity: int, shards: int, inside: bool) -> list[int] | None:
    """Ends of the shards in bytes from the start, or None if the walk doesn't fit.

    inside: a segment of several groups may be cut anywhere; else it is atomic.
    """
    ends, used, at = [], 0, 0
    for s in segments:
        if s.largest > capacity or (not inside and s.size > capacity):
            return None
        rest = s.size
        if inside and s.groups > 1:
            while used + rest > capacity:
                at, rest = at + capacity - used, rest - (capacity - used)
                ends.append(at)
                used = 0
        elif used + rest > capacity:
            ends.append(at)
            used = 0
        used, at = used + rest, at + rest
        if len(ends) >= shards:
            return None
    return [*ends, *[at] * (shards - len(ends))]


def smallest(segments: list[Segment], shards: int, inside: bool) -> int:
    """The smallest capacity that fits, by binary search."""
    total = sum(s.size for s in segments)
    low = max(-(-total // shards), max((s.largest for s in segments), default=0))
    high = max(low, total)
    while low < high:
        mid = (low + high) // 2
        if walk(segments, mid, shards, inside) is not None:
            high = mid
        else:
            low = mid + 1
    return low


def _open_segments(segments: list[Segment], shards: int) -> list[Segment]:
    """Segments of several groups in which a cut of the smallest feasible capacity may still lie."""
    low, high = smallest(segments, shards, True), smallest(segments, shards, False)
    late = walk(segments, high, shards, True)
    # Earliest ends: segments too large for the low capacity are skipped as if they fitted.
    early, used, at = [], 0, 0
    for s in segments:
        if used and used + s.size > low:
            early.append(at)
            used = 0
        used, at = used + s.size, at + s.size
    early = [*early, *[at] * shards][:shards]
    out, at = [], 0
    for s in segments:
        if s.groups > 1 and (s.size > low or any(min(e, l) < at + s.size and at < max(e, l) or e <= at < l for e, l in zip(early, late))):
            out.append(s)
        elif s.groups > 1 and any(at < x < at + s.size for x in [*early, *late]):
            out.append(s)
        at += s.size
    return out


def shard_boundaries(groups: DataFrame, shards: int) -> list[str]:
    """Digest prefixes at which shards 1, 2, ... begin. groups: key (hex digest), bytes. At most some thousand sums reach the driver at a time."""

    def sums(digits: int, within: list[str] | None) -> list[Segment]:
        g = groups
        if within is not None:
            wanted = groups.sparkSession.createDataFrame([(p,) for p in within], "p string")
            g = g.join(F.broadcast(wanted), F.substring("key", 1, len(within[0])) == F.col("p"), "left_semi")
        rows = g.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes").alias("s"), F.count("*").alias("n"), F.max("bytes").alias("m")).collect()
        return [Segment(r["p"], r["s"], r["n"], r["m"]) for r in rows]

    segments = sorted(sums(FIRST_DIGITS, None), key=lambda s: s.prefix)
    while open_ := _open_segments(segments, shards):
        by_length: dict[int, list[str]] = {}
        for s in open_:
            by_length.setdefault(len(s.prefix), []).append(s.prefix)
        gone = {s.prefix for s in open_}
        segments = [s for s in segments if s.prefix not in gone]
        for n, prefixes in by_length.items():
            segments += sums(n + (2 if len(prefixes) <= 64 else 1), prefixes)
        segments.sort(key=lambda s: s.prefix)
    capacity = smallest(segments, shards, False)
    cuts, used = [], 0
    for s in segments:
        if used + s.size > capacity:
            cuts.append(s.prefix)
            used = 0
        used += s.size
    return cuts


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row."""
    t = text_bytes(text_col)
    rows = stash(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("key")),
        "sizes",
    )
    groups = stash(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    cuts = shard_boundaries(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("key") >= c).cast("int")
    placed = rows.select("*", shard.alias("shard"), F.substring("key", 1, SLOT_DIGITS).alias("_o"), F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_SALTS)).alias("_s"))
    # Slots: rows are numbered within parts; the parts' sizes (at most 256 * 64 * 2) give where each begins.
    parts = placed.groupBy("shard", "_o", "_s").count().collect()
    starts, at = [], {}
    for r in sorted(parts, key=lambda r: (r["shard"], r["_o"], r["_s"])):
        starts.append((r["shard"], r["_o"], r["_s"], at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["count"]
    begins = docs.sparkSession.createDataFrame(
        starts, T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("_o", T.StringType()), T.StructField("_s", T.LongType()), T.StructField("_b", T.LongType())])
    )
    number = F.row_number().over(Window.partitionBy("shard", "_o", "_s").orderBy("key", "doc_id"))
    return (
        placed.withColumn("_n", number)
        .join(F.broadcast(begins), ["shard", "_o", "_s"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_b") + F.col("_n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op10_sharding(docs: DataFrame) -> DataFrame:
    return assign_shards(docs, shards=16)
