"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has almost no Jaccard similarity with it,
so containment is searched for. Items are partitioned by the size of their
shingle set. An item's sketch holds its smallest shingle hashes, as many as its
partition asks for: more than (1 - threshold) of the partition's largest set,
so a document that contains the threshold's share of the item contains a
sketched shingle for certain. Documents are sketched per partition by the
hashes under the partition's ceiling (its largest sketched hash), and every
hash that an item has sketched makes a candidate. Candidates are verified by
exact containment of the item's whole shingle set.

The items are a stated query set against all documents: they are read in blocks
of at most `block_shingles` shingles, each block is sent to the tasks (its size
is bounded by that), and the documents are passed once for a block without a
shuffle.

Defined results: null or empty items match nothing and null or empty documents
are clean; an item with fewer words than the shingle's length is one shingle
and matches documents of just these words; repeated items and documents are
reported each under its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.llm import shingles as sh
from haltwise.llm.common import text_bytes

#: Shingles of the items in one block: 8 bytes each, and as much again for sketches.
BLOCK_SHINGLES = 1_000_000


class Index:
    """Sketches and full sets of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], shingle: int, percent: int):
        self.percent = percent
        self.ids, self.sets = [], []
        for i, t in items:
            s = sh.shingle_set(t, shingle)
            if len(s):
                self.ids.append(i)
                self.sets.append(s)
        sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        # Partition p holds the set sizes from 2^p up to 2^(p+1) - 1.
        self.partition = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        self.probes: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        for p in np.unique(self.partition):
            mine = np.flatnonzero(self.partition == p)
            largest = int(sizes[mine].max())
            k = largest * (100 - percent) // 100 + 1
            sketches = [self.sets[i][: min(k, len(self.sets[i]))] for i in mine]  # sets are sorted: the smallest hashes
            hashes = np.concatenate(sketches)
            owners = np.repeat(mine, [len(s) for s in sketches])
            order = np.argsort(hashes, kind="stable")
            self.probes.append((hashes.max(), hashes[order], owners[order]))

    def search(self, doc: np.ndarray) -> list[tuple[int, float]]:
        """(item index, contained share) of the items that the sorted shingle set holds."""
        found: set[int] = set()
        for ceiling, hashes, owners in self.probes:
            sketch = doc[: np.searchsorted(doc, ceiling, side="right")]
            if not len(sketch):
                continue
            # Look the shorter side up in the longer one.
            if len(hashes) <= len(sketch):
                at = np.minimum(np.searchsorted(sketch, hashes), len(sketch) - 1)
                found.update(owners[sketch[at] == hashes].tolist())
            else:
                lo, hi = np.searchsorted(hashes, sketch, side="left"), np.searchsorted(hashes, sketch, side="right")
                for a, b in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                    found.update(owners[a:b].tolist())
        out = []
        for i in sorted(found):
            s = self.sets[i]
            at = np.minimum(np.searchsorted(doc, s), len(doc) - 1)
            n = int((doc[at] == s).sum())
            if 100 * n >= self.percent * len(s):
                out.append((i, n / len(s)))
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str, shingle: int, block_shingles: int) -> list[list[tuple[int, bytes]]]:
    """Items in blocks by size: the driver holds one block's texts at a time while it makes it."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), text_bytes(text_col).alias("t"))
    block: list[tuple[int, bytes]] = []
    held = 0
    for r in rows.toLocalIterator():
        n = max(1, len(r["t"]) // 2)  # no more shingles than half the bytes
        if block and held + n > block_shingles:
            yield block
            block, held = [], 0
        block.append((r["i"], bytes(r["t"])))
        held += n
    if block:
        yield block


def find_contaminated(
    docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, containment) for each item of which a document contains `percent` or more."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"))
    out = None
    for block in _blocks(items, item_id, item_text, shingle, block_shingles):
        found = src.mapInArrow(_searcher(block, shingle, percent), "doc_id long, item_id long, n_item_shingles long, containment double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else src.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item_shingles long, containment double")


def _searcher(block: list[tuple[int, bytes]], shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(block, shingle, percent)
        for b in batches:
            rows: list[tuple] = []
            if index.ids:
                for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                    s = sh.shingle_set(t.as_py(), shingle)
                    if len(s):
                        rows += [(d, index.ids[i], len(index.sets[i]), c) for i, c in index.search(s)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], names=["doc_id", "item_id", "n_item_shingles", "containment"])
        sh.forget()

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """Documents that contain no item, all columns kept; flagged while the text is read, so nothing is shuffled."""
    shingle, percent = params.get("shingle", 5), params.get("percent", 80)
    text_col = params.get("text_col", "text")
    clean = docs
    for block in _blocks(items, params.get("item_id", "item_id"), params.get("item_text", "text"), shingle, params.get("block_shingles", BLOCK_SHINGLES)):
        clean = clean.where(~_flag(block, shingle, percent)(text_bytes(text_col)))
    return clean


def _flag(block: list[tuple[int, bytes]], shingle: int, percent: int):
    import pandas as pd
    from pyspark.sql.types import BooleanType

    def flag(batches):
        index = Index(block, shingle, percent)
        for texts in batches:
            yield pd.Series([bool(index.ids) and len(s := sh.shingle_set(t, shingle)) > 0 and bool(index.search(s)) for t in texts], dtype=bool)
        sh.forget()

    flag.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(flag, BooleanType())


def op4_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_contaminated(docs, benchmark)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1)
SELECT doc_id, item_id, any_value(n)::BIGINT AS n_item_shingles, count(*)::DOUBLE / any_value(n) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * any_value(n)
"""
