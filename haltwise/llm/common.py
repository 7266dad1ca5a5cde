"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a map of keys that goes with the tasks: 8 MB, whatever the corpus.
MAP_BITS = 1 << 26


def give_back() -> None:
    """Memory that a finished task no longer uses goes back to the system: a Python worker stays, next to those of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable) -> Callable:
    """run over a task's batches, whose memory is given back after the last one."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where all tasks run on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = sc._jsc.sc().getCheckpointDir()
    if made.isEmpty():
        if not sc.master.startswith("local["):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
        made = sc._jsc.sc().getCheckpointDir()
    return made.get().rstrip("/")


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    for p in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Tables in the shared folder that a computation needs on its way; they are gone when its block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _write(df, name)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        _delete(self.spark, [self.paths.pop(id(t))[0] for t in tables if id(t) in self.paths])

    def leave(self) -> None:
        """The tables that are left stay for results that read them, until the program ends."""
        for path, _ in self.paths.values():
            _at_end_remove(self.spark, path)
        self.paths.clear()

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        _delete(self.spark, [p for p, _ in self.paths.values()])
        self.paths.clear()


#: Tables that results read from, removed at the end of the program.
_stashed: list[tuple[SparkSession, str]] = []
#: Where the tables of a block are noted, if this thread is in one.
_block: ContextVar[list[str] | None] = ContextVar("block", default=None)


def stash(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    out, path = _write(df, name)
    if (own := _block.get()) is not None:
        own.append(path)
        return out
    _at_end_remove(df.sparkSession, path)
    return out


def _at_end_remove(spark: SparkSession, path: str) -> None:
    if not _stashed:
        atexit.register(_at_end)
    _stashed.append((spark, path))


def _at_end() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        for spark, path in _stashed:
            _delete(spark, [path])


@contextlib.contextmanager
def stashed_for(spark: SparkSession):
    """A block whose stashed tables go when it ends: what reads them must have been written by then. Other blocks' and threads' tables stay."""
    own: list[str] = []
    token = _block.set(own)
    try:
        yield
    finally:
        _block.reset(token)
        _delete(spark, own)


def text_bytes(col: str = "text"):
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def map_place(*cols: str) -> Column:
    """Where a key falls in a map."""
    return F.pmod(F.xxhash64(*cols), F.lit(MAP_BITS))


def map_of(keys: DataFrame, *cols: str) -> np.ndarray:
    """A map with the bits of all keys set: the driver gets 2,048 pieces of 4 KB at most. A key may seem present that is not, never the reverse."""
    out = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    p = map_place(*cols) + 1
    for r in keys.groupBy(F.bitmap_bucket_number(p).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("m")).collect():
        start = (r["b"] - 1) * 4096
        out[start : start + 4096] |= np.frombuffer(bytes(r["m"]), dtype=np.uint8)
    return out


def in_map(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def may_hold(spark: SparkSession, bits: np.ndarray) -> Callable[[Column], Column]:
    """A condition on places: whether the map has them."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def held(places: pd.Series) -> pd.Series:
        return pd.Series(in_map(shared.value, places.to_numpy()))

    return held


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for a block of driver code, put back afterwards."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
