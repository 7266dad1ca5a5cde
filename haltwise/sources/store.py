"""Tables that change all together or not at all, and stored views that are refreshed where they have changed.

A store is a folder. A table's rows lie in folders `<table>/commit=<name>`; which of them count is said by
the newest of its manifests, small files numbered in order. A transaction writes to a folder of its
own, checks keys, moves what it has written and then creates the next manifest, in one step that fails if another
has created it first. What fails before leaves the manifest, and so every table, as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a stored view, each of which is written again if its digest has changed.
VIEW_PARTS = 64


class KeyConflict(ValueError):
    """Rows whose key is there already, or twice among the new ones."""


class _Files:
    """The file system of a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        sc = spark.sparkContext
        self.jvm, self.gateway, self.conf = sc._jvm, sc._gateway, sc._jsc.hadoopConfiguration()
        self.fs = self.jvm.org.apache.hadoop.fs.Path(root).getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(root)).toString().rstrip("/")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def move(self, name: str, to: str) -> None:
        self.fs.mkdirs(self.path(to).getParent())
        if not self.fs.rename(self.path(name), self.path(to)):
            raise OSError(f"{name} can't be moved to {to}")

    def create(self, name: str, text: str) -> None:
        """A new file, seen whole or not at all; an error if there is one of that name."""
        draft = f"_staged/{uuid.uuid4().hex}.draft"
        out = self.fs.create(self.path(draft), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.fs.mkdirs(self.path(name).getParent())
        options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self.conf).rename(self.path(draft), self.path(name), options)
        except BaseException:
            self.delete(draft)
            raise

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


class Transaction:
    """Changes that will count together."""

    def __init__(self, store: Store):
        self.store, self.name = store, uuid.uuid4().hex
        self.base = store.version()
        self.tables = json.loads(json.dumps(store.manifest(self.base)))
        self.staged: dict[str, str] = {}

    def _write(self, table: str, df: DataFrame, part: str = "") -> str:
        folder = f"{table}/commit={self.name}{part}"
        df.write.parquet(f"{self.store.root}/_staged/{self.name}/{folder}")
        self.staged[f"_staged/{self.name}/{folder}"] = folder
        return folder

    def _staged_rows(self, folder: str, df: DataFrame) -> DataFrame:
        return self.store.spark.read.schema(df.schema).parquet(f"{self.store.root}/_staged/{self.name}/{folder}")

    def append(self, table: str, df: DataFrame, key: tuple[str, ...] = ()) -> None:
        """Adds rows. A key that is stored already, or stands twice among the rows, stops the transaction; so does a null in it."""
        old = self.store.read(table, self.tables)
        folder = self._write(table, df, f"-{len(self.staged)}")
        if key:
            rows = self._staged_rows(folder, df).select(*key)
            null = F.lit(False)
            for c in key:
                null = null | F.col(c).isNull()
            bad = [("without a key", rows.where(null)), ("twice", rows.groupBy(*key).count().where("count > 1"))]
            if old is not None:
                bad.append(("stored already", rows.join(old.select(*key).distinct(), list(key), "left_semi")))
            for what, df_bad in bad:
                if (first := df_bad.select(*key).first()) is not None:
                    raise KeyConflict(f"{table}: a row {what}: {first.asDict()}")
        entry = self.tables.setdefault(table, {"schema": df.schema.json(), "parts": {}})
        entry["parts"][folder] = folder

    def replace(self, table: str, df: DataFrame) -> DataFrame:
        """All rows of the table are these; gives them back as written, to be read until the transaction ends."""
        folder = self._write(table, df, f"-{len(self.staged)}")
        self.tables[table] = {"schema": df.schema.json(), "parts": {folder: folder}}
        return self._staged_rows(folder, df)

    def refresh(self, view: str, df: DataFrame, key: tuple[str, ...]) -> dict[str, int]:
        """Brings a stored view up to df, writing only the parts whose rows have changed; how many there are and were written.

        Rows are dealt to parts by their key. A part's digest is its number of rows and two sums over them.
        """
        part = F.pmod(F.xxhash64(*key), F.lit(VIEW_PARTS)).cast("string")
        now = {r["part"]: [r["n"], str(r["a"]), str(r["b"])] for r in df.withColumn("part", part).groupBy("part").agg(*_digest(df)).collect()}
        old = self.tables.get(view)
        if old is None or old["schema"] != df.schema.json():
            old = {"parts": {}, "digests": {}}
        changed = sorted(p for p, d in now.items() if old["digests"].get(p) != d)
        if changed:
            # One job writes a folder a part.
            staging = f"_staged/{self.name}/{view}/parts"
            df.withColumn("_part", part).where(F.col("_part").isin(changed)).repartition("_part").write.partitionBy("_part").parquet(f"{self.store.root}/{staging}")
            for p in changed:
                self.staged[f"{staging}/_part={p}"] = f"{view}/commit={self.name}-{p}"
        parts = {p: f"{view}/commit={self.name}-{p}" if p in changed else old["parts"][p] for p in now}
        self.tables[view] = {"schema": df.schema.json(), "parts": parts, "digests": now}
        return {"parts": len(now), "written": len(changed), "removed": len(old["parts"].keys() - now.keys())}

    def commit(self) -> int:
        moved: list[str] = []
        try:
            for name, to in self.staged.items():
                self.store.files.move(name, to)
                moved.append(to)
            self.store.files.create(f"_manifest/{self.base + 1:08d}.json", json.dumps(self.tables))
        except BaseException:
            for to in moved:
                self.store.files.delete(to)
            raise
        return self.base + 1


def _digest(df: DataFrame) -> list[Column]:
    row = lambda salt: F.xxhash64(F.lit(salt), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return [F.count("*").alias("n"), F.sum(row(1)).alias("a"), F.sum(row(2)).alias("b")]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, _Files(spark, root)
        self.root = self.files.root

    def version(self) -> int:
        """The number of the newest manifest, 0 before the first."""
        names = [n for n in self.files.names("_manifest") if n.endswith(".json") and n[0] != "."]
        return int(names[-1].removesuffix(".json")) if names else 0

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.files.read(f"_manifest/{version:08d}.json")) if version else {}

    def read(self, table: str, manifest: dict | None = None) -> DataFrame | None:
        """The table's rows by the newest manifest, or a given one; null if it isn't there. Later commits don't change what has been read."""
        from pyspark.sql.types import StructType

        entry = (self.manifest() if manifest is None else manifest).get(table)
        if entry is None:
            return None
        schema = StructType.fromJson(json.loads(entry["schema"]))
        paths = [f"{self.root}/{p}" if self.files.fs.exists(self.files.path(p)) else f"{self.root}/_staged/{p.split('commit=')[1].split('-')[0]}/{p}" for p in entry["parts"].values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Changes made in the block count together when it ends; if it fails, none does and nothing of it stays."""
        tx = Transaction(self)
        try:
            yield tx
            if tx.staged or tx.tables != self.manifest(tx.base):
                tx.commit()
        finally:
            self.files.delete(f"_staged/{tx.name}")

    def remove_unused(self) -> int:
        """Deletes folders that the newest manifest doesn't name; readers of older versions must have ended."""
        entry = self.manifest()
        used = {p for t in entry.values() for p in t["parts"].values()}
        gone = 0
        for table in entry:
            for name in self.files.names(table):
                if name.startswith("commit=") and f"{table}/{name}" not in used:
                    self.files.delete(f"{table}/{name}")
                    gone += 1
        return gone


def write_halts(store: Store, halts: DataFrame) -> None:
    """Adds the halts of journeys; a halt that is stored already stops the whole batch."""
    with store.transaction() as tx:
        tx.append("halt_on_journey", halts, key=("jrnid", "tst"))
