"""Transactions over several tables, keys, and stored views."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from haltwise.sources import store as st

T0 = dt.datetime(2020, 9, 23)
HALT = "jrnid string, tst timestamp_ntz, total_s double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(root):
    return sorted(str(p.relative_to(root)) for p in pathlib.Path(root).rglob("*.parquet") if not p.name.startswith("."))


def test_all_tables_or_none(spark, tmp_path):
    store = st.Store(spark, str(tmp_path))
    a, b = spark.range(3), spark.range(10, 12)
    with store.transaction() as tx:
        tx.append("a", a)
        tx.append("b", b)
    assert store.version() == 1
    before = files(tmp_path)
    with pytest.raises(RuntimeError, match="between"), store.transaction() as tx:
        tx.append("a", a)
        raise RuntimeError("between two tables")
    with pytest.raises(st.KeyConflict, match="stored already"), store.transaction() as tx:
        tx.replace("b", a)
        tx.append("a", spark.range(2, 5), key=("id",))
    failing = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="half-way"), store.transaction() as tx:
        tx.append("a", spark.range(90, 95))
        tx.append("b", failing)
    assert store.version() == 1 and files(tmp_path) == before
    assert rows(store.read("a")) == [(0,), (1,), (2,)] and rows(store.read("b")) == [(10,), (11,)] and store.read("c") is None


def test_of_two_at_once_the_second_fails(spark, tmp_path):
    store = st.Store(spark, str(tmp_path))
    with pytest.raises(Exception), store.transaction() as late:  # noqa: B017, PT011
        late.append("a", spark.range(5))
        with store.transaction() as tx:
            tx.append("a", spark.range(7, 8))
    assert rows(store.read("a")) == [(7,)] and len(files(tmp_path)) == len([f for f in files(tmp_path) if f.startswith("a/")])


def test_a_failed_move_leaves_nothing(spark, tmp_path, monkeypatch):
    store = st.Store(spark, str(tmp_path))
    move = st._Files.move
    monkeypatch.setattr(st._Files, "move", lambda self, n, to: move(self, n, to) if to.startswith("a/") else (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(OSError, match="no space"), store.transaction() as tx:
        tx.append("a", spark.range(3))
        tx.append("b", spark.range(3))
    assert store.version() == 0 and files(tmp_path) == []


def test_halts_with_their_key(spark, tmp_path):
    store = st.Store(spark, str(tmp_path))
    df = lambda *r: spark.createDataFrame(list(r), HALT)
    st.write_halts(store, df(("j", T0, 1.0), ("k", T0, 2.0)))
    for bad, why in ((df(("j", T0, 9.0), ("l", T0, 1.0)), "stored already"), (df(("m", T0, 1.0), ("m", T0, 2.0)), "twice"), (df(("m", None, 1.0)), "without a key")):
        with pytest.raises(st.KeyConflict, match=why):
            st.write_halts(store, bad)
    st.write_halts(store, df(("j", T0 + dt.timedelta(seconds=1), 3.0)))
    st.write_halts(store, df().limit(0))
    assert len(rows(store.read("halt_on_journey"))) == 3


def test_a_view_is_refreshed_where_it_changed(spark, tmp_path):
    store = st.Store(spark, str(tmp_path))
    view = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))

    def refreshed(df):
        with store.transaction() as tx:
            return tx.refresh("v", df, ("k",))

    assert refreshed(view) == {"parts": 64, "written": 64, "removed": 0}
    old, kept = store.read("v"), files(tmp_path)
    assert refreshed(view.repartition(7)) == {"parts": 64, "written": 0, "removed": 0} and files(tmp_path) == kept
    # One row changed, one to null, one gone, one added.
    new = view.where("k <> 5").withColumn("v", F.when(F.col("k") == 7, -1).otherwise(F.col("v"))).withColumn("s", F.when(F.col("k") != 11, F.col("s"))).unionByName(spark.createDataFrame([(2000, 1, "x")], view.schema))
    got = refreshed(new)
    assert 1 <= got["written"] <= 4 and rows(store.read("v").fillna("")) == rows(new.fillna(""))
    assert old.count() == 1000 and rows(old.fillna("")) == rows(view.fillna(""))
    assert refreshed(new.where("k < 3")) == {"parts": 3, "written": 3, "removed": 61} or store.read("v").count() == 3
    assert store.remove_unused() > 60 and store.read("v").count() == 3
    assert refreshed(new.limit(0))["parts"] == 0 and store.read("v").count() == 0
    assert refreshed(new.withColumn("w", F.lit(1)))["parts"] == 64 and "w" in store.read("v").columns


def test_import_that_fails_half_way(spark, tmp_path, monkeypatch):
    from haltwise.plans import imports

    made = imports.Imported(spark.range(2), spark.range(1), spark.range(3).select(F.raise_error(F.lit("bad point")).cast("long").alias("id")))
    monkeypatch.setattr(imports, "import_positions", lambda *a, **k: made)
    log = {r.step: r for r in imports.run_import(spark.range(1), spark.range(1), str(tmp_path)).collect()}
    assert {k: r.status for k, r in log.items()} == {"clean": "done", "journeys": "undone", "rejected": "undone", "points": "failed"} and "bad point" in log["points"].message
    store = st.Store(spark, str(tmp_path))
    assert store.read("journeys") is None and not [f for f in files(tmp_path) if not f.startswith("import_log")]
