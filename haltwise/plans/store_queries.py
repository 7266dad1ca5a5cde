"""What the store holds after transactions and refreshes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.plans import core_queries
from haltwise.plans.bindings import Tables
from haltwise.plans.registry import registry
from haltwise.sources.folders import shared_folder
from haltwise.sources.store import KeyConflict, Store, write_halts

QUERIES, ORACLES, query = registry()


def _store(t: Tables) -> Store:
    return Store(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")


@query(core_queries.ORACLES["halts_on_journey"])
def halts_stored(t: Tables) -> DataFrame:
    """Halts written in two batches by journey; a third that brings some of them again is refused as a whole."""
    store, halts = _store(t), core_queries._halts(t)
    write_halts(store, halts.where("jrnid % 2 = 0"))
    write_halts(store, halts.where("jrnid % 2 = 1"))
    try:
        write_halts(store, halts)
    except KeyConflict:
        return core_queries._halt_rows(store.read("halt_on_journey"))
    raise AssertionError("halts stored twice")


@query("SELECT o_custkey, count(*)::BIGINT AS n_orders, round(sum(o_totalprice), 2) AS total, max(o_orderstatus) AS status FROM orders GROUP BY o_custkey")
def view_refreshed(t: Tables) -> DataFrame:
    """Totals by customer, stored early and brought up to date."""
    store, orders = _store(t), t.table("orders")
    totals = lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(20,4)")), 2).cast("double").alias("total"), F.max("o_orderstatus").alias("status"))
    for state in (totals(orders.where("o_orderdate < '1996-01-01'")), totals(orders)):
        with store.transaction() as tx:
            tx.refresh("totals", state, ("o_custkey",))
    return store.read("totals")
