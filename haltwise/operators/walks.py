"""Walks over ordered rows whose next step depends on the last decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def walk(rows: DataFrame, key: str, order: list[str], step: Callable[[object, dict], tuple[object, tuple | None]], schema: str) -> DataFrame:
    """Leads each key's rows in order through step(state, row) -> (state, row to give out or None); a key begins with the state None.

    One shuffle by key and a sort, which may spill; a task holds a batch and one state, so a key costs time in line with its rows.
    """
    names = rows.columns
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for b in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in b.columns)):
                row = dict(zip(names, values))
                if row[key] != at:
                    at, state = row[key], None
                state, given = step(state, row)
                if given is not None:
                    out.append(given)
            columns = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
