"""Positions and events as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haltwise.sources.folders import shared_folder


def ingest(raw: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Valid positions, each (journey, time) once, late ones up to the watermark."""
    return raw.where("is_ongoing AND event_type = 'VP'").withWatermark("tst", late).dropDuplicatesWithinWatermark(["jrnid", "tst"])


def hourly_counts(stream: DataFrame, time: str, kind: str, value: str, late: str = "10 minutes") -> DataFrame:
    """Rows and sums by hour and kind; state of an hour is dropped once the watermark has passed it."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, "1 hour").alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("hour"), kind, "n", "total")


def sessions(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events of a key without a gap."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_end(spark: SparkSession, plan: Callable[[DataFrame], DataFrame], path: str, schema: StructType, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over the files at a path until all is read, results in tables of the shared folder, one for each batch.

    keys: the stream updates rows of these keys, and the last update of each counts; without keys it appends, so groups
    come out once the watermark has passed them. In both modes state behind the watermark is dropped.
    A batch that is run again writes the same table anew.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(path)
    out = plan(stream)

    def save(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/b={batch}")

    query = out.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").drop("b")
    if not keys:
        return rows.drop("_batch")
    last = F.max(F.struct("_batch", *[F.col(c) for c in out.columns if c not in keys])).alias("_r")
    return rows.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in out.columns])
