"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names one; else one of this session's own, where all tasks run on this machine."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="haltwise-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


class Steps:
    """Tables of an iteration, in the shared folder: each is written once and removed when the next one stands."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table: its lineage ends there."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        sc = self.spark.sparkContext
        for t in tables:
            at = sc._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t))[0])
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)

    def keep_only(self, *tables: DataFrame) -> None:
        """Removes all tables but these."""
        kept = {id(t) for t in tables}
        self.drop(*[t for k, (_, t) in self.paths.items() if k not in kept])
