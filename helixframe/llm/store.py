"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Store:
    """Writes a table as Parquet, which cuts lineage and survives lost executors, and reads it back.

    The folder is spark.checkpoint.dir, or what setCheckpointDir was given. Only in local mode, where one machine does
    everything, a temporary folder stands in for an unset one; on a cluster that is an error, since executors would write
    where the driver cannot read. Shuffle files of a step are removed as soon as its table is written. What is not
    dropped goes when the JVM ends. Needs a classic session (not Spark Connect) to delete folders.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp()
        self.spark, self.root, self._n = spark, f"{base}/helixframe-{uuid.uuid4().hex}", 0
        self._fs_path(self.root, lambda fs, p: fs.deleteOnExit(p))

    def _fs_path(self, path: str, act):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return act(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._helix_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._fs_path(df._helix_path, lambda fs, p: fs.delete(p, True))
