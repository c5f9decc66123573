"""Intermediate tables in the folder that the driver and every executor share.

Lineage is cut by writing a Parquet table and reading it again: each table is computed once, lost
executors do not lose it, and later steps read only the columns they need.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
FREE_EVERY_S = 10
_FREED = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Where neither is set, a temporary folder serves a session whose executors are threads of the driver
    (tests); on a cluster that would scatter the tables over machines, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="folio-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished queries: it does so when the driver's JVM has collected
    what refers to them, which a job of many short passes would otherwise wait for until its disks are full."""
    if time.monotonic() - _FREED[0] > FREE_EVERY_S:
        spark._jvm.java.lang.System.gc()
        _FREED[0] = time.monotonic()


class Scratch:
    """Tables of one run, under a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", compression).parquet(path)
        free_shuffles(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no returned DataFrame reads; all of the run's if none is named."""
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
