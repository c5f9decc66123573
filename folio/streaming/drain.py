"""A queue of work drained by micro-batches, each written once however often it is tried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import exists


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drain(queue: DataFrame, work: Callable[[DataFrame], DataFrame], key: str, folder: str, attempts: int = 3, on_written: Callable[[int], None] | None = None) -> StreamingQuery:
    """Work through what stands in a streamed queue and stop.

    ``work`` gives a row for each job with the key and ``error``, null where the job is done. Jobs with an error are tried
    again, ``attempts`` times in all; what fails to the end goes to ``folder``/failed, what is done to ``folder``/done. A key
    that an earlier batch has done is not done again, and of a key's rows in one batch one counts.

    Each batch has folders of its own, named by its number and emptied before it begins. Spark gives a batch that was not
    committed the same number and the same rows when the queue is drained again, so a run that is killed at any point leaves
    nothing twice and loses nothing. ``on_written`` is called with the number of a batch that is written but not yet
    committed. Progress is in ``folder``/progress; the folder is to be shared by the driver and the executors."""
    spark = queue.sparkSession
    done, failed = f"{folder}/done", f"{folder}/failed"

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        for path in (done, failed, f"{folder}/tried"):
            _remove(session, f"{path}/batch={number}")
        todo = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if exists(session, done):
            before = session.read.option("basePath", done).parquet(done).where(F.col("batch") < number).select(key)
            todo = todo.join(before, key, "left_anti")
        for k in range(attempts):
            path = f"{folder}/tried/batch={number}/attempt={k}"
            work(todo).write.parquet(path)
            tried = session.read.parquet(path)
            tried.where("error is null").drop("error").write.parquet(f"{done}/batch={number}/attempt={k}")
            left = tried.where("error is not null")
            if left.isEmpty():
                break
            if k + 1 == attempts:
                left.write.parquet(f"{failed}/batch={number}")
            todo = todo.join(left.select(key), key, "left_semi")
        if on_written:
            on_written(number)

    return queue.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def drained(spark: SparkSession, folder: str) -> DataFrame:
    """What is done, with the batch and the attempt that did it."""
    return spark.read.option("basePath", f"{folder}/done").parquet(f"{folder}/done")
