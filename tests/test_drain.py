"""A drained queue has each job once, whatever stops a run."""

import pytest
from pyspark.sql import functions as F

from folio.streaming.drain import drain, drained


def jobs(spark, path, rows):
    spark.createDataFrame(rows, "id long, n int").coalesce(1).write.mode("append").json(path)


def run(spark, tmp, work, **more):
    queue = spark.readStream.schema("id long, n int").option("maxFilesPerTrigger", 1).json(f"{tmp}/jobs")
    query = drain(queue, work, "id", f"{tmp}/out", **more)
    query.awaitTermination()


def square(df):
    return df.select("id", (F.col("n") * F.col("n")).alias("square"), F.when(F.col("n") < 0, "negative").alias("error"))


def rows_of(spark, tmp):
    return sorted((r["id"], r["square"], r["batch"], r["attempt"]) for r in drained(spark, f"{tmp}/out").collect())


def test_a_run_killed_between_write_and_commit_leaves_nothing_twice(spark, tmp_path):
    for k in range(3):
        jobs(spark, f"{tmp_path}/jobs", [(10 * k + i, i) for i in range(5)])
    calls = []

    def killed(number):
        calls.append(number)
        if calls.count(1) == 1 and number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path, square, on_written=killed)
    assert {b for *_, b, _ in rows_of(spark, tmp_path)} == {0, 1}  # written, and not committed
    run(spark, tmp_path, square, on_written=killed)
    assert calls == [0, 1, 1, 2]
    assert [(i, s) for i, s, *_ in rows_of(spark, tmp_path)] == [(10 * k + i, i * i) for k in range(3) for i in range(5)]
    jobs(spark, f"{tmp_path}/jobs", [(3, 9), (99, 2), (99, 2), (None, 1)])  # done before, twice in one batch, no key
    run(spark, tmp_path, square)
    assert [(i, s) for i, s, b, _ in rows_of(spark, tmp_path) if b == 3] == [(99, 4)]


def test_failed_jobs_are_tried_again_and_then_told(spark, tmp_path):
    jobs(spark, f"{tmp_path}/jobs", [(1, 2), (2, -3), (3, 4)])
    tries = []

    def flaky(df):
        tries.append(sorted(r["id"] for r in df.select("id").collect()))
        late = F.when((F.col("id") == 3) & F.lit(len(tries) < 2), "busy")
        return square(df).withColumn("error", F.coalesce("error", late))

    run(spark, tmp_path, flaky)
    assert tries == [[1, 2, 3], [2, 3], [2]]
    assert rows_of(spark, tmp_path) == [(1, 4, 0, 0), (3, 16, 0, 1)]
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/failed").select("id", "error").collect()] == [(2, "negative")]
