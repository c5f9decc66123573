"""Event logs as streams: numbering, stage states, quotas, limits, resuming and retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import local_day_start


def numbered(stream: DataFrame, by: str, order: str) -> DataFrame:
    """Gapless numbers from 1 for each key, in arrival order within a batch; the count is the state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        rows["seq"] = range(n + 1, n + len(rows) + 1)
        state.update((n + len(rows),))
        yield rows[[by, order, "seq"]]

    kinds = dict(stream.dtypes)
    schema = f"{by} {kinds[by]}, {order} {kinds[order]}, seq long"
    return stream.select(by, order).groupBy(by).applyInPandasWithState(run, schema, "n long", "append", "NoTimeout")


def limited(stream: DataFrame, by: str, ts: str, key: str, most: int, seconds: int = 60) -> DataFrame:
    """Marks admitted calls: fewer than `most` admitted ones of the key in the last `seconds`. Denied calls
    leave no trace; the state is the times of at most `most` admitted calls."""

    def run(who: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["__t", key], kind="stable")
        marks = []
        for t in rows["__t"]:
            seen = [s for s in seen if s > t - seconds]
            marks.append(len(seen) < most)
            if marks[-1]:
                seen.append(float(t))
        state.update((seen,))
        yield pd.DataFrame({key: rows[key], by: rows[by], "admitted": marks})

    kinds = dict(stream.dtypes)
    rows = stream.select(key, by, F.col(ts).cast("timestamp").cast("double").alias("__t"))
    return rows.groupBy(by).applyInPandasWithState(run, f"{key} {kinds[key]}, {by} {kinds[by]}, admitted boolean", "times array<double>", "append", "NoTimeout")


def day_counts(events: DataFrame, by: str, ts: str, zone: str = "+05:30") -> DataFrame:
    """Calls of each key on each calendar day of the zone, and of all keys (null)."""
    return events.withColumn("day", F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))).groupingSets([[F.col("day"), F.col(by)], [F.col("day")]], "day", by).agg(F.count("*").alias("n")) if not events.isStreaming else events.groupBy(F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)).alias("day"), by).agg(F.count("*").alias("n"))


def over_quota(counts: Column, per_key: int) -> Column:
    return counts >= per_key


def stage_status(events: DataFrame, job: str, stage: str, status: str, seq: str) -> DataFrame:
    """The last status of each stage of each job."""
    return events.groupBy(job, stage).agg(F.max_by(status, seq).alias("status"), F.max(seq).alias("seq"))


def after(events: DataFrame, job: str, value: object, seq: str, last: int) -> DataFrame:
    """Events of one job beyond the last one seen, in order."""
    return events.where((F.col(job) == value) & (F.col(seq) > last)).orderBy(seq)


def expired(rows: DataFrame, created: str, now: Column, days: int = 30) -> DataFrame:
    return rows.where(F.col(created).cast("timestamp") < now - F.make_dt_interval(F.lit(days)))


def remaining(done: DataFrame, todo: DataFrame, key: str) -> DataFrame:
    """Work without a final result yet: how a batch resumes."""
    return todo.join(done.select(key), key, "left_anti")


def cache_state(stored_version: Column, version: str, stored_models: Column, models: str) -> Column:
    return F.when(stored_version.isNull(), "legacy").when(stored_version != version, "stale_version").when(stored_models != models, "stale_models").otherwise("fresh")


def queue_positions(queue: DataFrame, by: str, priority: str, order: str) -> DataFrame:
    from pyspark.sql import Window

    return queue.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(priority, order)) - 1)


def day_start(ts: str) -> Column:
    return local_day_start(F.col(ts).cast("timestamp"))
