"""Order-dependent operators: ranks, sequences, folds, samples. Ties always end in a unique key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .prefix import numbered


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, to: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(to) <= k)


def hash_order(seed: int, *keys: str | Column) -> Column:
    """A reproducible random order: the digest of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys]))


def capped(df: DataFrame, by: str, key: str, cap: int, seed: int = 2026) -> DataFrame:
    """At most cap rows of each group, chosen by hash order (a sampling operator: the cap is its point)."""
    return top_k(df, [by], [hash_order(seed, key), F.col(key)], cap, "__n").drop("__n")


def keyed_dedup(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__k", key).transform(lambda x: top_k(x, ["__k"], order, 1, "__n")).drop("__k", "__n")


def rrf(rankings: DataFrame, source: str, item: str, rank: str, k: int = 60, by: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the lists; ties by the first list's order."""
    keys = by or []
    fused = rankings.groupBy(*keys, item).agg(F.sum(1 / (F.lit(k) + F.col(rank))).alias("score"), F.min(F.struct(source, rank)).alias("first"))
    return fused.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "first", item))).drop("first")


def sequence(df: DataFrame, by: str, order: list[Column], to: str = "seq") -> DataFrame:
    """Gapless numbers from 1 within each group."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def year_on_year(df: DataFrame, by: list[str], year: str, value: str) -> DataFrame:
    """Change against the row of the year before, null if that year is missing or its value isn't positive."""
    w = Window.partitionBy(*by).orderBy(year)
    before = F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag(value).over(w))
    return df.withColumn("previous", before).withColumn("growth", F.when(F.col("previous") > 0, (F.col(value) - F.col("previous")) / F.col("previous")))


def recency_rank(df: DataFrame, by: list[str], year: str) -> DataFrame:
    """0 for the latest year, 1, 2 ... for those without a gap to it; null after the first gap."""
    w = Window.partitionBy(*by).orderBy(F.desc(year))
    r = F.dense_rank().over(w) - 1
    latest = F.max(year).over(Window.partitionBy(*by))
    return df.withColumn("recency", F.when(latest - F.col(year) == r, r))


def run_lengths(df: DataFrame, by: str, order: list[Column], value: str) -> DataFrame:
    """Each row's place in its run of equal values."""
    w = Window.partitionBy(by).orderBy(*order)
    starts = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    island = df.withColumn("__s", starts).withColumn("__g", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.withColumn("run", F.row_number().over(Window.partitionBy(by, "__g").orderBy(*order))).drop("__s", "__g")


def trim_repeats(df: DataFrame, by: str, order: list[Column], value: str, most: int = 3) -> DataFrame:
    """Each group up to, and without, the first row that makes a run of `most` equal values."""
    runs = run_lengths(df, by, order, value)
    hit = F.max((F.col("run") >= most).cast("int")).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("__h", hit).where("__h = 0").drop("__h", "run")


def within_budget(df: DataFrame, by: str, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows in order while their costs sum to no more than the budget; the first row always stays."""
    w = Window.partitionBy(by).orderBy(*order)
    spent = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = df.withColumn("spent", spent).withColumn("__n", F.row_number().over(w))
    return kept.where((F.col("spent") <= budget) | (F.col("__n") == 1)).drop("__n")


def nearest_earlier(df: DataFrame, by: str, order: list[Column], value: str, back: int = 12) -> DataFrame:
    """The last value at or up to `back` rows before each row."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-back, 0)
    return df.withColumn("about", F.last(value, ignorenulls=True).over(w))


def section_ends(df: DataFrame, by: str, start: str, last: Column) -> DataFrame:
    """Where a section that starts somewhere ends: before the next strictly later start, or at the last page."""
    w = Window.partitionBy(by).orderBy(start).rangeBetween(1, Window.unboundedFollowing)
    return df.withColumn("end", F.coalesce(F.min(start).over(w) - 1, last))


def voted_shift(df: DataFrame, by: str, shift: Column, least: int) -> DataFrame:
    """The most frequent shift of each group (the smaller on ties), null below the least votes."""
    votes = df.groupBy(by, shift.alias("shift")).agg(F.count("*").alias("votes"))
    best = votes.groupBy(by).agg(F.max_by("shift", F.struct("votes", -F.col("shift"))).alias("shift"), F.max("votes").alias("votes"))
    return best.withColumn("shift", F.when(F.col("votes") >= least, F.col("shift")))


def round_robin(df: DataFrame, outer: str, inner: str, key: str, n: int, seed: int = 2026) -> DataFrame:
    """n rows, one for each outer value a pass, rotating through its inner groups, each in hash order."""
    place = F.row_number().over(Window.partitionBy(outer, inner).orderBy(hash_order(seed, key), key))
    turn = F.row_number().over(Window.partitionBy(outer).orderBy("__i", hash_order(seed, inner), inner))
    return df.withColumn("__i", place).withColumn("round", turn).drop("__i").orderBy("round", outer, key).limit(n)


def per_bin(df: DataFrame, value: str, key: str, low: float, high: float, bins: int, n: int, seed: int = 2026) -> DataFrame:
    """About n / bins rows from each equal-width bin of [low, high), in hash order."""
    bin_ = F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins))
    return top_k(df.withColumn("bin", bin_).where((F.col("bin") >= 1) & (F.col("bin") <= bins)), ["bin"], [hash_order(seed, key), F.col(key)], -(-n // bins), "__n").drop("__n")


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: int = 2026) -> DataFrame:
    """n rows without replacement, by the largest u ** (1 / weight)."""
    u = (F.conv(F.substring(hash_order(seed, key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return df.withColumn("draw", F.pow(u, 1 / weight)).orderBy(F.desc("draw"), key).limit(n)


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 2026) -> DataFrame:
    """n rows shared over strata in proportion: floors first, the rest to the largest remainders."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    share = counts.crossJoin(F.broadcast(total)).withColumn("q", F.lit(n) * F.col("c") / F.col("t"))
    share = share.withColumn("f", F.floor("q")).withColumn("left", F.lit(n) - F.sum("f").over(Window.partitionBy()))  # one row a stratum
    order = F.row_number().over(Window.orderBy(F.desc(F.col("q") - F.col("f")), stratum))
    share = share.withColumn("take", F.col("f") + (order <= F.col("left")).cast("int")).select(stratum, "take")
    placed = df.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(seed, key), key)))
    return placed.join(share, stratum).where("__n <= take").drop("__n", "take")


def even_spread(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Up to k rows evenly spaced over the ordered rows."""
    n = df.count()
    step = max(1.0, n / k)
    placed = numbered(df, order, "__n")
    wanted = df.sparkSession.range(min(k, n)).select(F.floor(F.col("id") * step).cast("long").alias("__n"))
    return placed.join(F.broadcast(wanted), "__n").drop("__n")


def largest_per_group(df: DataFrame, by: list[str], n_groups: int, per_group: int, key: str, seed: int = 2026) -> DataFrame:
    """n groups of those with at least per_group rows, in hash order, and per_group rows of each."""
    able = df.groupBy(*by).agg(F.count("*").alias("c")).where(F.col("c") >= per_group)
    chosen = able.orderBy(hash_order(seed, *by), *by).limit(n_groups).select(*by)
    return top_k(df.join(F.broadcast(chosen), by, "left_semi"), by, [hash_order(seed, key), F.col(key)], per_group, "__n").drop("__n")


def admitted(df: DataFrame, by: str, ts: str, key: str, most: int, seconds: int = 60) -> DataFrame:
    """Marks calls that a limiter admits: fewer than `most` admitted calls of the same key in the last
    `seconds`. Denied calls leave no trace, so this is a fold over each key's calls, streamed in order
    with at most `most` remembered times; a hot key is bounded in memory."""
    schema = f"{key} long, {by} long, admitted boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen = None, []
        for batch in batches:
            out = []
            for k, who, at in zip(batch[key], batch[by], batch["__t"], strict=True):
                if who != last:
                    last, seen = who, []
                seen = [s for s in seen if s > at - seconds]
                ok = len(seen) < most
                if ok:
                    seen.append(at)
                out.append((k, who, ok))
            yield pd.DataFrame(out, columns=[key, by, "admitted"])

    ordered = df.select(key, by, F.col(ts).cast("timestamp").cast("double").alias("__t")).repartition(by).sortWithinPartitions(by, "__t", key)
    return ordered.mapInPandas(run, schema)
