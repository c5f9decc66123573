"""Running sums and places over whole tables, without one task that sees all rows.

Rows are dealt out by range of the order, each part is summed by itself, and the parts' totals, one row a part, give
every part what stands before it. The dealt rows are a table in the shared folder: both passes read the same parts, and
lost executors don't deal them anew."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import Tables


def dealt(df: DataFrame, order: Sequence[str | Column], name: str = "prefix") -> DataFrame:
    """df with __part: ranges of the order, ascending; rows of one value of the order stay together."""
    return Tables(df, name).keep(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def running(df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, Column]) -> DataFrame:
    """df with each named sum over the rows before and the row itself. Ties in the order count as they happen to lie, so
    the order should tell rows apart; nulls in what is summed add nothing."""
    rows = dealt(df.withColumns({f"__v_{k}": v for k, v in sums.items()}), order)
    parts = rows.groupBy("__part").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = parts.select("__part", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(parts, "__part").withColumns({k: F.coalesce(F.sum(f"__v_{k}").over(within), F.lit(0)) + F.col(f"__b_{k}") for k in sums})
    return found.drop("__part", *[f"__{x}_{k}" for k in sums for x in "vb"])


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """df with the place of each row in the order, from 0."""
    return running(df, order, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


_BEST = "grp string, first double, threshold double, balanced double"


def _best(steps: pa.Table, groups: pa.Table) -> pa.Table:
    """For each group the best threshold among the scores of one part, tuned without the group's own rows."""
    score, at = np.unique(steps.column("score").to_numpy(), return_inverse=True)
    a, u = (np.bincount(at, steps.column(c).to_numpy(), len(score)) for c in ("a", "u"))
    total = {c: groups.column(c)[0].as_py() for c in ("all_a", "all_u", "all_known", "all_null", "before_a", "before_u")}
    below_a, below_u = (total[f"before_{c}"] + np.cumsum(x) - x for c, x in (("a", a), ("u", u)))
    own: dict[str, list[int]] = {}
    for i, g in enumerate(steps.column("grp").to_pylist()):
        own.setdefault(g, []).append(i)
    mine_a, mine_u, out = steps.column("a").to_numpy(), steps.column("u").to_numpy(), []
    for g in groups.to_pylist():
        rows = np.array(own.get(g["grp"], []), dtype=np.int64)
        own_a, own_u = (np.bincount(at[rows], x[rows], len(score)) for x in (mine_a, mine_u))
        others = a + u - own_a - own_u > 0  # a score that the other groups have
        na, nu = total["all_a"] - g["na"], total["all_u"] - g["nu"]
        if na <= 0 or nu <= 0 or not others.any():
            continue
        kept = (total["all_known"] - g["known"]) - (below_a - (g["own_a"] + np.cumsum(own_a) - own_a))
        left = (total["all_null"] - g["nulls"]) + (below_u - (g["own_u"] + np.cumsum(own_u) - own_u))
        balanced = np.where(others, (kept / na + left / nu) / 2, -1.0)
        best = int(np.argmax(balanced))
        out.append((g["grp"], float(score[int(np.argmax(others))]), float(score[best]), float(balanced[best])))
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.float64()))], names=["grp", "first", "threshold", "balanced"])


def held_out_thresholds(df: DataFrame, group: str, answerable: str, score: str) -> DataFrame:
    """For each group the score below which to abstain, tuned for balanced accuracy on all other groups, and how it does on
    the group: group, threshold, unanswerable, abstained, answerable, wrongly_abstained.

    A null score always abstains. Ties go to the lower threshold; one below all scores is a candidate too. The threshold is
    null where the others lack answerable or unanswerable rows, and nothing is abstained then. Scores are dealt out by range:
    a task has its scores' counts and, for each group, what stands before, and tells each group's best among its own."""
    rows = df.where(F.col(answerable).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.col(answerable).alias("yes"), F.col(score).cast("double").alias("score"))
    rows = rows.withColumn("grp", F.coalesce(F.concat(F.lit("+"), "grp"), F.lit("")))
    n = lambda c: F.count_if(c)
    yes, known = F.col("yes"), F.col("score").isNotNull()
    groups = rows.groupBy("grp").agg(n(yes).alias("na"), n(~yes).alias("nu"), n(yes & known).alias("known"), n(~yes & ~known).alias("nulls"), n(known).alias("scored"))
    groups = Tables(df, "groups").keep(groups)
    everyone = groups.agg(F.sum("na").alias("all_a"), F.sum("nu").alias("all_u"), F.sum("known").alias("all_known"), F.sum("nulls").alias("all_null"), F.sum("scored").alias("all_scored"))
    steps = dealt(rows.where("score is not null").groupBy("grp", "score").agg(n(yes).alias("a"), n(~yes).alias("u")), ["score"])
    parts = steps.groupBy("__part", "grp").agg(F.sum("a").alias("a"), F.sum("u").alias("u"))
    numbers = [r["__part"] for r in parts.select("__part").distinct().orderBy("__part").collect()]  # one a task
    grid = groups.withColumn("__part", F.explode(F.lit(numbers).cast("array<int>"))).join(parts, ["__part", "grp"], "left").fillna(0, ["a", "u"])
    before = lambda *by: Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = grid.groupBy("__part").agg(F.sum("a").alias("sa"), F.sum("u").alias("su"))
    sums = sums.select("__part", *[F.coalesce(F.sum(f"s{c}").over(before()), F.lit(0)).alias(f"before_{c}") for c in "au"])
    grid = grid.withColumns({f"own_{c}": F.coalesce(F.sum(c).over(before("grp")), F.lit(0)) for c in "au"}).drop("a", "u")
    grid = grid.join(sums, "__part").crossJoin(F.broadcast(everyone))  # one row
    found = steps.groupBy("__part").cogroup(grid.groupBy("__part")).applyInArrow(_best, _BEST)
    best = found.groupBy("grp").agg(F.min("first").alias("first"), F.max(F.struct("balanced", (-F.col("threshold")).alias("t"))).alias("b"))
    best = best.select("grp", F.when(-F.col("b.t") == F.col("first"), F.col("first") - 1).otherwise(-F.col("b.t")).alias("threshold"))
    tuned = groups.crossJoin(F.broadcast(everyone)).join(best, "grp", "left")
    can = (F.col("all_a") > F.col("na")) & (F.col("all_u") > F.col("nu"))
    tuned = tuned.select("grp", "na", "nu", F.when(can & (F.col("all_scored") == F.col("scored")), 0.0).otherwise(F.col("threshold")).alias("threshold"))
    gone = F.col("threshold").isNotNull() & (F.col("score").isNull() | (F.col("score") < F.col("threshold")))
    held = rows.join(tuned.select("grp", "threshold"), "grp").groupBy("grp").agg(n(gone & ~yes).alias("abstained"), n(gone & yes).alias("wrongly_abstained"))
    named = F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias(group)
    return tuned.join(held, "grp").select(named, "threshold", F.col("nu").alias("unanswerable"), "abstained", F.col("na").alias("answerable"), "wrongly_abstained")
