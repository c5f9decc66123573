"""Splits that don't leak: by hash of a group, by time, with windows of past documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .joins import band_join
from .prefix import numbered


def group_bucket(group: Column | str, seed: int = 2026) -> Column:
    """A stable number in [0, 1) per group."""
    g = F.lower(F.trim(F.col(group) if isinstance(group, str) else group))
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), g), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def split_by_group(df: DataFrame, group: str, held_out: float = 0.1, seed: int = 2026, to: str = "split") -> DataFrame:
    return df.withColumn(to, F.when(group_bucket(group, seed) < held_out, "dev").otherwise("train"))


def time_split(records: DataFrame, first_test: Column, dev_share: float = 0.5) -> DataFrame:
    """train before the first test day; later records dev, then test, by date and id in the given share; a
    record whose company has a test document is left out ("excluded"). records: (id, company, day)."""
    cut = records.withColumn("late", F.col("day") >= first_test)
    late = cut.where("late")
    n_dev = late.agg(F.round(F.count("*") * dev_share, 0).alias("__dev"))  # one row
    placed = numbered(late, ["day", "id"], "__n").crossJoin(F.broadcast(n_dev))
    placed = placed.withColumn("slice", F.when(F.col("__n") < F.col("__dev"), "dev").otherwise("test")).drop("__n", "__dev")
    everything = placed.unionByName(cut.where("not late").withColumn("slice", F.lit("train"))).drop("late")
    tested = everything.where("slice = 'test'").select("company").distinct().withColumn("__t", F.lit(True))
    joined = everything.join(tested, "company", "left")
    return joined.withColumn("slice", F.when((F.col("slice") != "test") & F.col("__t"), "excluded").otherwise(F.col("slice"))).drop("__t")


def strictness(split: DataFrame) -> DataFrame:
    """One row: train records not before the first test day, and companies on both sides; both must be 0."""
    first = split.where("slice = 'test'").agg(F.min("day").alias("first"))
    late = split.where("slice = 'train'").crossJoin(F.broadcast(first)).agg(F.count_if(F.col("day") >= F.col("first")).alias("late"))  # one row
    both = split.where("slice in ('train', 'test')").groupBy("company").agg(F.count_distinct("slice").alias("n")).agg(F.count_if(F.col("n") > 1).alias("on_both_sides"))
    return late.crossJoin(both)


def reference_window(asked: DataFrame, past: DataFrame, years: int = 4) -> DataFrame:
    """For each asked (id, company, day), the past rows (ref_id, ref_company, ref_day) of other companies from
    `years` years before the day up to, and without, the day. Buckets of a year make it an equality join."""
    days = lambda c: F.datediff(F.col(c) if isinstance(c, str) else c, F.lit("1970-01-01"))
    joined = band_join(asked, past, days("ref_day"), days(F.add_months("day", -12 * years)), days("day"), 366.0)
    return joined.where((F.col("ref_company") != F.col("company")) & (F.col("ref_id") != F.col("id")))


def reference_counts(asked: DataFrame, past: DataFrame, years: int = 4) -> DataFrame:
    """How many rows reference_window has for each asked id, and the least ref_id of them: id, n, first_id. Ids without any have no
    row. Asked and past rows have ids of one table, so that a row is of its own company.

    Pairs aren't told: past rows are summed by day, with the least id and the least one of any other company, and days are summed
    over each window that is asked for. What the asked company itself has there is taken off, joined by company. So the work
    grows with the rows and with the square of the days, whatever number of rows a day has."""
    first = lambda c: F.add_months(c, -12 * years)
    rows = past.where("ref_id is not null and ref_company is not null and ref_day is not null")
    by_company = rows.groupBy("ref_day", "ref_company").agg(F.count("*").alias("n"), F.min("ref_id").alias("least"))
    days = by_company.withColumn("x", F.struct(F.col("least").alias("id"), F.col("ref_company").alias("company")))
    top = days.groupBy("ref_day").agg(F.sum("n").alias("n"), F.min_by("x", "x.id").alias("a"))
    rest = days.join(top.select("ref_day", "a"), "ref_day").where("x.company <> a.company").groupBy("ref_day").agg(F.min_by("x", "x.id").alias("b"))
    top = top.join(rest, "ref_day", "left")
    # windows of the days asked for
    windows = asked.where("day is not null").select("day").distinct()
    number = lambda c: F.datediff(c, F.lit("1970-01-01"))
    held = band_join(windows, top, number(F.col("ref_day")), number(first(F.col("day"))), number(F.col("day")), 366.0)
    held = held.select("day", "n", F.posexplode(F.array_compact(F.array("a", "b"))).alias("i", "x"))
    summed = held.groupBy("day").agg(F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n"), F.min_by("x", "x.id").alias("a"))
    other = held.join(summed.select("day", "a"), "day").where("x.company <> a.company").groupBy("day").agg(F.min_by("x", "x.id").alias("b"))
    summed = summed.join(other, "day", "left")
    # less what is the asked company's own
    mine = asked.join(by_company.withColumnRenamed("n", "own").withColumnRenamed("ref_company", "company"), "company")
    mine = mine.where((F.col("ref_day") < F.col("day")) & (F.col("ref_day") >= first(F.col("day")))).groupBy("id", "company", "day").agg(F.sum("own").alias("own"))
    told = asked.where("company is not null").join(summed, "day").join(mine, ["id", "company", "day"], "left")
    told = told.select("id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n"), F.when(F.col("a.company") != F.col("company"), F.col("a.id")).otherwise(F.col("b.id")).alias("first_id"))
    return told.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))


def exclusions(*lists: tuple[str, DataFrame]) -> DataFrame:
    """Ids of named lists with the sorted distinct reasons for leaving them out."""
    out = None
    for reason, df in lists:
        rows = df.select("id", F.lit(reason).alias("reason"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
