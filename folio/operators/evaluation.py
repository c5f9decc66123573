"""Summaries of runs and judgements, and selection among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .prefix import numbered as placed_in, running
from .stats import hash_draw, wilson


def permutation_p(df: DataFrame, x: str, y: str, key: str, times: int = 200, seed: int = 2026) -> DataFrame:
    """One row: (hits + 1) / (times + 1), a hit being a shuffled correlation as large as the observed one.
    x stays and y is dealt anew by the order of a digest; ranks are within one shuffle, so nothing is global."""
    observed = df.agg(F.abs(F.corr(x, y)).alias("observed"))
    numbered = placed_in(df.select(x, y, key), [key], "__i").withColumn("__i", F.col("__i") + 1)
    rounds = numbered.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(times))))
    place = F.row_number().over(Window.partitionBy("round").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "round", key)), key))
    dealt = rounds.select("round", place.alias("__i"), F.col(y).alias("__y"))
    shuffled = rounds.select("round", "__i", x).join(dealt, ["round", "__i"]).groupBy("round").agg(F.abs(F.corr(x, "__y")).alias("r"))
    return shuffled.crossJoin(F.broadcast(observed)).agg(((F.count_if(F.col("r") >= F.col("observed")) + 1) / (times + 1)).alias("p"))


def paired_bootstrap(df: DataFrame, group: str, a: str, b: str, resamples: int = 200, seed: int = 2026) -> DataFrame:
    """One row: mean difference a - b and its 95 % interval, both sides with the same draws of groups."""
    sums = df.groupBy(group).agg(F.sum(a).alias("a"), F.sum(b).alias("b"), F.count("*").alias("c"))
    numbered = sums.withColumn("slot", F.row_number().over(Window.orderBy(group)) - 1)  # one row a group
    n = numbered.agg(F.count("*").alias("n"))
    draws = df.sparkSession.range(resamples).withColumnRenamed("id", "resample").crossJoin(F.broadcast(n))
    draws = draws.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("resample", hash_draw(seed, F.col("resample"), F.col("k"), F.col("n")).alias("slot"))
    m = draws.join(numbered, "slot").groupBy("resample").agg(((F.sum("a") - F.sum("b")) / F.sum("c")).alias("d")).agg(F.array_sort(F.collect_list("d")).alias("ds"))
    at = lambda q: F.get("ds", F.least(F.size("ds") - 1, F.floor(F.lit(q) * F.size("ds")).cast("int")))
    return df.agg((F.avg(a) - F.avg(b)).alias("difference")).crossJoin(m.select(at(0.025).alias("low"), at(0.975).alias("high")))


def constrained_threshold(df: DataFrame, answerable: str, score: str, most_refused: float = 0.1) -> DataFrame:
    """One row: the highest score that refuses at most a share of the answerable questions."""
    a = df.where(answerable)
    total = a.agg(F.count("*").alias("n"), F.count_if(F.col(score).isNull()).alias("nulls"))
    at = a.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("c"))
    judged = running(at, [score], {"to": F.col("c")}).withColumn("below", F.col("to") - F.col("c")).crossJoin(F.broadcast(total))
    return judged.where((F.col("below") + F.col("nulls")) / F.col("n") <= most_refused).agg(F.max(score).alias("threshold"))


def leave_one_out(df: DataFrame, group: str, value: str) -> DataFrame:
    """For each group the mean of all other groups' values, from sums: no group meets the others' rows."""
    sums = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    total = sums.agg(F.sum("s").alias("all_s"), F.sum("c").alias("all_c"))
    return sums.crossJoin(F.broadcast(total)).select(group, F.try_divide(F.col("all_s") - F.col("s"), F.col("all_c") - F.col("c")).alias("others"), (F.col("s") / F.col("c")).alias("own"))


def per_level(df: DataFrame, level: str, value: str, levels: list[str]) -> DataFrame:
    """Count, mean and median of each level in the stated order, empty levels too."""
    wanted = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(levels)], "place int, level string")
    g = df.groupBy(F.col(level).alias("level")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"))
    return wanted.join(g, "level", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def coverage_matrix(found: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    return found.groupBy(row).pivot(column, columns).agg(F.count(F.lit(1))).na.fill(0)


def rung_summary(results: DataFrame, rung: str, seed: str, item: str, value: str) -> DataFrame:
    """Per rung the mean over items of the mean over seeds, and the spread of the seeds' means."""
    items = results.groupBy(rung, item).agg(F.avg(value).alias("v"))
    seeds = results.groupBy(rung, seed).agg(F.avg(value).alias("v")).groupBy(rung).agg(F.stddev_samp("v").alias("seed_spread"))
    return items.groupBy(rung).agg(F.avg("v").alias("mean"), F.count("*").alias("items")).join(seeds, rung)


def best_per_field(results: DataFrame, field: str, rung: str, value: str, preference: Column) -> DataFrame:
    """The rung with the best mean for each field; ties go to the smaller preference."""
    m = results.groupBy(field, rung).agg(F.avg(value).alias("v")).withColumn("p", preference)
    return m.groupBy(field).agg(F.max_by(rung, F.struct(F.round("v", 9), -F.col("p"))).alias("best"), F.max("v").alias("score"))


def rates(df: DataFrame, hit: str, sets: list[list[str]]) -> DataFrame:
    """Counts and rates with Wilson intervals over all and over each set of columns."""
    columns = sorted({c for s in sets for c in s})
    g = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("int")).alias("k"))
    return g.withColumn("w", wilson(F.col("k"), F.col("n"))).select(*columns, "n", "k", (F.col("k") / F.col("n")).alias("rate"), "w.low", "w.high")


def misses_first(df: DataFrame, by: list[str], hit: str, key: str, k: int) -> DataFrame:
    """The first k rows of each group, misses before hits."""
    w = Window.partitionBy(*by).orderBy(F.col(hit).cast("int"), key)
    return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def terciles(df: DataFrame, value: str, least: int = 30) -> DataFrame:
    """One row: the cuts at a third and two thirds, null with fewer than `least` values or equal cuts."""
    q = df.agg(F.count(value).alias("n"), F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    ok = (F.col("n") >= least) & (F.get("q", F.lit(0)) < F.get("q", F.lit(1)))
    return q.select("n", F.when(ok, F.get("q", F.lit(0))).alias("low"), F.when(ok, F.get("q", F.lit(1))).alias("high"))


def first_reason(df: DataFrame, reasons: list[tuple[str, Column]], to: str = "reason") -> DataFrame:
    """df with the first reason that holds, or null."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        out = F.when(condition, name).otherwise(out)
    return df.withColumn(to, out)


def report(df: DataFrame, reason: str, reasons: list[str]) -> DataFrame:
    """How many rows each reason took, zeros too, and how many stay (null)."""
    counts = df.groupBy(reason).agg(F.count("*").alias("n"))
    wanted = df.sparkSession.createDataFrame([(r,) for r in [*reasons, None]], f"{reason} string")
    return wanted.join(counts, wanted[reason].eqNullSafe(counts[reason]), "left").select(wanted[reason], F.coalesce("n", F.lit(0)).alias("n"))


def value_matches(kind: Column, gold: Column, pred: Column) -> Column:
    """Whether values agree within their kind's tolerance: money half a per cent, percentages 0.05, P/E one per cent."""
    gap = F.abs(pred - gold)
    return F.when(gold.isNull() | pred.isNull(), False).when(kind == "money", gap <= 0.005 * F.abs(gold)).when(kind == "percent", gap <= 0.05).when(kind == "pe", gap <= 0.01 * F.abs(gold)).otherwise(gap == 0)


def select_field(candidates: DataFrame, by: list[str], value: str, source: str, score: str, priority: Column) -> DataFrame:
    """One value per group: by priority of the source, then score, then value. It is confirmed when another
    source has the same value, and a clash when the same source has another at the same score."""
    c = candidates.withColumn("__p", priority)
    w = Window.partitionBy(*by).orderBy("__p", F.desc(score), value)
    best = c.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*by, F.col(value).alias("value"), F.col(source).alias("source"), F.col(score).alias("score"))
    others = c.join(best.withColumnsRenamed({"value": "__v", "source": "__s", "score": "__c"}), by)
    marks = others.groupBy(*by).agg(F.bool_or((F.col(value) == F.col("__v")) & (F.col(source) != F.col("__s"))).alias("confirmed"), F.bool_or((F.col(value) != F.col("__v")) & (F.col(source) == F.col("__s")) & (F.col(score) == F.col("__c"))).alias("clash"))
    return best.join(marks, by).withColumn("verdict", F.when(F.col("clash"), "clash").when(F.col("confirmed"), "confirmed").otherwise("single"))


def wide(rows: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """Long rows (key, name, value) as one row a key with the stated columns."""
    return rows.groupBy(key).pivot(name, names).agg(F.first(value))


def adds_up(fresh: Column, ofs: Column, total: Column, step: Column) -> Column:
    """consistent, inconsistent beyond the printed step, or unknown with a part missing."""
    return F.when(fresh.isNull() | ofs.isNull() | total.isNull(), "unknown").when(F.abs(fresh + ofs - total) <= step, "consistent").otherwise("inconsistent")


def tag_spans(tags: DataFrame, by: str, place: str, tag: str) -> DataFrame:
    """Spans (label, first, last) of B-, I-, O tags: a stray I- opens a span, another label ends one."""
    w = Window.partitionBy(by).orderBy(place)
    label = F.when(F.col(tag) != "O", F.substring(tag, 3, 100))
    t = tags.withColumn("__l", label)
    opens = F.col("__l").isNotNull() & (F.col(tag).startswith("B-") | F.lag("__l").over(w).isNull() | (F.lag("__l").over(w) != F.col("__l")))
    t = t.withColumn("__o", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("__g", F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.where("__l is not null").groupBy(by, "__g").agg(F.first("__l").alias("label"), F.min(place).alias("first"), F.max(place).alias("last")).drop("__g")


def listed(df: DataFrame, contains: str | None = None, columns: list[str] | None = None, equal: dict | None = None, below: tuple[str, float] | None = None, order: list[Column] | None = None) -> DataFrame:
    """A listing query: a text in any of the columns, equalities, a bound and an order; absent ones filter nothing."""
    out = df
    if contains and columns:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(contains.lower())), F.lit(False))
        out = out.where(hit)
    for c, v in (equal or {}).items():
        if v is not None:
            out = out.where(F.col(c) == v)
    if below:
        out = out.where(F.col(below[0]) < below[1])
    return out.orderBy(*order) if order else out


def balanced(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """df with weights by which all labels count alike: rows over labels times the label's rows."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))  # one row a label
    all_ = Window.partitionBy(F.lit(0))
    share = n.select(label, (F.sum("__n").over(all_) / (F.count("*").over(all_) * F.col("__n"))).alias(weight))
    return df.join(F.broadcast(share), label)


def text_classifier(df: DataFrame, text: str, label: str, weight: str | None = None, features: int = 1 << 17):
    """TF-IDF of words and word pairs under a logistic regression; a fitted pipeline. Features are hashed into as many
    buckets of either kind, so no vocabulary comes to the driver; counts are plain, not logarithmic."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer, VectorAssembler

    stages = [
        RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"\W+"), NGram(n=2, inputCol="__w", outputCol="__p"), HashingTF(inputCol="__w", outputCol="__f1", numFeatures=features), HashingTF(inputCol="__p", outputCol="__f2", numFeatures=features),
        VectorAssembler(inputCols=["__f1", "__f2"], outputCol="__f"), IDF(inputCol="__f", outputCol="__x", minDocFreq=2), LogisticRegression(featuresCol="__x", labelCol=label, weightCol=weight, maxIter=20) if weight else LogisticRegression(featuresCol="__x", labelCol=label, maxIter=20),
    ]
    return Pipeline(stages=stages).fit(df)
