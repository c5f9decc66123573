"""Readers and writers. Schemas are stated, columns are pruned, missing inputs are empty tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a run's tables, under the folder that the driver and all executors share; a temporary one only
    where none is named and the executors are threads of the driver."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or 'file://' + tempfile.mkdtemp(prefix='folio-')}/{name}-{uuid.uuid4().hex[:12]}"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (compressed or not) with a stated schema; no rows where the path is absent."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, compression: str = "gzip") -> None:
    """JSON lines; with an order, the same rows give the same content."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("compression", compression).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True) if exists(spark, path) else spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_years(spark: SparkSession, path: str, columns: list[str], years: tuple[int, int] | None = None) -> DataFrame:
    """Only the named columns, and only the years asked for; both reach the Parquet scan."""
    df = spark.read.parquet(path)
    return (df if years is None else df.where(F.col("year").between(*years))).select(*columns)


def write_parquet(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Parquet; partitions that df has replace those that are there, others stay."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def read_allowed(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns that df has, in df's order."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in set(allowed)])


def page_texts(df: DataFrame, pages: str) -> DataFrame:
    """df with its map of Page_n to text as an array of (page, text), ordered by page."""
    entries = F.transform(F.map_entries(pages), lambda e: F.struct(F.regexp_extract(e["key"], r"(\d+)$", 1).try_cast("int").alias("page"), e["value"].alias("text")))
    return df.withColumn(pages, F.array_sort(F.filter(entries, lambda e: e["page"].isNotNull())))


def manifest(used: DataFrame) -> DataFrame:
    """Sorted distinct ids of each artefact. used: (artefact, id)."""
    return used.groupBy("artefact").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: how many values, how many distinct, and the share of nulls."""
    total = df.agg(F.count("*").alias("n"), *[F.struct(F.count(F.col(f"`{c}`")).alias("v"), F.approx_count_distinct(F.col(f"`{c}`")).alias("d")).alias(f"__{i}") for i, c in enumerate(df.columns)])
    return total.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{i}.v").alias("values"), F.col(f"__{i}.d").alias("distinct")) for i, c in enumerate(df.columns)])).alias("x")).select("x.column", "x.values", "x.distinct", (1 - F.col("x.values") / F.col("n")).alias("missing"))


def with_skip_reason(docs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """docs with the first rule (reason, SQL condition) that leaves a row out, or null."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        reason = F.when(F.expr(condition), name).otherwise(reason)
    return docs.withColumn("skip_reason", reason)


def invalid_rows(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """df with the list of problems of each row (message, SQL condition of the problem); empty is valid."""
    return df.withColumn("problems", F.array_compact(F.array(*[F.when(F.expr(c), F.lit(m)) for m, c in rules])))


def write_if_valid(df: DataFrame, rules: list[tuple[str, str]], path: str) -> DataFrame:
    """Write df if no row has a problem; returns the rows with problems."""
    bad = invalid_rows(df, rules).where(F.size("problems") > 0)
    if not bad.head(1):
        write_parquet(df, path)
    return bad
