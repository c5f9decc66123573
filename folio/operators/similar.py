"""Similarity by vectors and by shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .prefix import running

BLOCK_ROWS = 4096
KEY_ROWS = 1_000_000


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length one; zero vectors stay zero."""
    n = norm(v)
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def _blocks(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """Queries in blocks of BLOCK_ROWS rows, each block against every bank row, as one row per block and bank
    batch: queries are a stated set, so this is no join of all pairs of a table with itself."""
    n = max(1, -(-queries.count() // BLOCK_ROWS))
    return queries.withColumn("block", F.pmod(F.xxhash64("q_id"), F.lit(n)))


def scored_best(queries: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """For each query (q_id, q_key, q_vec) the best similarity to each other key of the bank (key, vec) and its
    row, k best keys at most, with the number of keys at or above any tau kept as an array of similarities.

    Query blocks are small tables by construction (BLOCK_ROWS vectors) and go to every task of the bank's
    scan in turn; each task keeps one best row per query and key, which then meet by an aggregate.
    """
    spark = bank.sparkSession
    out = None
    for block in sorted(r["block"] for r in _blocks(queries, bank).select("block").distinct().collect()):
        rows = _blocks(queries, bank).where(F.col("block") == block).select("q_id", "q_key", "q_vec").toPandas()
        ids, own = rows["q_id"].to_numpy(), rows["q_key"].to_numpy()
        q = np.stack([np.asarray(v, dtype=np.float64) for v in rows["q_vec"]])
        length = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, own, q / np.where(length == 0, 1, length)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, own, q = shared.value
            for b in batches:
                v = np.stack([np.asarray(x, dtype=np.float64) for x in b["vec"]])
                n = np.linalg.norm(v, axis=1, keepdims=True)
                s = q @ (v / np.where(n == 0, 1, n)).T
                keys, place = np.unique(b["key"].to_numpy(), return_inverse=True)
                row = b["id"].to_numpy()
                for j, key in enumerate(keys):
                    cols = np.flatnonzero(place == j)
                    best = cols[s[:, cols].argmax(axis=1)]
                    use = own != key
                    yield pd.DataFrame({"q_id": ids[use], "key": key, "sim": s[np.arange(len(q)), best][use], "id": row[best][use]})

        part = bank.select("id", "key", "vec").mapInPandas(run, "q_id long, key int, sim double, id long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("q_id", "key").agg(F.max("sim").alias("sim"), F.max_by("id", F.struct("sim", -F.col("id"))).alias("id"))


def novelty(queries: DataFrame, bank: DataFrame, tau: float, nearest: int = 3) -> DataFrame:
    """Per query: the share of other keys with a row at cosine tau or more (null without other keys), and the
    nearest rows of distinct keys."""
    best = scored_best(queries, bank, nearest)
    w = Window.partitionBy("q_id").orderBy(F.desc("sim"), "key")
    ranked = best.withColumn("n", F.row_number().over(w))
    return ranked.groupBy("q_id").agg(
        F.avg((F.col("sim") >= tau).cast("int")).alias("novelty"),
        F.array_sort(F.collect_list(F.when(F.col("n") <= nearest, F.struct("n", "key", "id", F.round("sim", 4).alias("sim"))))).alias("nearest"),
    )


def badge(novelty_: Column, unusual_below: float = 0.10, common_above: float = 0.60) -> Column:
    return F.when(novelty_.isNull() | F.isnan(novelty_), None).when(novelty_ < unusual_below, "unusual").when(novelty_ > common_above, "common").otherwise("neutral")


def choose_tau(rated: DataFrame, similarity: str, same: str, precision: float = 0.9, least: int = 10) -> DataFrame:
    """One row: the lowest similarity at or above which rated pairs are the same often enough."""
    at = rated.groupBy(F.col(similarity).alias("t")).agg(F.count("*").alias("n"), F.sum(F.col(same).cast("int")).alias("s"))
    run = running(at.withColumnsRenamed({"n": "n_at", "s": "s_at"}), [F.desc("t")], {"n": F.col("n_at"), "s": F.col("s_at")})
    return run.where((F.col("n") >= least) & (F.col("s") / F.col("n") >= precision)).agg(F.min("t").alias("tau"))


def shingles(words: Column, k: int = 8) -> Column:
    """Distinct k-word shingles of an array of words; none if there are fewer."""
    n = F.size(words) - k + 1
    at = F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, k), " ")))


def shingle_keys(words: Column, k: int = 8) -> Column:
    """64-bit hashes of the k-word shingles, without making their texts."""
    n = F.size(words) - k + 1
    at = F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))


def copied_share(answers: DataFrame, passages: DataFrame, key: str, words: str, k: int = 8) -> DataFrame:
    """Per answer and passage with a common shingle: the share of the answer's shingles that the passage has.

    Passages with a shingle of any answer are found by hashes; only their shingles are compared as texts, by an
    equality join. The answers' hashes are broadcast up to KEY_ROWS of them, 8 bytes each, and shuffled beyond."""
    mine = answers.select(key, F.explode(shingles(F.col(words), k)).alias("s"))
    total = answers.select(key, F.size(shingles(F.col(words), k)).alias("n"))
    keys = answers.select(F.explode(shingle_keys(F.col(words), k)).alias("h")).distinct()
    if keys.count() <= KEY_ROWS:
        keys = F.broadcast(keys)
    alike = passages.select("passage_id", F.explode(shingle_keys(F.col(words), k)).alias("h")).join(keys, "h", "left_semi").select("passage_id").distinct()
    theirs = passages.join(alike, "passage_id", "left_semi").select("passage_id", F.explode(shingles(F.col(words), k)).alias("s"))
    common = mine.join(theirs, "s").groupBy(key, "passage_id").agg(F.count("*").alias("common"))
    return common.join(total, key).withColumn("share", F.col("common") / F.col("n"))
