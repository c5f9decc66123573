"""Connected components of a distributed edge table, by alternating large-star and small-star steps.

Only counts reach the driver. Each step is two joins on aggregated minima, so a node with a third of
all edges is a skewed join key, which adaptive execution splits, and never a collected list. Edges are
written to the shared folder after each pair of steps.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from .store import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (node, component) for every node of the edges (u, v); component is the least node reachable.

    Null ends and loops are ignored; no edges give no rows. Nodes may be of any ordered type.
    """
    current = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = scratch.save(current, f"{name}-0")
    before = None
    for step in count(1):  # until nothing changes: a few steps more than the logarithm of the longest path
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        current = scratch.save(_small_star(_large_star(current)).distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
