"""Bit maps of fixed size over 64-bit keys: they let through every key that was put in, and few others.

They only save work before an exact join: where a corpus has more keys than places, more pass, and results
are the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

MAP_BITS = 25  # 4 MB


def bit_table(keys: DataFrame, size: int = MAP_BITS) -> DataFrame:
    """The map of column key, by its high bits, as rows (word, bits): at most 2 ** (size - 6) of them."""
    return keys.groupBy(F.expr(f"shiftrightunsigned(key, {70 - size})").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(key, {64 - size}) & 63 as int)))").alias("bits"))


def let_through(rows: DataFrame, key: str, keys: DataFrame, size: int = MAP_BITS - 3) -> DataFrame:
    """The rows whose key (an SQL expression of a long) may be among the keys, by a broadcast of the map's rows."""
    found = rows.withColumn("word", F.expr(f"shiftrightunsigned({key}, {70 - size})")).join(F.broadcast(bit_table(keys, size)), "word")
    return found.where(f"shiftright(bits, cast(shiftrightunsigned({key}, {64 - size}) & 63 as int)) & 1 = 1").drop("word", "bits")


def packed(keys: DataFrame, size: int = MAP_BITS) -> np.ndarray:
    """The map of column key for tasks in Python: brings at most 2 ** (size - 6) rows of 16 bytes to the driver."""
    words, rows = np.zeros(1 << (size - 6), dtype=np.int64), bit_table(keys, size).toArrow()
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words


def held(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Marks of the keys (unsigned 64-bit) that may be in the map."""
    place = keys >> np.uint64(64 - (len(words).bit_length() + 5))
    return (words[(place >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1) == 1
