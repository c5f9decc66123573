"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so the similarity of whole documents tells nothing. Items are
partitioned by the size of their shingle sets into classes of at most a power of two; for a class of
size c the documents are searched in blocks of 2c shingles that start every c shingles, so that an item
of the class lies whole in some block and has at least t*q/(2c + q - t*q) > 0.19 of their union in
common if it has more than half of c. The least class is 8 and begins with five shingles. With HASHES = 56
minima of one row each, an item at containment 0.8 is missed with probability under 1e-5. Minima are made
once for segments of the least class size and merged for the larger blocks. Items of up to FEW shingles must
be held whole, so they are found by their least shingle itself, and none is missed.

The items' minima are first summarised in a bit map of fixed size (2 MB), which every task tests its
blocks' minima against; only those that pass are joined with the items, by an ordinary shuffled join.
The map may pass too much when it fills up, never too little. Each candidate (document, item) is then
confirmed on the whole document: the share of the item's distinct shingles that the document holds.

Items with fewer than five words are one shingle of all their words, found as such a run in documents.
Null, empty and word-less items match nothing; null and empty documents hold nothing. Repeated item or
document rows give repeated pairs' ids once. Null doc_ids are reported as null. Empty tables give empty ones,
very long texts are searched whole, in slices of their own. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .bits import held, packed
from .store import Scratch

SHINGLE, PERCENT, HASHES, LEAST_CLASS, FEW = 5, 80, 56, 8, 4
MAP_BITS = 24
BROADCAST_ROWS = 100_000
_NO_DOC = (1 << 63) - 1
_SEEDS = W.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def size_class(n: int) -> int:
    """The least power of two, LEAST_CLASS at least, that is no smaller than n; 1 up to FEW."""
    return 1 if n <= FEW else max(LEAST_CLASS, 1 << (n - 1).bit_length())


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(len(starts), HASHES) minima of the seeded hashes over the segments that begin at starts."""
    out = np.empty((len(starts), HASHES), dtype=np.uint64)
    for k, seed in enumerate(_SEEDS):
        x = (hashes ^ seed) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def keys(mins: np.ndarray, size: int) -> np.ndarray:
    """Signed 64-bit join keys of minima: one per hash function and size class."""
    return W.mix(mins * np.uint64(0x9E3779B97F4A7C15) + (_SEEDS ^ np.uint64(size))[None]).view(np.int64)


def single_keys(grams: np.ndarray) -> np.ndarray:
    """Signed 64-bit join keys of shingles themselves."""
    return W.mix(grams ^ np.uint64(1)).view(np.int64)


def item_rows(items: DataFrame, shingle: int) -> DataFrame:
    """Per item with a word: item_id, n_words, size class, text and join keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.lower().split() if text else []
                if words:
                    grams = np.unique(W.windows(W.text_hashes(text.lower()), min(shingle, len(words))))
                    size = size_class(len(grams))
                    rows.append((item, len(words), size, text, (single_keys(grams[:1]) if size == 1 else keys(minima(grams, np.array([0])), size)[0]).tolist()))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("item_id", "n_words", "size", "item", "keys"), map(list, zip(*rows, strict=True)), strict=True)), schema=pa.schema([
                    ("item_id", pa.int64()), ("n_words", pa.int32()), ("size", pa.int32()), ("item", pa.binary()), ("keys", pa.list_(pa.int64()))]))

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id long, n_words int, size int, item binary, keys array<long>")


def block_keys(grams: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of all blocks of the documents' shingles, for items of each class, and each key's document."""
    lengths = np.array([len(g) for g in grams], dtype=np.int64)
    if not lengths.sum():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    found, owners = [], []
    if 1 in sizes:
        found.append(single_keys(np.concatenate(grams)))
        owners.append(np.repeat(np.arange(len(grams)), lengths))
        sizes = [s for s in sizes if s > 1]
        if not sizes:
            return found[0], owners[0]
    least = min(sizes)
    segments = -(-lengths // least)
    owner = np.repeat(np.arange(len(grams)), segments)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
    mins = minima(np.concatenate(grams), np.repeat(np.cumsum(lengths) - lengths, segments) + within * least)
    for size in sizes:
        starts = np.flatnonzero(within % (size // least) == 0)
        parts = np.minimum.reduceat(mins, starts, axis=0) if size > least else mins
        doc = owner[starts]
        joint = doc[:-1] == doc[1:]
        alone = ~(np.concatenate([joint, [False]]) | np.concatenate([[False], joint]))
        at = np.flatnonzero(joint)
        blocks = np.concatenate([np.minimum(parts[at], parts[at + 1]), parts[alone]])
        found.append(keys(blocks, size).reshape(-1))
        owners.append(np.repeat(np.concatenate([doc[at], doc[alone]]), HASHES))
    return np.concatenate(found), np.concatenate(owners)


def candidates(docs: DataFrame, items: DataFrame, shingle: int) -> DataFrame:
    """Distinct (doc_id, text_hash, item_id) that share a minimum. items: as item_rows gives."""
    exploded = items.select("item_id", F.explode("keys").alias("key"))
    classes = [(r["width"], r["size"]) for r in items.select(F.least("n_words", F.lit(shingle)).alias("width"), "size").distinct().collect()]
    schema = "doc_id long, text_hash long, key long"
    if not classes:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long")
    by_width: dict[int, list[int]] = {}
    for width, size in sorted(classes):
        by_width.setdefault(width, []).append(size)

    shared = docs.sparkSession.sparkContext.broadcast(packed(exploded.select("key"), MAP_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch, texts in W.chunks(batches, "text", 1_000_000):
            hashes = [W.text_hashes(t.lower() if t else b"") for t in texts]
            for width, sizes in by_width.items():
                own, owner = block_keys([W.windows(h, width) for h in hashes], sizes)
                hit = held(bits, own.view(np.uint64))
                pairs = np.unique(np.stack([owner[hit], own[hit]], axis=1), axis=0)
                if len(pairs):
                    take = pa.array(pairs[:, 0])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pairs[:, 1])], names=["doc_id", "text_hash", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema).join(exploded, "key").select("doc_id", "text_hash", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """Pairs (doc_id, text_hash, item_id, n_item, n_common): the document holds percent of the item's shingles."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "contained")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = scratch.save(item_rows(items, shingle), "items")
    found = scratch.save(candidates(docs, sized, shingle), "candidates")
    pairs = found.join(sized.select("item_id", "item"), "item_id")
    wanted = found.select("doc_id", "text_hash").distinct().withColumnsRenamed({"doc_id": "__doc", "text_hash": "__hash"})
    if found.count() <= BROADCAST_ROWS:  # 16 bytes a row; beyond it both sides are shuffled
        wanted = F.broadcast(wanted)
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    texts = keyed.join(wanted, keyed["doc_id"].eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash"))).select("doc_id", "text_hash", F.col("text").cast("binary").alias("text"))
    texts = texts.dropDuplicates(["doc_id", "text_hash"]).withColumnsRenamed({"doc_id": "__doc", "text_hash": "__hash"})
    joined = pairs.join(texts, pairs["doc_id"].eqNullSafe(texts["__doc"]) & (pairs["text_hash"] == texts["__hash"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, dict[int, np.ndarray]] = (None, {})
        for batch, texts in W.chunks(batches, "text"):
            sizes, common = [], []
            for item, text in zip(batch.column(3).to_pylist(), texts, strict=True):
                if text != last[0]:
                    last = text, {}
                words = item.lower().split()
                width = min(shingle, len(words))
                if width not in last[1]:
                    last[1][width] = np.unique(W.windows(W.text_hashes(text.lower()), width))
                grams = np.unique(W.windows(W.text_hashes(item.lower()), width))
                sizes.append(len(grams))
                common.append(len(np.intersect1d(grams, last[1][width], assume_unique=True)))
            keep = pa.array([100 * c >= percent * n for c, n in zip(common, sizes, strict=True)], pa.bool_())
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(common, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["doc_id", "text_hash", "item_id", "n_item", "n_common"])

    rows = joined.select("doc_id", "text_hash", "item_id", "item", "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, item_id long, n_item long, n_common long").dropDuplicates(["doc_id", "text_hash", "item_id"])


def decontaminate(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, text: str = "text") -> DataFrame:
    """The rows of docs that hold no item; other columns pass through, whatever their names."""
    own = docs.select(F.col("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    bad = contained(own, items, scratch=scratch).select(F.coalesce("doc_id", F.lit(_NO_DOC)).alias("doc"), F.col("doc_id").isNull().alias("none"), "text_hash").distinct()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_DOC)).alias("doc"), F.col("doc_id").isNull().alias("none"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_hash"), F.struct("*").alias("row"))
    return rows.join(bad, ["doc", "none", "text_hash"], "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the pairs of a document and a benchmark item that it holds to 80 % or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contained(docs, items, scratch=Scratch(spark, "op7"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_common").alias("n_common"))


#: The same pairs by the shingles of all items and documents.
SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT *, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, k, array_to_string(w[j : j + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS j FROM k)),
n AS (SELECT item_id, k, count(*) AS n_item FROM ig GROUP BY 1, 2),
dg AS (SELECT DISTINCT r, doc_id, k, array_to_string(w[j : j + k - 1], ' ') AS g FROM (SELECT r, doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS j FROM w, (SELECT DISTINCT k FROM k))),
c AS (SELECT r, doc_id, item_id, k, count(*) AS n_common FROM dg JOIN ig USING (k, g) GROUP BY 1, 2, 3, 4)
SELECT doc_id, item_id, max(n_item) AS n_item, max(n_common) AS n_common FROM c JOIN n USING (item_id, k) WHERE 100 * n_common >= 80 * n_item GROUP BY 1, 2
"""
