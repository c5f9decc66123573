"""How filters interact: what each of five filters removes, alone and in every order of the five.

One pass scans the Arrow buffers of the texts as they lie in memory: byte classes by table look-up, word starts and ends
by comparing neighbours, and prefix sums over the bytes, read at the documents' borders, count words, code points,
capitals and symbols of all documents of a slice at once. Each word has a hash from one prefix sum over the slice's
bytes; a document's hashes are sorted, words with equal hashes are compared byte by byte, and a document with a true
collision is counted by a set. No text is made into a Python object.

A row leaves the pass as its filters' mask, its group and its text's digest. Copies of a text are found by aggregation
alone: rows of one digest are summed for each group and class of labels, with their smallest id, before the smallest id of
the digest is taken, so a text with any number of copies is a few rows a task. What is counted in the end is 32 masks a
group and class of labels, and matrix products turn them into all orders and steps.

Filters are A few_words, B few_distinct, C many_capitals, D symbols, E copy; a mask has bit k if filter k fails. Null texts
are empty ones. A null id is no smaller than any and no larger, so such a row is no copy and makes none; rows that repeat
an id and a text are no copies of each other. Ids without labels, and null labels, are neither good nor toxic; of repeated
labels one suffices. Texts of any length are scanned in segments. An empty table gives no rows. Only the columns named are
read, so others never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words as W

FILTERS = "ABCDE"
SLICE_BYTES = 1 << 20
_SPACE, _CAPITAL, _SYMBOL, _FIRST = (np.zeros(256, dtype=bool) for _ in range(4))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CAPITAL[65:91] = True
_SYMBOL[list(b"#$%&*|")] = True
_FIRST[:] = True
_FIRST[0x80:0xC0] = False  # bytes that continue a code point


def _sums(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive cuts."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[cuts])


def _borders(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; a cut ends a word as a space does."""
    space = _SPACE[data]
    apart = np.zeros(len(data) + 1, dtype=bool)
    apart[cuts] = True
    before, after = apart[:-1].copy(), apart[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    return np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, mixed with its length."""
    up, down = W._powers(len(data))
    sums = np.concatenate([np.zeros(1, dtype=W.U64), np.cumsum((data + W.U64(1)) * up[: len(data)])])
    return W.mix((sums[ends] - sums[starts]) * down[starts] ^ W.mix((ends - starts).astype(W.U64)))


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the words at a and at b, of equal lengths, have the same bytes."""
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    differ = data[np.repeat(a, lengths) + within] != data[np.repeat(b, lengths) + within]
    return _sums(differ, np.concatenate([[0], ends])) == 0


def _distinct(data: np.ndarray, cuts: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Distinct words of each document between the cuts."""
    docs = np.searchsorted(cuts, starts, side="right") - 1
    order = np.lexsort((hashes, docs))
    same = (np.diff(docs[order]) == 0) & (hashes[order][1:] == hashes[order][:-1])
    left, right = order[:-1][same], order[1:][same]
    lengths, wrong = ends - starts, np.zeros(len(left), dtype=bool)
    for at in range(0, len(left), 1 << 16):
        one, two = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
        fits = lengths[one] == lengths[two]
        fits[fits] = _equal_bytes(data, starts[one[fits]], starts[two[fits]], lengths[one[fits]])
        wrong[at : at + (1 << 16)] = ~fits
    n = len(cuts) - 1
    found = np.bincount(docs, minlength=n) - np.bincount(docs[left], minlength=n)
    for d in np.unique(docs[left[wrong]]).tolist():
        found[d] = len(set(data[cuts[d] : cuts[d + 1]].tobytes().split()))
    return found


def features(data: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
    """words, distinct, code_points, capitals and symbols of the documents data[cuts[i]:cuts[i + 1]]."""
    pieces, at = [], 0
    while at < len(data):  # a long document's hashes are made in segments that end between words
        stop = min(at + SLICE_BYTES, len(data))
        if stop < len(data):
            spaces = np.flatnonzero(_SPACE[data[at:stop]])
            if len(spaces):
                stop = at + int(spaces[-1]) + 1
            else:
                far = next((k for k in range(stop, len(data), SLICE_BYTES) if _SPACE[data[k : k + SLICE_BYTES]].any()), len(data))
                stop = min(far + int(np.argmax(_SPACE[data[far : far + SLICE_BYTES]])) + 1, len(data)) if far < len(data) else len(data)
        segment, inner = data[at:stop], np.unique(np.clip(cuts, at, stop) - at)
        starts, ends = _borders(segment, inner)
        pieces.append((starts + at, ends + at, _hashes(segment, starts, ends)))
        at = stop
    starts, ends, hashes = (np.concatenate(x) for x in zip(*pieces, strict=True)) if pieces else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=W.U64))
    return {
        "words": np.diff(np.searchsorted(starts, cuts)),
        "distinct": _distinct(data, cuts, starts, ends, hashes),
        "code_points": _sums(_FIRST[data], cuts),
        "capitals": _sums(_CAPITAL[data], cuts),
        "symbols": _sums(_SYMBOL[data], cuts),
    }


def mask(f: dict[str, np.ndarray]) -> np.ndarray:
    """Filters A to D as bits 0 to 3."""
    fails = (f["words"] < 50, 100 * f["distinct"] < 65 * f["words"], 100 * f["capitals"] > 5 * f["code_points"], f["symbols"] > 0)
    return sum(x.astype(np.int32) << k for k, x in enumerate(fails))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column, as they lie in its buffers; nulls have no bytes."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset) if texts.buffers()[1] else np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def masks(docs: DataFrame, text: str = "text", ident: str = "doc_id", part: str = "source") -> DataFrame:
    """Per row: id, part, digest (of the text), mask (filters A to D)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            for start, stop in W.cuts(W.byte_sizes(column), SLICE_BYTES):
                data, cuts = _buffers(column.slice(start, stop - start).fill_null(""))
                yield pa.RecordBatch.from_arrays([*[c.slice(start, stop - start) for c in batch.columns[:3]], pa.array(mask(features(data, cuts)), pa.int32())], names=["id", "part", "digest", "mask"])

    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{ident}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), whole.alias("text"))
    return rows.mapInArrow(scan, "id long, part string, digest binary, mask int")


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part, mask (all five filters), good and toxic: n."""
    told = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("id is not null")
    keys = ["digest", "part", "mask", "good", "toxic"]
    rows = masks(docs).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = rows.join(told, "id", "left").fillna(False, ["good", "toxic"])
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    alike = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), first.alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    passing = F.col("n_null") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    both = alike.withColumn("passing", passing).select(
        "part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("passing").alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("c")
    )
    return both.groupBy("part", "good", "toxic", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n")).where("n > 0")


def _orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders, and per order and step the filter's bit and the bits before it."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bits = np.array([[1 << FILTERS.index(c) for c in o] for o in orders])
    return orders, bits, np.cumsum(bits, axis=1) - bits


def _reduced(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts as arrays of 32 masks (all, good, toxic) into rows by order and step."""
    orders, bits, before = _orders()
    at = np.arange(32)
    bit, earlier = bits.reshape(-1, 1), before.reshape(-1, 1)
    fails, gone = (at & bit) > 0, (at & earlier) > 0
    here = (fails & ~gone).astype(np.int64)
    sizes = np.array([max(1, int(m).bit_count()) for m in at])
    share = fails * (len(orders) // sizes)  # of so many orders, a failing filter is first among those that fail
    steps = {"kept": ~fails & ~gone, "removed": here, "redundant": fails & gone, "unique_fails": at == bit, "shapley": share}
    for batch in rows:
        for part, *counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            n, good, toxic = (np.array(c, dtype=np.int64) for c in counts)
            found = {name: m.astype(np.int64) @ n for name, m in steps.items()} | {"good_lost": here @ good, "toxic_lost": here @ toxic}
            yield pa.RecordBatch.from_pydict({"part": [part] * here.shape[0], "filter_order": [o for o in orders for _ in FILTERS], "step": pa.array([k + 1 for _ in orders for k in range(5)], pa.int32())} | {k: pa.array(v, pa.int64()) for k, v in found.items()})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = histogram(docs, labels)
    at = lambda when: F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == k) & when, F.col("n"))), F.lit(0)).cast("long") for k in range(32)])
    by_part = counts.groupBy("part").agg(at(F.lit(True)).alias("n"), at(F.col("good")).alias("good"), at(F.col("toxic")).alias("toxic"))
    return by_part.mapInArrow(_reduced, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, shapley long, good_lost long, toxic_lost long")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: how the five filters interact on documents, by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


SQL = r"""
WITH plain AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM plain GROUP BY text),
labelled AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT p.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    (len(words) < 50)::INT AS A, (100 * len(list_distinct(words)) < 65 * len(words))::INT AS B,
    (100 * len(regexp_replace(p.text, '[^A-Z]', '', 'g')) > 5 * length(p.text))::INT AS C,
    regexp_matches(p.text, '[#$%&*|]')::INT AS D, coalesce(p.doc_id > f.least, false)::INT AS E
  FROM plain p JOIN firsts f ON f.text = p.text LEFT JOIN labelled l ON l.doc_id = p.doc_id),
hist AS (SELECT part, A + 2 * B + 4 * C + 8 * D + 16 * E AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(c, bit)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, k::INT AS step, bits[k] AS bit, coalesce(list_sum(bits[1 : k - 1]), 0)::INT AS earlier FROM orders, range(1, 6) AS r(k)),
counted AS (
  SELECT part, filter_order, step, any_value(bit) AS bit,
    sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM hist, steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counted
"""
