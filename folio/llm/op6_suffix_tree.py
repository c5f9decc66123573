"""Language-model scores by a probabilistic suffix tree over words, grown from the whole corpus.

A text is its lower-cased words and one end, after a start. A context is the one, two ... DEPTH words before
a word (the start may be the first). All runs of words that stand in MIN_COUNT places of the training
documents are nodes, an absolute count, so the tree grows with the corpus: nothing is kept or left out by rank.

Growing the tree. Level by level, a run of d words can be that frequent only if the d - 1 words it begins and
ends with are; such runs are counted. A context's distribution holds the frequent words after it, each by its
count less DISCOUNT, and gives what is left over to the next shorter context's distribution, down to single
words by their counts plus one. A context is retained, with its suffixes, if its distribution diverges from
the shorter one's by more than it costs: the sum of count * log ratio, over half a log of its count for each
word it holds. A word's probability is that of the longest retained context.

Tables. Documents are cut into blocks of bounded token counts. A task sends the distinct runs of its blocks, not
their tokens, dealt out by the high bits of their contexts' hashes, to be counted: as places in the ascending words that
occur in them, each context once, with the steps from run to run. At the end a block asks for the values of those of its
runs that the tree may hold, dealt out by their hashes. Arrays are compressed before they are shuffled. Levels, tests and probabilities are tables of frequent runs, joined by
shuffling. Which runs may be frequent, or in the tree, is told to blocks by bit maps of fixed size, which let none be missed.
Nothing that grows with the corpus reaches the driver or is broadcast. Words and runs go by 64-bit hashes.

Null, empty and word-less texts are the end alone; one very long text is a block of its own. Rows that repeat
are each scored and each learnt from; null doc_ids are training rows. Without training documents every word
is unknown. An empty table gives an empty one. Ties don't arise. Only doc_id and text are read, so other
columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .bits import held as in_map, packed
from .store import Scratch

MIN_COUNT, DEPTH, DISCOUNT = 32, 3, 0.75
BLOCK_TOKENS, PART_TOKENS = 1_000_000, 1 << 22
PARTS, COMBINED = 128, 4_000_000
END, START = b"\n", b"\n\n"  # no word holds them
GOLD = np.uint64(0x9E3779B97F4A7C15)
CODEC = pa.Codec("zstd", compression_level=1)
BLOCKS = "block long, tokens long, doc_ids array<long>, held binary, sizes binary, places binary, words binary, counts binary"


def planes(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers with equal bytes side by side, compressed, after their size."""
    found = np.ascontiguousarray(numbers.astype(kind))
    data = found.view("u1").reshape(-1, found.itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + CODEC.compress(data, asbytes=True)


def from_planes(data: bytes, kind: str = "<u4") -> np.ndarray:
    data = CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, dtype="u1").reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def ascending(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)), "<u8")


def from_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8"), dtype=np.uint64)


def some(values: np.ndarray, there: np.ndarray, kind: str) -> bytes:
    """The values that are there, after marks of them."""
    marks = planes(np.packbits(there), "u1")
    return len(values).to_bytes(8, "little") + len(marks).to_bytes(8, "little") + marks + planes(values[there], kind)


def from_some(data: bytes, kind: str, default: float) -> np.ndarray:
    size, marks = (int.from_bytes(data[k : k + 8], "little") for k in (0, 8))
    out = np.full(size, default, dtype=kind)
    out[np.unpackbits(from_planes(data[16 : 16 + marks], "u1"), count=size).astype(bool)] = from_planes(data[16 + marks :], kind)
    return out


def run_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of runs, from those of their first words, second words ..."""
    found = words[0]
    for more in words[1:]:
        found = W.mix(found * GOLD + more)
    return found


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where in it each distinct one begins."""
    order = np.argsort(keys)
    ascending = keys[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), ascending[1:] != ascending[:-1]]))


def block_table(docs: DataFrame, modulus: int = 7, rest: int = 2) -> DataFrame:
    """One row per block: its documents, their sizes, their tokens (each document's after its start), the block's
    ascending distinct words, and how often each of those occurs in its training documents; tokens are places in
    the words by falling count, so that most are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, marks, tokens, total = [], [], [], 0
        edge = W.hash_words([START, END])

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in tokens], dtype=np.int64)
            words, places = np.unique(np.concatenate(tokens), return_inverse=True)
            counts = np.bincount(places[np.repeat(~np.array(marks), sizes)], minlength=len(words))
            rank = np.empty(len(words), dtype=np.int64)
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
            row = [[part << 32 | number], [int(sizes.sum())], [ids], [np.array(marks, dtype="u1").tobytes()], [planes(sizes)], [planes(rank[places])], [ascending(words)], [planes(counts)]]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch, texts in W.chunks(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids.append(doc_id)
                marks.append(doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == rest)
                tokens.append(np.concatenate([edge[:1], W.text_hashes(text.lower()), edge[1:]]) if text else edge)
                total += len(tokens[-1])
                if total >= BLOCK_TOKENS:
                    yield flush()
                    number += 1
                    ids, marks, tokens, total = [], [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, BLOCKS)


class Block:
    """A block's tokens and the runs that end at each of them."""

    def __init__(self, batch: pa.RecordBatch, i: int, maps: list[np.ndarray]):
        get = lambda name: batch.column(batch.schema.get_field_index(name))[i]
        self.id, self.doc_ids = get("block").as_py(), get("doc_ids").as_py()
        self.marks = np.frombuffer(get("held").as_py(), dtype="u1").astype(bool)
        self.sizes = from_planes(get("sizes").as_py()).astype(np.int64)
        self.words = from_ascending(get("words").as_py())
        self.counts = from_planes(get("counts").as_py()).astype(np.int64)
        self.places = np.argsort(-self.counts, kind="stable").astype(np.uint32)[from_planes(get("places").as_py())]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.maps = maps

    def levels(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each of n lengths from one word on: hashes of the runs of that length that end at each token, and
        marks of those that may be frequent and of those all of whose shorter runs may be."""
        run = self.words[self.places]
        ok = np.ones(len(run), dtype=bool)
        for depth in range(n):
            if depth:
                longer = np.zeros_like(run)
                longer[1:] = W.mix(run[:-1] * GOLD + self.words[self.places[1:]])
                whole = np.ones(len(run), dtype=bool)
                for j in range(depth):
                    whole[np.minimum(self.starts + j, len(run) - 1)] = False
                both = np.zeros_like(ok)
                both[1:] = ok[:-1] & ok[1:]
                run, ok = longer, both & whole
            possible = ok.copy()
            if depth < len(self.maps):
                at = np.flatnonzero(ok)
                ok[at] = in_map(self.maps[depth], run[at])
            yield run, ok, possible


def by_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the ascending keys of each part begin, with the end."""
    first = (np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - (parts.bit_length() - 1))) if parts > 1 else np.empty(0, dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, first), [len(keys)]])


def _grouped(rows: DataFrame, fold: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, order: list[str] | None = None) -> DataFrame:
    """fold over all rows of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and held[-1].column(0)[0].as_py() != int(part[a]):
                    yield from fold(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from fold(held)

    return rows.repartition("part").sortWithinPartitions("part", *(order or [])).mapInArrow(run, schema)


def _binaries(batches: list[pa.RecordBatch], column: int) -> list[bytes]:
    return [x for b in batches for x in b.column(column).to_pylist() if x is not None]


def word_table(blocks: DataFrame, parts: int) -> DataFrame:
    """Rows (part, words, counts): all training words with their counts, by part."""

    def summed(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, place = np.unique(np.concatenate(words), return_inverse=True)
        return found, np.bincount(place, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)

    def sent(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Words of several blocks of a task, each once, by part."""
        words, counts = summed(*zip(*found, strict=True))
        cuts = by_part(words, parts).tolist()
        rows = [(p, ascending(words[a:b]), planes(counts[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=["part", "words", "counts"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                words, counts = from_ascending(batch.column(0)[i].as_py()), from_planes(batch.column(1)[i].as_py())
                found.append((words[counts > 0], counts[counts > 0]))
                held += len(found[-1][0])
                if held >= COMBINED:
                    yield sent(found)
                    found, held = [], 0
        if found:
            yield sent(found)

    def fold(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = summed([from_ascending(x) for x in _binaries(rows, 1)], [from_planes(x) for x in _binaries(rows, 2)])
        yield pa.RecordBatch.from_arrays([rows[0].column(0).slice(0, 1), pa.array([words.tobytes()], pa.binary()), pa.array([planes(counts, "<i8")], pa.binary())], names=["part", "words", "counts"])

    return _grouped(blocks.select("words", "counts").mapInArrow(send, "part int, words binary, counts binary"), fold, "part int, words binary, counts binary")


def frequent_words(words: DataFrame, least: int) -> DataFrame:
    """Rows (run, n) of the words (and the start) in at least so many places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = from_planes(counts, "<i8")
                often = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, dtype=np.int64)[often]), pa.array(n[often])], names=["run", "n"])

    return words.mapInArrow(run, "run long, n long")


def longer_runs(blocks: DataFrame, maps: list[np.ndarray], parts: int, least: int) -> DataFrame:
    """Rows (run, context, shorter, suffix, n) of the runs one word longer than the maps go that stand in
    at least so many training places: the words before the last, the run and its context without their first words."""
    shared = blocks.sparkSession.sparkContext.broadcast(maps)
    names = ["part", "words", "contexts", "steps", "counts"]
    schema = "part int, " + ", ".join(f"{n} binary" for n in names[1:])

    def packed_runs(context: np.ndarray, words: list[np.ndarray], counts: np.ndarray) -> tuple[bytes, ...]:
        """Runs by ascending contexts: their distinct words, the contexts as places in them, the steps between the
        runs' places in a grid of contexts and last words, and the counts."""
        known, places = np.unique(np.concatenate(words), return_inverse=True)
        places = places.reshape(len(words), -1)
        first = np.concatenate([[True], context[1:] != context[:-1]])
        spot = (np.cumsum(first) - 1) * len(known) + places[-1]
        order = np.argsort(spot)
        return ascending(known), planes(places[:-1, first].reshape(-1)), planes(np.diff(spot[order], prepend=0)), planes(counts[order])

    def unpacked_runs(words: bytes, contexts: bytes, steps: bytes, counts: bytes) -> tuple[np.ndarray, ...]:
        """Context, suffix, last word and count of each run."""
        known = from_ascending(words)
        of = list(known[from_planes(contexts)].reshape(len(maps), -1))
        number, last = np.divmod(np.cumsum(from_planes(steps), dtype=np.int64), len(known))
        suffix = run_hash(of[1:])[number] if len(maps) > 1 else np.zeros(len(number), dtype=np.uint64)
        return run_hash(of)[number], suffix, known[last], from_planes(counts)

    def sent(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """Runs of several blocks of a task, each once, by part of their contexts."""
        *words, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        order, starts = distinct(run_hash(words))
        counts = np.add.reduceat(counts[order], starts) if len(order) else counts
        at = order[starts]
        context = run_hash(words[:-1])[at]
        order = np.argsort(context)
        at, context, counts = at[order], context[order], counts[order]
        words = [w[at] for w in words]
        edges = by_part(context, parts).tolist()
        rows = [(p, *packed_runs(context[a:b], [w[a:b] for w in words], counts[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], names=names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i, shared.value)
                for run, _, possible in block.levels(len(block.maps) + 1):
                    pass
                at = np.flatnonzero(possible & ~np.repeat(block.marks, block.sizes))
                order, starts = distinct(run[at])
                counts, at = np.diff(starts, append=len(order)), at[order[starts]]
                found.append((*(block.words[block.places[at - j]] for j in range(len(block.maps), -1, -1)), counts))
                held += len(at)
                if held >= COMBINED:
                    yield sent(found)
                    found, held = [], 0
        if found:
            yield sent(found)
        W.trim()

    def fold(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpacked_runs(*row) for b in rows for row in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)]
        context, suffix, word, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        run = W.mix(context * GOLD + word)
        order, starts = distinct(run)
        n = np.add.reduceat(counts[order].astype(np.int64), starts)
        often = n >= least
        at, n = order[starts[often]], n[often]
        run, context, suffix, word = (x[at] for x in (run, context, suffix, word))
        shorter = W.mix(suffix * GOLD + word) if len(maps) > 1 else word
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (run, context, shorter, suffix)] + [pa.array(n)], names=["run", "context", "shorter", "suffix", "n"])

    return _grouped(blocks.select("block", "doc_ids", "held", "sizes", "places", "words", "counts").mapInArrow(send, schema), fold, "run long, context long, shorter long, suffix long, n long")


def level_table(runs: DataFrame, shorter: DataFrame) -> DataFrame:
    """runs with p, the probability of their last word after their context, and the context's rest (what it leaves to
    the shorter one) and worth (by how much its distribution's divergence exceeds its cost).

    shorter: (run, n, p) of the level before."""
    of = runs.join(shorter.select(F.col("run").alias("context"), F.col("n").alias("total")), "context")
    of = of.join(shorter.select(F.col("run").alias("shorter"), F.col("p").alias("p_shorter")), "shorter")
    rest = of.groupBy("context").agg((1 - F.sum(F.col("n") - DISCOUNT) / F.max("total")).alias("rest"))
    of = of.join(rest, "context").withColumn("p", (F.col("n") - DISCOUNT) / F.col("total") + F.col("rest") * F.col("p_shorter"))
    told = F.sum(F.col("n") * F.log(F.col("p") / F.col("p_shorter"))) + (F.max("total") - F.sum("n")) * F.log(F.max("rest"))
    worth = of.groupBy("context").agg((told - 0.5 * F.count("*") * F.log(F.max("total") + 1.0)).alias("worth"))
    return of.join(worth, "context").select("run", "context", "suffix", "n", "p", "rest", "worth")


def tree_table(blocks: DataFrame, words: DataFrame, total: int, distinct: int, parts: int, scratch: Scratch, min_count: int = MIN_COUNT, depth: int = DEPTH) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (run, event, rest): the log10 probability of a run's last word after a retained context, and what a
    retained context leaves to its suffix; and the maps of the frequent runs of each length, with that of the tree."""
    first = scratch.save(frequent_words(words, min_count).withColumn("p", (F.col("n") + 1) / F.lit(float(total + distinct + 1))), "level-1")
    maps, levels = [packed(first.select(F.col("run").alias("key")))], []
    before = first
    for k in range(2, depth + 2):
        runs = scratch.save(longer_runs(blocks, maps, parts, min_count), f"runs-{k}")
        level = scratch.save(level_table(runs, before.select("run", "n", "p")), f"level-{k}")
        scratch.drop(f"runs-{k}")
        if not level.head(1):
            break
        levels.append(level)
        maps.append(packed(level.select(F.col("run").alias("key"))))
        before = level
    values, kept = [], None
    for level in reversed(levels):
        contexts = level.where("worth > 0").select("context").distinct()
        if kept is not None:
            contexts = contexts.unionByName(kept).distinct()
        own = level.join(contexts, "context")
        values.append(own.select("run", F.log10("p").alias("event"), F.lit(None).cast("double").alias("rest")))
        values.append(own.groupBy("context").agg(F.log10(F.max("rest")).alias("rest")).select(F.col("context").alias("run"), F.lit(None).cast("double").alias("event"), "rest"))
        kept = own.select(F.col("suffix").alias("context")).distinct()
    found = values[0] if values else first.select("run", F.lit(None).cast("double").alias("event"), F.lit(None).cast("double").alias("rest")).where("false")
    for more in values[1:]:
        found = found.unionByName(more)
    tree = scratch.save(found.groupBy("run").agg(F.max("event").alias("event"), F.max("rest").alias("rest")), "tree")
    scratch.drop("level-1", *(f"level-{k}" for k in range(2, depth + 2)))
    return tree, [*maps, packed(tree.select(F.col("run").alias("key")))]


def _asked(block: Block) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct hashes a block asks about (all words, longer runs that the tree may hold), ascending; and the
    longer runs' hashes at each token, 0 where the tree holds none. The last map is the tree's."""
    *block.maps, tree = block.maps
    runs = []
    for k, (run, ok, _) in enumerate(block.levels(len(block.maps))):
        if k:
            at = np.flatnonzero(ok)
            at = at[in_map(tree, run[at])]
            runs.append(np.zeros_like(run))
            runs[-1][at] = run[at]
    return np.unique(np.concatenate([block.words, *(np.unique(r) for r in runs)])), runs


def answers(blocks: DataFrame, words: DataFrame, tree: DataFrame, maps: list[np.ndarray], parts: int) -> DataFrame:
    """Rows (block, part, counts, events, rests): the values of what a block asks about, in ascending order."""
    shared = blocks.sparkSession.sparkContext.broadcast(maps)
    schema = "part int, block long, words binary, counts binary, run long, event double, rest double"
    names = [x.split()[0] for x in schema.split(", ")]
    high = 64 - (parts.bit_length() - 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i, shared.value)
                keys, _ = _asked(block)
                cuts = by_part(keys, parts).tolist()
                rows = [(p, ascending(keys[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([block.id] * n, pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                    pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()),
                ], names=names)
        W.trim()

    def fold(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        known = table.filter(pc.is_valid(table.column("run")))
        runs = known.column("run").to_numpy().view(np.uint64)
        order = np.argsort(runs)
        runs, event, rest = runs[order], known.column("event").to_numpy()[order], known.column("rest").to_numpy()[order]
        all_words, all_counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        for keys, counts in zip(_binaries(rows, 2), [x for b in rows for x, k in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True) if k is not None], strict=True):
            if counts is not None:
                all_words, all_counts = np.frombuffer(keys, dtype=np.uint64), from_planes(counts, "<i8")
        for b in rows:
            for block, keys in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if block is None:
                    continue
                keys = from_ascending(keys)
                found = [(*_look_up(keys, all_words, [all_counts], 0), 0, "<i8"), *((x, np.nan, "<f4") for x in _look_up(keys, runs, [event, rest], np.nan))]
                sent = [some(x, ~np.isnan(x) if np.isnan(none) else x != none, kind) for x, none, kind in found]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), b.column(0).slice(0, 1), *(pa.array([x], pa.binary()) for x in sent)], names=["block", "part", "counts", "events", "rests"])

    asked = blocks.mapInArrow(ask, schema)
    null = lambda kind: F.lit(None).cast(kind)
    given = words.select("part", null("long").alias("block"), "words", "counts", null("long").alias("run"), null("double").alias("event"), null("double").alias("rest"))
    values = tree.select(F.expr(f"cast(shiftrightunsigned(run, {high}) as int)" if parts > 1 else "0").alias("part"), null("long").alias("block"), null("binary").alias("words"), null("binary").alias("counts"), "run", "event", "rest")
    return _grouped(asked.unionByName(given).unionByName(values), fold, "block long, part int, counts binary, events binary, rests binary")


def _look_up(keys: np.ndarray, known: np.ndarray, columns: list[np.ndarray], default: float) -> list[np.ndarray]:
    """Of each column of the known keys' values those of keys."""
    out = [np.full(len(keys), default, dtype=x.dtype) for x in columns]
    if len(known):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        for found, values in zip(out, columns, strict=True):
            found[hit] = values[at[hit]]
    return out


def score_documents(docs: DataFrame, scratch: Scratch | None = None, modulus: int = 7, rest: int = 2, min_count: int = MIN_COUNT, depth: int = DEPTH) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix-tree")
    blocks = scratch.save(block_table(docs, modulus, rest), "blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    parts = PARTS
    while parts * PART_TOKENS < tokens:  # as many more as there are tokens, so that a part's tables stay as large
        parts *= 2
    words = scratch.save(word_table(blocks, parts), "words")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = W.hash_words([START])
        for batch in batches:
            for keys, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                real = np.frombuffer(keys, dtype=np.uint64) != start
                n = from_planes(counts, "<i8")[real]
                yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())], pa.int64()), pa.array([len(n)], pa.int64())], names=["c", "v"])

    total, distinct = words.mapInArrow(totals, "c long, v long").agg(F.sum("c"), F.sum("v")).first()
    total, distinct = total or 0, distinct or 0
    tree, maps = tree_table(blocks, words, total, distinct, parts, scratch, min_count, depth)
    replies = answers(blocks, words, tree, maps, parts)
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("part", "counts", "events", "rests")).alias("replies"))  # as much as the block's distinct runs
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    floor = np.log10(float(total + distinct + 1))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i, shared.value)
                keys, runs = _asked(block)
                found = sorted(batch.column(7)[i].as_py(), key=lambda r: r["part"])
                counts, events, rests = (np.concatenate([from_some(r[k], t, none) for r in found]) for k, t, none in (("counts", "<i8", 0), ("events", "<f4", np.nan), ("rests", "<f4", np.nan)))
                place = np.searchsorted(keys, block.words)
                c = counts[place][block.places]
                base = np.log10(c + 1.0) - floor
                log_p, context = base.copy(), rests[place][block.places]
                for run in runs:  # from the shortest context to the longest
                    there = np.flatnonzero(run)
                    at = np.searchsorted(keys, run[there])
                    event, left = np.full(len(run), np.nan), np.concatenate([[np.nan], context[:-1]])
                    event[there] = events[at]
                    log_p = np.where(np.isnan(event), np.where(np.isnan(left), log_p, left + log_p), event)
                    context = np.full(len(run), np.nan)
                    context[there] = rests[at]
                real = np.ones(len(c), dtype=bool)
                real[block.starts] = False
                sums = lambda x: np.add.reduceat(np.where(real, x, 0), block.starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.doc_ids, pa.int64()), pa.array(block.marks), pa.array(block.sizes - 1), pa.array(sums((c > 0).astype(np.int64))),
                    pa.array(np.full(len(block.sizes), total, dtype=np.int64)), pa.array(sums(base)), pa.array(sums(log_p)),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    joined = blocks.join(replies, "block").select("block", "doc_ids", "held", "sizes", "places", "words", "counts", "replies")
    return joined.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: per document its score under the suffix tree and under single words, learnt from the training documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, Scratch(spark, "op6"))
