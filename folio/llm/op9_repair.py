"""Token ids in files compressed by grammar (Re-Pair), with random access.

Documents are put in ascending doc_id order by a range shuffle; each task encodes its range, appends
the end id, and cuts it into shards of about ``SHARD_IDS`` ids. In a shard, the frequent pairs of
adjacent symbols are replaced by new symbols again and again (up to PER_ROUND pairs a round, left to
right, never across documents) until no pair stands in MIN_COUNT places of the shard. A shard stores its rules, the length that each symbol expands to, the documents'
places in the symbol sequence and the sequence. The expansion lengths give any id range of any document
without decoding the rest. Shards are records of a Parquet table, so Spark's commit protocol makes
them safe against lost or repeated tasks, on any store that Spark writes.

Null and empty texts have the end id alone. Rows that repeat a doc_id stand side by side, in the order
of their texts' hashes; null doc_ids come first. Texts are encoded by the tokenizers library: each
distinct piece (a word with the space before it, marks, a line end) once per worker and bounded tables,
which gives the same ids as whole texts because the vocabulary's pattern always cuts between pieces.
Texts where white space meets white space, or with added tokens, take the whole-text path.
"""

from __future__ import annotations

import gc
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .store import Scratch

END_ID = 0
SHARD_IDS = 1_000_000
PER_ROUND = 5000
MIN_COUNT = 16
CACHE_ENTRIES = 700_000
GATHERED = 1 << 20  # pieces whose ids are put together at a time
MAGIC = b"RPR1"
_HEAD = struct.Struct("<4sIIII")
SHARD_SCHEMA = "part int, local_start long, n_docs int, n_ids long, shard binary"


class ChunkEncoder:
    """Ids of texts by the tokenizers library, piece by piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        space = self.library.encode(" ", add_special_tokens=False).tokens[0]
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith(space) for i in range(self.size)])
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that begin with their only space, in one call; tokens that start with a space cut them apart."""
        found = np.array(self.library.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        self._cut(pieces, found.tobytes(), (np.flatnonzero(self.opens[found]) * 4).tolist(), 0)

    def learn_solid(self, pieces: list[str]) -> None:
        """Encode pieces without white space in one call, each on a line of its own; line ends cut them apart."""
        found = np.array(self.library.encode_batch_fast(["".join(f"\n{p}" for p in pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        self._cut(pieces, found.tobytes(), (np.flatnonzero(found == self.line[0]) * 4).tolist() if len(self.line) == 1 else [], 4)

    def _cut(self, pieces: list[str], ids: bytes, starts: list[int], skipped: int) -> None:
        if len(starts) == len(pieces):
            self.known.update(zip(pieces, [ids[a + skipped : b] for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)], strict=True))
        else:
            self.known.update((p, self.whole(p)) for p in pieces)

    def look_up(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of pieces; None for those whose ids may depend on the text around them. When the table is full, pieces
        that are met again move to the next one, and the others go."""
        if len(self.known) >= CACHE_ENTRIES:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, pieces))
        spaced, solid = [], []
        missing = [p for p, x in zip(pieces, found, strict=True) if x is None]
        for p, ids in zip(missing, map(self.older.get, missing), strict=True):
            if ids is not None:
                self.known[p] = ids
                continue
            core = p[1:] if p[0] == " " else p
            if core.isalpha() or len(core.split()) == 1 and not core[0].isspace() and not core[-1].isspace():
                (solid if core is p else spaced).append(p)
            elif core and not core[0].isspace() and not core[-1].isspace() or p == "\n":
                self.known[p] = self.whole(p)
        for learn, new in ((self.learn, spaced), (self.learn_solid, solid)):
            for i in range(0, len(new), 20_000):
                learn(new[i : i + 20_000])
        return [self.known.get(p) if x is None else x for p, x in zip(pieces, found, strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each distinct piece of the texts is looked up once; ids are gathered by the pieces' places."""
        if not texts:
            return []
        raw = [(t or "").encode() for t in texts]
        starts = np.cumsum([0, *(len(x) + 1 for x in raw)])
        joined = b"\t".join([*raw, b""])  # every text is followed by a tab, a piece of its own that has no ids
        places = cuts(np.frombuffer(joined, dtype=np.uint8), starts)
        offsets = np.append(places, len(joined)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(joined)).dictionary_encode()
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        edges = np.searchsorted(places, starts)
        at[edges[1:] - 1] = len(distinct)
        ids = [*self.look_up(distinct), b""]
        open_ = np.fromiter((x is None for x in ids), dtype=bool, count=len(ids))
        unsure = np.logical_or.reduceat(open_[at], edges[:-1])
        ids = [x or b"" for x in ids]
        table, sizes = np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        before, parts = np.cumsum(sizes) - sizes, []
        for a in range(0, len(at), GATHERED):
            part = at[a : a + GATHERED]
            ends = np.cumsum(sizes[part])
            parts.append(table[np.repeat(before[part] - (ends - sizes[part]), sizes[part]) + np.arange(ends[-1])].tobytes())
        flat, byte_edges = b"".join(parts), (np.concatenate([[0], np.cumsum(sizes[at])])[edges] * 4).tolist()
        for i, t in enumerate(texts):  # an added token is told before words and marks are
            unsure[i] |= bool(t) and any(x in t for x in self.added)
        return [self.whole(t or "") if u else flat[a:b] for t, u, a, b in zip(texts, unsure.tolist(), byte_edges, byte_edges[1:], strict=False)]


_KIND = np.zeros(256, dtype=np.uint8)  # 1 letters, 2 marks, 3 digits
_KIND[33:127] = 2
_KIND[[*range(48, 58)]], _KIND[[*range(65, 91), *range(97, 123)]] = 3, 1
_LATIN = np.zeros(256, dtype=bool)  # leading bytes of U+00C0 to U+024F, all letters but two
_LATIN[0xC3:0xCA] = True


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin, the texts' starts and last bytes among them: before a space, between a letter and a
    mark after it, and about a line end between other characters. The vocabulary's pattern cuts there whatever comes
    before, and nothing after such a place changes what it cuts before it, if spaces are single."""
    kind = _KIND[data]
    letter = kind == 1
    pair = _LATIN[data[:-1]] & ((data[1:] & 0xC0) == 0x80)
    pair &= (data[:-1] != 0xC3) | ((data[1:] != 0x97) & (data[1:] != 0xB7))
    letter[1:] |= pair
    cut = data == 32
    cut[1:] |= letter[:-1] & (kind[1:] == 2)
    lines = np.flatnonzero(data[1:-1] == 10) + 1
    lines = lines[(letter[lines - 1] | (kind[lines - 1] > 0)) & ((kind[lines + 1] > 0) | _LATIN[data[lines + 1]])]
    cut[lines] = cut[lines + 1] = True
    cut[starts[:-1]] = cut[starts[1:] - 1] = True
    return np.flatnonzero(cut)


def load(path: str) -> ChunkEncoder:
    return W.kept("chunks", path, lambda: ChunkEncoder(path))


def compress(ids: np.ndarray, starts: np.ndarray, base: int, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (n, 2), symbols, and the documents' places among the symbols (n_docs + 1).

    starts: the documents' places among the ids, with the end. Goes on until no pair of adjacent symbols
    stands in MIN_COUNT places, or for so many rounds. Pairs are keyed in 32 bits while symbols fit in 16.
    """
    symbols, rules, top, done, fresh = ids.astype(np.uint32), [], base, 0, 0
    while len(symbols) > 1 and (rounds is None or done < rounds):
        done += 1
        width = 16 if top <= 65_536 else 32
        wide = symbols if width == 16 else symbols.astype(np.uint64)
        inside = np.ones(len(symbols), dtype=bool)
        inside[starts[1:-1] - 1] = False
        inside = inside[:-1]
        new = symbols >= fresh
        looked = np.flatnonzero(inside & (new[:-1] | new[1:]))
        ordered = np.sort((wide[looked] << wide.dtype.type(width)) | wide[looked + 1])
        if len(ordered) < MIN_COUNT:
            break
        # a pair in MIN_COUNT places spans so many equal keys in a row, so only such heads are looked at
        often = np.flatnonzero(ordered[: len(ordered) - MIN_COUNT + 1] == ordered[MIN_COUNT - 1 :])
        if not len(often):
            break
        often = often[np.concatenate([[True], ordered[often[1:]] != ordered[often[:-1]]])]
        # where all of them are replaced, no other pair gains places, so the next round's have a new symbol
        fresh = top if len(often) <= PER_ROUND else 0
        if len(often) > PER_ROUND:
            counts = np.searchsorted(ordered, ordered[often], side="right") - often
            often = np.sort(often[np.argpartition(-counts, PER_ROUND - 1)[:PER_ROUND]])
        chosen = ordered[often]
        left, right = (chosen >> chosen.dtype.type(width)).astype(np.int64), (chosen & chosen.dtype.type((1 << width) - 1)).astype(np.int64)
        lefts, row = np.unique(left, return_inverse=True)
        rights, column = np.unique(right, return_inverse=True)
        row_of, column_of = np.zeros(top, dtype=np.int16), np.zeros(top, dtype=np.int16)
        row_of[lefts], column_of[rights] = np.arange(1, len(lefts) + 1), np.arange(1, len(rights) + 1)
        rule_of = np.full((len(lefts) + 1) * (len(rights) + 1), -1, dtype=np.int16)  # at most 5,001 by 5,001
        rule_of[(row + 1) * (len(rights) + 1) + column + 1] = np.arange(len(chosen))
        at = np.flatnonzero(inside & (row_of[symbols[:-1]] > 0) & (column_of[symbols[1:]] > 0))
        place = rule_of[row_of[symbols[at]].astype(np.int64) * (len(rights) + 1) + column_of[symbols[at + 1]]]
        at, place = at[place >= 0], place[place >= 0]
        run = np.concatenate([[True], np.diff(at) != 1])  # of neighbouring places, every other one from the left
        head = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - head) % 2 == 0
        at, place = at[take], place[take]
        symbols[at] = place.astype(np.uint32) + np.uint32(top)
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        starts = starts - np.searchsorted(at + 1, starts)
        symbols = symbols[keep]
        rules.append(np.stack([left, right], axis=1))
        top += len(chosen)
    made = np.concatenate(rules) if rules else np.empty((0, 2), dtype=np.int64)
    return made.astype(np.uint32), symbols, starts


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    lengths = np.ones(base + len(rules), dtype=np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[base + i] = lengths[a] + lengths[b]
    return lengths


def pack(doc_ids: list[int | None], ids: np.ndarray, starts: np.ndarray, base: int) -> bytes:
    """The bytes of a shard: head, doc_ids, null marks, places, rules, expansion lengths, symbols."""
    rules, symbols, places = compress(ids, starts, base)
    kind = "<u2" if base + len(rules) <= 65_536 else "<u4"
    return b"".join([
        _HEAD.pack(MAGIC, len(doc_ids), len(rules), len(symbols), base),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype="u1").tobytes(),
        places.astype("<u4").tobytes(),
        rules.astype("<u4").tobytes(),
        expansion_lengths(rules, base)[base:].astype("<u4").tobytes(),
        symbols.astype(kind).tobytes(),
    ])


def _terminals(rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that all rules stand for, one rule after the other."""
    found = np.arange(base, base + len(rules), dtype=np.uint32)
    while (more := found >= base).any():
        pairs = rules[found[more] - base]
        at = (np.cumsum(1 + more) - 1 - more)[more]
        found = np.repeat(found, 1 + more)
        found[at], found[at + 1] = pairs[:, 0], pairs[:, 1]
    return found


class Shard:
    """A shard's documents; each can be read alone, whole or in part."""

    def __init__(self, data: bytes):
        magic, n, r, m, self.base = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += found.nbytes
            return found

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.places = take("<u4", n + 1)
        self.rules = take("<u4", 2 * r).reshape(r, 2)
        own = take("<u4", r)
        self.symbols = take("<u2" if self.base + r <= 65_536 else "<u4", m)
        self.lengths = np.concatenate([np.ones(self.base, dtype=np.int64), own.astype(np.int64)])
        offsets = np.concatenate([np.arange(self.base), self.base + np.concatenate([[0], np.cumsum(own)[:-1]]) if r else np.empty(0)]).astype(np.int64)
        flat = np.concatenate([np.arange(self.base, dtype=np.uint32), _terminals(self.rules, self.base)])
        self.offsets, self.flat = offsets, flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if not len(symbols):
            return np.empty(0, dtype=np.uint32)
        lengths = self.lengths[symbols]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.offsets[symbols] - (ends - lengths), lengths) + np.arange(ends[-1])]

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids of the i-th document, or its ids [start, stop), from the symbols that cover them."""
        symbols = self.symbols[self.places[i] : self.places[i + 1]]
        ends = np.cumsum(self.lengths[symbols])
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.empty(0, dtype=np.uint32)
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - before : stop - before]


def write_shards(df: DataFrame, tokenizer: str, scratch: Scratch, name: str = "shards", end_id: int = END_ID) -> DataFrame:
    """Encode (doc_id, text) in ascending doc_id order into a table of shards, and return that table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = load(tokenizer), TaskContext.get().partitionId()
        gc.disable()  # millions of strings and no cycles among them
        end = np.array([end_id], dtype="<u4").tobytes()
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        held = start = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            data = pack(doc_ids, ids, np.concatenate([[0], np.cumsum(sizes)]), encoder.size)
            row = {"part": [part], "local_start": [start], "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "shard": [data]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("local_start", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("shard", pa.binary())]))

        for batch, texts in W.chunks(batches, "text", 4_000_000, keep="chunks"):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                if parts and held + len(ids) // 4 + 1 > SHARD_IDS:
                    yield flush()
                    start, held = start + held, 0
                    doc_ids.clear()
                    parts.clear()
                doc_ids.append(doc_id)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
        if parts:
            yield flush()

    tie = F.xxhash64("text")
    ranged = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return scratch.save(ranged.mapInArrow(run, SHARD_SCHEMA), name, "none")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the shards: doc_id, start (ids before it), n_tokens and ids_crc32.

    The driver holds one total per task that wrote shards, never per document.
    """
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    offsets, before = {}, 0
    for part, n in totals:
        offsets[part] = before
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, local, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(data)
                ids = shard.expand(shard.symbols).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(shard.lengths[shard.symbols])])[shard.places]
                cuts = ends.tolist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard.doc_ids, pa.int64()),
                    "start": pa.array(ends[:-1] + offsets[part] + local, pa.int64()),
                    "n_tokens": pa.array(np.diff(ends), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                })

    return shards.select("part", "local_start", "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """op9: per document its place among all ids, its number of ids and their checksum, read back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(write_shards(docs, tokenizer, Scratch(spark, "op9")))
