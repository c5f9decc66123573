"""Byte-pair encoding and decoding with a contiguous rank array.

A text is cut into pieces by the vocabulary's pattern. Each short piece holds its part boundaries and
the ranks of adjacent parts in two contiguous lists; the least rank is found by a scan, its boundary is
deleted and the two neighbouring ranks are refreshed. Pieces beyond ``SHORT`` bytes use a heap over
linked parts instead, with the same result, so that one huge piece costs n log n. Words repeat, so
the encodings of space-delimited chunks are kept in two bounded generations per worker: the pattern
always cuts before a single space between other characters, so such chunks encode alone; texts where
white space meets white space are cut by the pattern as a whole. Decoding gathers token bytes by id.

Null and empty texts encode to no ids and decode to the empty string. The special token's string in a
text is that token, as in the tokenizers library's default. Rows stay as they are, repeated ones too;
other columns of the input pass through, and an input column named like an output is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as W

#: Fixed value: the pattern that the vocabulary was made with, \\s written as the Unicode property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
SHORT = 256
GENERATION = 350_000
_NONE = 1 << 60


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary, by the public rule:
    visible Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class Gather:
    """Byte strings by number, joined for a whole array of numbers at once."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(b) for b in strings], dtype=np.int32)
        self.offsets = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def join(self, numbers: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The joined strings of numbers[cuts[i]:cuts[i + 1]] for each i."""
        lengths = self.lengths[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        at = np.arange(ends[-1], dtype=np.int32)
        at += np.repeat(self.offsets[numbers] - ends[:-1].astype(np.int32), lengths)
        data = self.flat[at].tobytes()
        places = ends[cuts].tolist()
        return [data[a:b] for a, b in zip(places, places[1:], strict=False)]


class RankBpe:
    """A byte-level BPE vocabulary of the tokenizers library's file format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for i, b in enumerate(self.token_bytes):
            if len(b) == 1:
                self.byte_id[b[0]] = i
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[left] << 20 | vocab[right], r)
            self.made.append(vocab[left + right])
        self.pattern = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.texts = Gather(self.token_bytes)
        self.decimals = Gather([f"{i},".encode() for i in range(size)])

    def forget(self) -> None:
        """Drop the encodings: an idle worker holds the vocabulary alone."""
        self.recent, self.older = {}, {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the pattern."""
        if len(piece) > SHORT:
            return self._encode_long(piece)
        rank, made = self.rank.get, self.made
        parts = [self.byte_id[b] for b in piece]
        ranks = [rank(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 20 | parts[i + 1], _NONE)
        return parts

    def _encode_long(self, piece: bytes) -> list[int]:
        rank, made = self.rank.get, self.made
        parts = [self.byte_id[b] for b in piece]
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else -1
            if j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (q := rank(parts[a] << 20 | parts[b], _NONE)) != _NONE:
                    heapq.heappush(heap, (q, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def _chunk(self, chunk: str) -> bytes:
        """Encoding of a space and the chunk; KeyError if the chunk isn't cut off by its spaces."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise KeyError(chunk)
        found = self.older.get(chunk) or self._whole(f" {chunk}")
        if len(chunk) <= SHORT:
            if len(self.recent) >= GENERATION:
                self.older, self.recent = self.recent, {}
            self.recent[chunk] = found
        return found

    def _whole(self, text: str) -> bytes:
        return array("I", [i for p in self.pattern.findall(text) for i in self.encode_piece(p.encode())]).tobytes()

    def _span(self, text: str) -> list[bytes]:
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            known = self.recent.get
            try:
                return [self._whole(first), *[known(c) or self._chunk(c) for c in rest]]
            except KeyError:
                pass
        return [self._whole(text)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        spans = [text]
        if self.marks is not None and self.marks.search(text):
            spans, at = [], 0
            for m in self.marks.finditer(text):
                spans += [text[at : m.start()], self.special[m.group()]]
                at = m.end()
            spans.append(text[at:])
        found: list[bytes] = []
        for span in spans:
            if isinstance(span, int):
                found.append(array("I", [span]).tobytes())
            elif span:
                found += self._span(span)
        return b"".join(found)


def load(path: str) -> RankBpe:
    return W.kept("bpe", path, lambda: RankBpe(path))


def _replaced(df: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    """df without the columns that the outputs replace, and the schema with the outputs."""
    names = {f.name.lower() for f in fields}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    return kept, T.StructType([*kept.schema.fields, *fields])


def _add(batch: pa.RecordBatch, drop: str, columns: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != drop]
    return pa.RecordBatch.from_arrays([c for _, c in [*kept, *columns]], names=[n for n, _ in [*kept, *columns]])


ENCODED = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType())]


def _encoded(bpe: RankBpe, texts: list[str | None]) -> tuple[list[bytes], list[tuple[str, pa.Array]]]:
    """The ids of texts, and the columns of ENCODED."""
    found = [bpe.encode(t) if t else b"" for t in texts]
    sizes = [len(f) // 4 for f in found]
    decimals = bpe.decimals.join(np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum([0, *sizes]))
    digests = [hashlib.sha256(d[:-1]).hexdigest() for d in decimals]
    return found, [("ids", pa.array(found, pa.binary())), ("n_tokens", pa.array(sizes, pa.int64())), ("ids_sha256", pa.array(digests, pa.string()))]


def _decoded(bpe: RankBpe, rows: list[bytes | None]) -> list[str]:
    flat = np.frombuffer(b"".join([r for r in rows if r]), dtype="<u4")
    return [d.decode("utf-8", "replace") for d in bpe.texts.join(flat, np.cumsum([0, *(len(r) // 4 if r else 0 for r in rows)]))]


def _end(tokenizer: str) -> None:
    """What a task leaves in its worker, which outlives it: the vocabulary alone."""
    load(tokenizer).forget()
    W.trim()


def encode(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit integers), ``n_tokens`` and ``ids_sha256``
    (of the decimal ids joined by commas) to the rows of df; the text column stays."""
    kept, schema = _replaced(df, ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in W.chunks(batches, "__text", keep="bpe"):
            yield _add(batch, "__text", _encoded(load(tokenizer), texts)[1])
        _end(tokenizer)

    return kept.withColumn("__text", F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (string) to rows with a binary ids column; bytes that are no UTF-8 become U+FFFD."""
    kept, schema = _replaced(df, [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in W.chunks(batches, "__ids", keep="bpe"):
            yield _add(batch, "__ids", [("decoded", pa.array(_decoded(load(tokenizer), rows), pa.string()))])
        _end(tokenizer)

    return kept.withColumn("__ids", F.col(f"`{ids}`")).mapInArrow(run, schema)


def round_trip(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """What encode adds, and ``decoded_sha256``, the digest of the decoding of the ids in UTF-8, in one pass: encode
    and decode one after the other take two Python workers a task, each with a vocabulary of its own."""
    kept, schema = _replaced(df, [*ENCODED, T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in W.chunks(batches, "__text", keep="bpe"):
            ids, columns = _encoded(load(tokenizer), texts)
            digests = [hashlib.sha256(d.encode()).hexdigest() for d in _decoded(load(tokenizer), ids)]
            yield _add(batch, "__text", [*columns, ("decoded_sha256", pa.array(digests, pa.string()))])
        _end(tokenizer)

    return kept.withColumn("__text", F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def query(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """op4: per document the number of ids and the digests of its ids and of their decoding."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode(docs, tokenizer).select("doc_id", "n_tokens", "ids_sha256", "ids")
    return decode(encoded, tokenizer).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
