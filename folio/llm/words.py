"""Words, hashes and shingles on NumPy arrays, shared by the operators that read whole texts.

A word is a run of bytes outside space and \\x09-\\x0D; ``bytes.split()`` cuts at exactly those and
``bytes.lower()`` folds exactly A-Z, so both agree with the patterns of the SQL versions.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_MUL1, _MUL2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GOLD = U64(0x9E3779B97F4A7C15)
_SHIFT30, _SHIFT27, _SHIFT31 = U64(30), U64(27), U64(31)
CHUNK_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _SHIFT30)
    x *= _MUL1
    x ^= x >> _SHIFT27
    x *= _MUL2
    x ^= x >> _SHIFT31
    return x


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it has grown to ``limit`` entries."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=U64, count=len(words))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _INVERSE = 0x9FB21C651E98DF25, pow(0x9FB21C651E98DF25, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]
SEGMENT = 1 << 16


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, x in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.multiply.accumulate(np.concatenate([np.ones(1, dtype=U64), np.full(size - 1, x, dtype=U64)]))
    return _POWERS


def text_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text (lower-cased by the caller), all at once: a polynomial in its bytes,
    mixed with its length. They aren't those of hash_words."""
    return placed_hashes(text)[0]


def placed_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """text_hashes, and the byte at which each word begins."""
    out, places, at = [], [], 0
    while at < len(text):
        stop = at + SEGMENT
        if stop < len(text):  # segments end between words
            cut = max(text.rfind(c, at, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            while cut < 0 and stop < len(text):
                cut = stop if _SPACE[text[stop]] else -1
                stop += 1
            stop = cut if cut >= 0 else len(text)
        data = np.frombuffer(text, dtype=np.uint8, count=min(stop, len(text)) - at, offset=at)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]])))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            up, down = _powers(len(data))
            sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum((data + U64(1)) * up[: len(data)])])
            found = (sums[ends] - sums[starts]) * down[starts]
            out.append(mix(found ^ mix((ends - starts).astype(U64))))
            places.append(starts + at)
        at += max(1, len(data))
    return (np.concatenate(out), np.concatenate(places)) if out else (np.empty(0, dtype=U64), np.empty(0, dtype=np.int64))


def joined_hashes(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts, each followed by a line end; the hashes and places of their words; and where each text's
    words begin among them, with the end."""
    joined = b"\n".join([*(t or b"" for t in texts), b""]).lower()
    hashes, places = placed_hashes(joined)
    return joined, hashes, places, np.searchsorted(places, np.cumsum([0, *(len(t or b"") + 1 for t in texts)]))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (empty when there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc *= _GOLD
        acc += hashes[j : n + j]
    return mix(acc)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a lower-cased text.

    Fewer than k words: the whole sequence is one shingle. No word: no shingle.
    """
    hashes = text_hashes(text.lower()) if text else np.empty(0, dtype=U64)
    if len(hashes) < k:
        return windows(hashes, len(hashes)) ^ U64(len(hashes)) if len(hashes) else hashes
    return np.unique(windows(hashes, k))


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted distinct arrays."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common, len(a) + len(b) - common


_KEPT: dict[str, tuple[str, object]] = {}


def kept(name: str, key: str, make: Callable[[], object]) -> object:
    """A worker's large tables of one operator, made again for another key."""
    if _KEPT.get(name, (None, None))[0] != key:
        _KEPT[name] = key, make()
    return _KEPT[name][1]


def cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``limit`` (one larger row is a range of its own)."""
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def byte_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a string or binary column, 0 for nulls, without making the values."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES, keep: str = "") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches whose texts hold about ``limit`` bytes (one longer text makes a slice of its
    own); only a slice's texts are made into Python objects at a time.

    Workers outlive their tasks, and idle ones stay: at a task's end its tables go, and freed memory goes back to
    the system, but for those that the operator ``keep`` keeps for its next task; those of other operators go at its beginning.
    """
    for name in [k for k in _KEPT if k != keep]:
        del _KEPT[name]
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for start, stop in cuts(byte_sizes(column), limit):
            yield batch.slice(start, stop - start), column.slice(start, stop - start).to_pylist()
    if not keep:
        _HASHES.clear()
        trim()


def trim() -> None:
    """Give freed memory back to the system after training and at a task's end, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def crc_mod(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus
