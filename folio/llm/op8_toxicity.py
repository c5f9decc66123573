"""Toxicity by compression distance: windows of text under a toxic and an ordinary zstandard dictionary.

Two dictionaries are trained on labelled rows. Both hold the same ordinary text first, so that windows
compress at all; the toxic one ends with the words that cover the byte strings which stand out in toxic
rows, the ordinary one with as much more ordinary text. Strings are weighed by the number of distinct
word contexts they occur in, so copies of a document count once. A text is cut into windows of
``WINDOW`` words, and each window's two compressed lengths are compared: how far and how often the toxic
dictionary wins, against thresholds, gives a few features of the document, and a logistic model turns
them into a score. Weights and cut are calibrated on rows that the dictionaries they are fitted with
haven't seen, so that the best decision (largest F1) is 0.7; a score equal to the cut counts as toxic.

The dictionaries are chosen here and not by zstandard's own trainer, which was tried: it takes what is
frequent in a kind of text, and what tells toxic text is rare in it.

Learning uses at most about TOXIC_ROWS toxic and ORDINARY_ROWS other labelled rows and SAMPLE_BYTES of either kind,
chosen by hashes of doc_id and text; everything sent to executors has a fixed size. Scoring reads whole texts.

Null, empty and word-less texts have the lowest score. Without labels of both kinds every score is the
share of toxic labels. Repeated rows are scored alike, a doc_id labelled twice counts as toxic if any of
its labels is; other columns pass through, and input columns named like the outputs are replaced.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import words as W

TOXIC_ROWS, ORDINARY_ROWS = 2000, 4000
SAMPLE_BYTES = 128_000_000
WINDOW, STEP, GRAM = 10, 5, 6
SHARED_BYTES, OWN_BYTES = 30_000, 2_000
MIN_CONTEXTS, ROWS_PER_CONTEXT, MIN_LOG_ODDS = 4, 150, 3.0
LEVEL = 6
THRESHOLDS = tuple(range(2, 8))
CUT = 0.7
FOLDS = 3


def windows(text: bytes | None) -> list[bytes]:
    words = text.lower().split() if text else []
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, max(1, len(words) - WINDOW + STEP), STEP)] if words else []


def _padded(word: bytes) -> bytes:
    return b" " + word[:40] + b" "


def _grams(word: bytes) -> set[bytes]:
    return {word[i : i + GRAM] for i in range(max(1, len(word) - GRAM + 1))}


def contexts(texts: list[bytes]) -> tuple[Counter, Counter, int]:
    """Distinct three-word contexts of each word and of each byte string in a word; and how many there are."""
    ids: dict[bytes, int] = {}
    flat, keys = [], []
    for text in texts:
        words = text.lower().split()
        if words:
            flat.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words)))
            h = W.hash_words([b"", *words, b""])
            keys.append(W.windows(h, 3))
    if not flat:
        return Counter(), Counter(), 0
    _, first = np.unique(np.concatenate(keys), return_index=True)
    counts = np.bincount(np.concatenate(flat)[first], minlength=len(ids)).tolist()
    by_word, by_gram = Counter(), Counter()
    for word, n in zip(ids, counts, strict=True):
        by_word[word] = n
        for g in _grams(_padded(word)):
            by_gram[g] += n
    return by_word, by_gram, len(first)


def cover(by_word: Counter, weight: dict[bytes, float], size: int) -> bytes:
    """Words that cover the most weight per byte, each string counted once; the best come last."""
    held = {p: g for w, n in by_word.items() if n >= 2 and (g := _grams(p := _padded(w)) & weight.keys())}
    heap = [(-sum(weight[x] for x in g) / len(p), p) for p, g in held.items()]
    heapq.heapify(heap)
    done: set[bytes] = set()
    out, total = [], 0
    while heap and total < size:
        _, p = heapq.heappop(heap)
        now = -sum(weight[x] for x in held[p] - done) / len(p)
        if now >= 0:
            continue
        if heap and now > heap[0][0] + 1e-15:
            heapq.heappush(heap, (now, p))
            continue
        out.append(p)
        total += len(p)
        done |= held[p]
    return b"".join(reversed(out))


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary's content."""
    tox_words, tox, n_tox = contexts(toxic)
    ord_words, plain, n_ord = contexts(ordinary)
    stand_out = {}
    for g, n in tox.items():
        odds = np.log((n + 0.5) / max(1, n_tox)) - np.log((plain[g] + 0.5) / max(1, n_ord))
        if n >= max(MIN_CONTEXTS, len(toxic) // ROWS_PER_CONTEXT) and odds > MIN_LOG_ODDS:
            stand_out[g] = n / n_tox * odds
    own = cover(tox_words, stand_out, OWN_BYTES)
    usual = cover(ord_words, dict(plain.most_common(40_000)), SHARED_BYTES + OWN_BYTES)
    shared, more = usual[-SHARED_BYTES:], usual[:-SHARED_BYTES]
    return shared + own, shared + (more[-len(own) :] if own else b"")


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    constant: float | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def compressors(self) -> tuple:
        if "_pair" not in self.__dict__:
            options = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=4, write_content_size=False, write_dict_id=False)
            self._pair = tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=options).compress for d in (self.toxic, self.ordinary))
        return self._pair

    def features(self, text: bytes | None) -> np.ndarray | None:
        """How the windows' lengths compare; None without a window."""
        toxic, ordinary = self.compressors()
        gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], dtype=np.float64)
        if not len(gain):
            return None
        best, size = np.sort(gain)[::-1][:3], np.log(len(gain))
        over = np.array([(gain >= k).mean() for k in THRESHOLDS])
        return np.concatenate([[gain.mean()], over, [best[0], best.mean(), size, best[0] * size], over * min(len(gain), 150) / 10])

    def scores(self, texts: list[bytes | None]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        out = []
        for text in texts:
            x = self.features(text)
            out.append(0.0 if x is None else float(1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -40, 40)))))
        return out


def fit(texts: list[bytes], toxic: list[int], others: float = 1.0, folds: int = FOLDS) -> Model:
    """Train dictionaries and the model on labelled texts; others: labelled rows that each ordinary text
    stands for, against one for each toxic text.

    Weights and threshold are calibrated on features that dictionaries of the other folds give each text, so on
    texts that those dictionaries haven't seen; equal texts fall into one fold. The dictionaries that score are
    those of all texts.
    """
    y = np.array(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(b"", b"", constant=float(y.mean()) if len(y) else 0.0)
    fold = np.array([xxhash.xxh3_64_intdigest(t, 7) % folds for t in texts])
    rows = []
    for k in range(folds):
        learnt = [[t for t, z, f in zip(texts, toxic, fold, strict=True) if f != k and bool(z) == kind] for kind in (True, False)]
        if not all(learnt):
            learnt = [[t for t, z in zip(texts, toxic, strict=True) if bool(z) == kind] for kind in (True, False)]
        part = Model(*train_dictionaries(*learnt))
        rows += [(x, z) for t, z, f in zip(texts, y, fold, strict=True) if f == k and (x := part.features(t)) is not None]
    model = Model(*train_dictionaries(*([t for t, z in zip(texts, toxic, strict=True) if bool(z) == kind] for kind in (True, False))))
    if not rows:
        return Model(b"", b"", constant=float(y.mean()))
    x, y = np.stack([r[0] for r in rows]), np.array([r[1] for r in rows])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w, b = (x - model.mean) / model.scale, np.zeros(x.shape[1]), 0.0
    for _ in range(2000):
        e = 1 / (1 + np.exp(-(z @ w + b))) - y
        w -= 0.3 * (z.T @ e / len(y) + 1e-3 * w)
        b -= 0.3 * e.mean()
    s = z @ w + b
    order = np.argsort(-s)
    hits = np.cumsum(y[order])
    false = np.cumsum(1 - y[order]) * others
    best = int(np.argmax(2 * hits / (hits + false + y.sum())))
    here = s[order[best]]
    after = s[order[best + 1]] if best + 1 < len(s) else here - 1
    model.weights, model.bias = w, b - (here + after) / 2 + np.log(CUT / (1 - CUT))
    return model


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int], float]:
    """Labelled texts: about so many of either kind at most, and most_bytes of either kind, chosen by hashes.

    Labels are chosen by their doc_id; where these lead to more rows than asked for, as one doc_id may stand in any number
    of them, rows are chosen by doc_id and text. Rows that repeat both count once."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    most = {1: toxic_rows, 0: ordinary_rows}
    span = 1 << 40
    place = lambda *of: F.xxhash64(*of).bitwiseAND(F.lit(span - 1))
    below = lambda share: F.when(F.col("toxic") > 0, int(share[1] * span)).otherwise(int(share[0] * span))
    chosen = known.where(place(F.col("doc_id"), F.lit(23)) < below({k: min(1.0, n / max(1, counts.get(k, 0))) for k, n in most.items()}))
    # toxic_rows + ordinary_rows rows of 12 bytes, about
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id").withColumn("hash", F.xxhash64("text"))
    found = rows.groupBy("toxic").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("doc_id", "hash"), 0.02).alias("distinct"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    share = {1: 1.0, 0: 1.0}
    for r in found:
        rest = r["distinct"] / r["n"]  # a copy of a row adds nothing
        share[r["toxic"]] = min(1.0, 1.1 * most[r["toxic"]] / (r["n"] * min(1.0, 1.05 * rest)), most_bytes / max(1, r["bytes"] * rest))
    rows = rows.where((place(F.col("doc_id"), F.col("hash"), F.lit(29)) < below(share))).dropDuplicates(["doc_id", "hash"]).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["text"])))
    others = max(1.0, counts.get(0, 0) / ordinary_rows) / max(1.0, counts.get(1, 0) / toxic_rows)
    return [bytes(r["text"]) for r in rows], [r["toxic"] for r in rows], others


def train(docs: DataFrame, labels: DataFrame) -> Model:
    model = fit(*sample(docs, labels))
    W.trim()
    return model


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted`` to the rows of df."""
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("score", "predicted")])
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in W.chunks(batches, "__text"):
            found = model.scores(texts)
            columns = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "__text"]
            columns += [("score", pa.array(found, pa.float64())), ("predicted", pa.array([int(s >= CUT) for s in found], pa.int32()))]
            yield pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])

    return kept.withColumn("__text", F.col(f"`{text}`").cast("binary")).mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: per document a toxicity score, learnt from the labelled documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = train(docs.where(~held_out()), labels)
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
