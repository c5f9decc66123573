"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the letter n-grams of two to four characters, with a boundary mark at either end of a
word, hashed into ``BUCKETS`` rows of an embedding table. A text is the mean of its subwords' rows; a
linear softmax over that mean gives the languages. The model is fitted by stochastic gradient descent
in NumPy on a bounded sample of labelled rows (``PER_LANGUAGE`` texts of each language, of ``LANGUAGE_BYTES``
in all, chosen by the hash of doc_id and text; languages with fewer give all). A held-back fifth of the sample calibrates a
temperature and the rejection threshold. Because the classifier is linear, table and softmax weights
collapse into one score per bucket and language, and whole texts are scored by gathers and sums.

The model's size is fixed: BUCKETS x languages floats, sent to the executors with the function.

Null texts and texts without a letter are ``und`` with score 0 and rejected. Without labelled rows all
texts are ``und``. Repeated rows and repeated doc_ids are each scored; extra columns pass through, and
an input column named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as W

BUCKETS = 1 << 16
DIM = 12
GRAMS = (2, 3, 4)
PER_LANGUAGE = 1200
LANGUAGE_BYTES = 64_000_000
EPOCHS = 4
RATE = 4.0
REJECTED_SHARE = 0.001
MAX_THRESHOLD = 0.5
PART_CHARS = 500_000
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_BREAK = np.uint32(0)


def _letter_table() -> np.ndarray:
    """Code points of letters (above the basic plane: all) keep their value; others become a break."""
    table = np.zeros(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = c
    return table


_TABLE: list[np.ndarray] = []


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, and each one's text number, for n-grams that hold no break inside."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    joined = "  ".join([t.lower() for t in texts]) + "  "
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t.lower()) + 2 for t in texts])
    letters = np.where(points < 0x10000, _TABLE[0][np.minimum(points, 0xFFFF)], points)
    is_letter = letters != _BREAK
    # runs of breaks shrink to one, so that a boundary mark costs no more than a character
    keep = is_letter | np.concatenate([[True], is_letter[:-1]])
    letters, owner, is_letter = letters[keep], owner[keep], is_letter[keep]
    spread = letters * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B)
    found, owners = [], []
    for n in GRAMS:
        m = len(letters) - n + 1
        if m <= 0:
            continue
        h = spread[:m].copy()
        for j in range(1, n):
            h *= np.uint32(0x01000193)
            h ^= spread[j : m + j]
        ok = np.ones(m, dtype=bool)
        for j in range(1, n - 1):
            ok &= is_letter[j : m + j]
        if n == 2:
            ok = is_letter[:m] | is_letter[1 : m + 1]
        h = h[ok]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        found.append((h >> np.uint32(16)).astype(np.int32) & (BUCKETS - 1))
        owners.append(owner[: m][ok])
    if not found:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """A row per text, in parts of bounded size."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= PART_CHARS:
                out.append(self._logits(part))
                part, size = [], 0
        if part:
            out.append(self._logits(part))
        return np.concatenate(out) if out else np.empty((0, len(self.languages)))

    def _logits(self, texts: list[str]) -> np.ndarray:
        buckets, owners = subwords(texts)
        counts = np.maximum(np.bincount(owners, minlength=len(texts)), 1)
        sums = np.stack([np.bincount(owners, weights=self.scores[:, k][buckets], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        return sums / counts[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return _softmax(self.logits(texts) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fit on labelled texts; a fifth of them, by place, calibrates and isn't trained on."""
    languages = sorted(set(labels))
    target = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM))
    weights, bias = rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    bags = []
    for t in texts:
        b, n = np.unique(subwords([t])[0], return_counts=True)
        bags.append((b, n / max(1, n.sum())))
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 50 else np.zeros(len(texts), dtype=bool)
    train = np.flatnonzero(~held)
    share = np.bincount(target[train], minlength=len(languages)) / max(1, len(train))
    steps, total = 0, EPOCHS * len(train)
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            b, n = bags[i]
            if not len(b):
                continue
            rate = RATE * (1 - steps / total)
            steps += 1
            rows = table[b]
            mean = n @ rows
            p = _softmax((mean @ weights + bias)[None])[0]
            p[target[i]] -= 1
            p /= len(languages) * max(share[target[i]], 1e-9)  # languages count alike
            back = weights @ p
            weights -= 0.1 * rate * np.outer(mean, p)
            bias -= 0.02 * rate * p
            table[b] = rows - rate * n[:, None] * back[None]
    model = Model(languages, np.ascontiguousarray((table @ weights).astype(np.float32)), bias, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else train
    logits, gold = model.logits([texts[i] for i in check]), target[check]
    best = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(gold)), gold], 1e-12)).mean())
    model.temperature = float(best)
    p = _softmax(logits / best)
    right = p.max(axis=1)[p.argmax(axis=1) == gold]
    model.threshold = float(min(MAX_THRESHOLD, np.quantile(right, REJECTED_SHARE))) if len(right) else 0.0
    return model


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most_bytes: int = LANGUAGE_BYTES) -> tuple[list[str], list[str]]:
    """At most about per_language labelled texts and most_bytes of each language, chosen by the hash of doc_id and
    text, so that neither a repeated doc_id nor null ones come all together; rows that repeat both count once."""
    usable = docs.where("lang is not null and text is not null and length(text) > 0").select("doc_id", "lang", "text", F.xxhash64("text").alias("hash"))
    span = 1 << 40
    place = F.xxhash64(F.col("doc_id"), F.col("hash"), F.lit(11)).bitwiseAND(F.lit(span - 1))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(place, 0.02).alias("distinct"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not counts:
        return [], []
    share = {r["lang"]: min(1.0, per_language / r["distinct"], most_bytes * r["n"] / (r["bytes"] * r["distinct"])) for r in counts}
    bound = F.create_map(*[F.lit(x) for k, s in share.items() for x in (k, int(s * span))])
    rows = usable.where(place < bound[F.col("lang")]).dropDuplicates(["doc_id", "hash", "lang"]).select("doc_id", "lang", "text").collect()
    rows.sort(key=lambda r: (W.crc_mod(r["doc_id"], 1 << 31), r["doc_id"] or 0, r["text"], r["lang"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from the rows of docs (doc_id, lang, text); None if no row is labelled."""
    texts, labels = sample(docs, per_language)
    model = fit(texts, labels) if texts else None
    del texts, labels
    W.trim()
    return model


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to the rows of df."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    names = {f.name for f in fields}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in W.chunks(batches, "__text", 1_000_000):
            lang, score, rejected = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
            known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model is not None else []
            if known:
                p = model.probabilities([texts[i] for i in known])
                for i, k, s in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    lang[i], score[i], rejected[i] = model.languages[k], s, s < model.threshold
            columns = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "__text"]
            columns += [("lang_pred", pa.array(lang, pa.string())), ("score", pa.array(score, pa.float64())), ("rejected", pa.array(rejected, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])

    return kept.withColumn("__text", F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: per document the predicted language, learnt from the documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
