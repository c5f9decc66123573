"""Token counts of a sentencepiece vocabulary without ids of any document.

Pieces are counted once per distinct pre-token of the corpus and joined to each document's pre-token frequencies.
Pre-tokens are cut only where no piece of the vocabulary can lie across the cut (checked against every piece when the
model is loaded), so a text's count is the sum over its pre-tokens.

``vocabulary`` sums occurrences block by block before anything is shuffled and counts the pieces of each distinct
pre-token. The ``HEAD`` most frequent ones, a bounded number of bounded keys, go to every task, which adds them up at
once; what is left of a document, its rare pre-tokens, meets the vocabulary in an equality join. No join key is
frequent, then, and a document's rare pre-tokens are the only thing that moves with it. Keys are the pre-tokens
themselves or, beyond ``LONG`` characters, their digests.

Null and empty texts hold no token and no byte. Repeated rows and repeated or null doc_ids are counted row by row, a
text of any length is counted whole (a run without a break is one pre-token), ties between equally frequent pre-tokens
change where they are joined and never a count, an empty table gives no rows. Columns named in ``keep`` pass through;
one that is named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as W
from .store import Scratch

#: Spaces belong to what follows them; letters, single digits, line ends and other marks are apart. Sentencepiece writes
#: a space as U+2581 and one in front of every text.
PRETOKEN = r" *(?:[\p{L}\p{M}]+|[0-9]|\n|[^ \p{L}\p{M}0-9\n]+)| +"
SPACE_MARK = "▁"
HEAD = 1 << 17
LONG = 64
LIMIT = 4096
BLOCK_CHUNKS, KNOWN_CHUNKS = 200_000, 500_000
_CHUNK = re.compile(r" *[^ ]+| +")


class Pieces:
    """A sentencepiece BPE model that counts pieces of pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pattern = regex.compile(PRETOKEN)
        for i in range(len(self.model)):
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)):
                piece = self.model.id_to_piece(i).replace(SPACE_MARK, " ")
                if not self.pattern.fullmatch(piece):
                    raise ValueError(f"the piece {piece!r} lies across a cut of the pre-token pattern")
        self.alone = len(self.model.encode("\n"))

    def counts(self, pretokens: list[str]) -> list[int]:
        """Pieces of each pre-token: behind a line end, which no piece spans, no space is put in front of it."""
        return [len(ids) - self.alone for ids in self.model.encode([f"\n{t}" for t in pretokens], num_threads=1)]


def chunks(text: str) -> list[str]:
    """Runs of spaces and of what follows them; each consists of whole pre-tokens."""
    return _CHUNK.findall(" " + text.replace(SPACE_MARK, " ")) if text else []


def key(pretoken: str) -> str:
    """What a pre-token is joined by; two line ends open no pre-token."""
    return pretoken if len(pretoken) <= LONG else "\n\n" + hashlib.sha256(pretoken.encode()).hexdigest()


def _load(path: str) -> Pieces:
    return W.kept("pieces", path, lambda: Pieces(path))


def vocabulary(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Distinct pre-tokens: key, occurrences, pieces."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, block = regex.compile(PRETOKEN), Counter()

        def out() -> pa.RecordBatch:
            found: Counter[str] = Counter()
            for chunk, n in block.items():
                for t in pattern.findall(chunk):
                    found[t] += n
            block.clear()
            return pa.RecordBatch.from_pydict({"key": pa.array(map(key, found), pa.string()), "pretoken": pa.array(found, pa.string()), "occurrences": pa.array(found.values(), pa.int64())})

        for _, texts in W.chunks(batches, "text"):
            for t in texts:
                block.update(chunks(t or ""))
            if len(block) > BLOCK_CHUNKS:
                yield out()
        if block:
            yield out()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(model)
        for batch, pretokens in W.chunks(batches, "pretoken", keep="pieces"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pieces.counts(pretokens), pa.int64())], names=["key", "occurrences", "pieces"])

    blocks = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(seen, "key string, pretoken string, occurrences long")
    distinct = blocks.groupBy("key").agg(F.first("pretoken").alias("pretoken"), F.sum("occurrences").alias("occurrences"))
    return distinct.mapInArrow(counted, "key string, occurrences long, pieces long")


def _frequent(known: DataFrame, limit: int) -> tuple[dict[str, int], DataFrame]:
    """The most frequent pre-tokens, ``limit`` at most, and the others: classes of like frequency are taken whole."""
    classes = known.withColumn("class", F.floor(4 * F.log2("occurrences")).cast("int"))
    least, total = 1 << 30, 0
    for r in classes.groupBy("class").count().orderBy(F.desc("class")).collect():  # some 250 classes at most
        total += r["count"]
        if total > limit:
            break
        least = r["class"]
    head = {r["key"]: r["pieces"] for r in classes.where(F.col("class") >= least).select("key", "pieces").collect()}
    return head, classes.where(F.col("class") < least).select("key", "pieces")


def count(docs: DataFrame, model: str, scratch: Scratch, text: str = "text", keep: Sequence[str] = ("doc_id",), limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """Per row of docs: the columns ``keep``, n_bytes (of the text in UTF-8), n_tokens, over_limit (more than limit)."""
    known = scratch.save(vocabulary(docs, model, text), "pretokens")
    frequent, rare = _frequent(known, head)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    keep = [c for c in keep if c.lower() not in {"n_bytes", "n_tokens", "over_limit"}]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("__")).alias("kept"), F.col(f"`{text}`").cast("string").alias("text"))
    source = source.select("kept", F.monotonically_increasing_id().alias("row"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    schema = T.StructType([*source.schema.fields[:3], T.StructField("n_frequent", T.LongType()), T.StructField("rest", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("n", T.LongType())])))])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, pattern, seen = shared.value, regex.compile(PRETOKEN), {}  # chunks met before

        def resolved(chunk: str) -> tuple[int, tuple[str, ...]]:
            total, others = 0, ()
            for t in pattern.findall(chunk):
                n = pieces.get(k := t if len(t) <= LONG else key(t))
                if n is None:
                    others = (*others, k)
                else:
                    total += n
            if len(seen) >= KNOWN_CHUNKS:
                seen.clear()
            if len(chunk) <= LONG:
                seen[chunk] = total, others
            return total, others

        for batch, texts in W.chunks(batches, "text"):
            sums, keys, numbers, ends = [], [], [], [0]
            for t in texts:
                total, rest = 0, Counter()
                for chunk, n in Counter(chunks(t or "")).items():
                    known, others = seen.get(chunk) or resolved(chunk)
                    total += n * known
                    for k in others:
                        rest[k] += n
                sums.append(total)
                keys += rest
                numbers += rest.values()
                ends.append(len(keys))
            pairs = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int64())], ["key", "n"])
            rests = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64()), rests], names=["kept", "row", "n_bytes", "n_frequent", "rest"])

    rows = scratch.save(source.mapInArrow(frequencies, schema), "frequencies")
    rests = rows.select("row", F.explode("rest").alias("r")).join(rare, F.col("r.key") == rare["key"])
    sums = rests.groupBy("row").agg(F.sum(F.col("r.n") * F.col("pieces")).alias("n_rare"))
    total = (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_tokens")
    return rows.join(sums, "row", "left").select(*[F.col(f"kept.`{c}`") for c in keep], "n_bytes", total).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """op11: per document its bytes, its tokens and whether they are more than 4,096."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count(docs, model, Scratch(spark, "op11"))
