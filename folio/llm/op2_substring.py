"""Repeated passages across documents: paragraph MinHash, exact Jaccard and removal by components.

Two kinds of paragraphs. A line of PARAGRAPH words or more has a MinHash signature of its five-word
shingles, in 8 bands of 3 rows, tuned for recall: 99.7 % at similarity 0.8. Colliding lines are joined,
confirmed by exact Jaccard (0.8 or more) and form components, as in op3_minhash.

Passages also stand in the middle of lines and across them, so every run of 2 * SEED - 1 = 23 words is a
paragraph too. Its signature is one minimum, of the hashes of its SEED-word shingles, and neighbouring
paragraphs mostly share it: what is kept is each minimum's place, a seed. Equal runs of 23 words always
share a seed, and copies of a passage at Jaccard 0.8 or more hold an equal run of 24 words (49 words may
differ in one, 94 in two ...). Colliding paragraphs are joined with the seed's first place, in the least
doc_id; both are aligned over REACH words beyond what they have in common, and the longest aligned passage
of PARAGRAPH words or more whose shingles have an exact Jaccard of 0.8 or more goes.

Passages all of whose seeds first stand in other text are found too where PARAGRAPH words are equal: the
words after each seed, PARAGRAPH of them, are compared among all documents that share seeds at all. Near
copies of that kind are the one thing missed.

A passage stays in the document with the least doc_id of its component (lines) or with its first place, and
goes from all others. Repeats inside one document alone stay.

Seeds in a thousandth of all places or more, of which there are under a thousand, are known to every task and
resolved while a document's seeds are one array; the others are joined by shuffling, so no group of copies
meets in one task. Consecutive seeds that stand in the same order in the same document are one run, and one
comparison.

Null and empty texts have no paragraphs, texts of fewer than PARAGRAPH words neither. Very long texts are rows
of their own size; comparisons see REACH words around a run. Rows that repeat a doc_id count as one document:
they aren't repeats of each other; null doc_ids are one document too, after all others. Ties (equal seeds side
by side) go to the leftmost place. Empty tables give empty tables. Only doc_id and text are read; ``remove``
passes other columns through, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .bits import held, let_through, packed
from .op3_minhash import Scheme, linked_nodes, nodes_of
from .store import Scratch

SHINGLE, PARAGRAPH, PERCENT = 5, 28, 80
LINES = Scheme(24, 8, 3, plain=True)
SEED, REACH, GAP, RESUME = 12, 96, 4, 4
HOT_SHARE = 1000
DOC = ["doc_id", "text_hash"]
SPANS = "array<struct<start:int,n_words:int,kept_in:long>>"
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_NO_DOC = (1 << 63) - 1
_RIGHT = 0x5DEECE66D5DEECE6  # keys of runs' right ends
_SEEDS = W.mix(np.arange(101, 101 + LINES.registers, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchors(grams: np.ndarray, window: int = SEED) -> np.ndarray:
    """Places of the least shingle of each `window` places, 32 at most (of equals either; in a run of equal neighbours
    every window-th)."""
    if len(grams) <= window:
        return np.array([int(grams.argmin())])
    least = (grams & ~np.uint64(31)) | (np.arange(len(grams), dtype=np.uint64) & np.uint64(31))  # low bits tell the place
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    at = np.arange(len(least))
    at += ((least & np.uint64(31)).astype(np.int64) - at) & 31
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    same = np.concatenate([[False], (np.diff(at) == 1) & (grams[at[1:]] == grams[at[:-1]])])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - head) % window == 0]


def signatures(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """MinHash signatures (len(starts), LINES.registers) of the shingles [start, end) of each line."""
    edges = np.stack([starts, ends], axis=1).reshape(-1)
    padded = np.concatenate([grams, np.zeros(1, dtype=np.uint64)])  # so that an end may be the last place
    out = np.empty((len(starts), LINES.registers), dtype=np.uint64)
    for k, seed in enumerate(_SEEDS):
        x = (padded ^ seed) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(x, edges)[::2]
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of each signature, of whole minima."""
    rows = mins.reshape(len(mins), LINES.bands, LINES.rows)
    acc = np.broadcast_to(np.arange(1, LINES.bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(LINES.rows):
        acc = W.mix(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return acc.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_DOC)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))


def _line_unit(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), 1) - (1 << 63)


def _long_lines(joined: bytes, places: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the lines of PARAGRAPH words or more in W.joined_hashes: their texts' numbers, first words, numbers of words, and
    the bytes at which they begin and end."""
    ends = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 10)
    after = np.searchsorted(places, ends)
    first = np.concatenate([[0], after[:-1]])
    at = np.flatnonzero(after - first >= PARAGRAPH)
    return np.searchsorted(edges, first[at], side="right") - 1, first[at], (after - first)[at], np.where(at > 0, ends[at - 1] + 1, 0), ends[at]


def paragraph_table(docs: DataFrame) -> DataFrame:
    """Of each document its seeds (arrays starts and seeds) in one row; of each long line a row with its unit (hash),
    start, n_shingles, its signature's low bits (registers) and its bands."""
    schema = "doc_id long, text_hash long, starts array<int>, seeds array<long>, unit long, start int, n_shingles long, n_words int, registers binary, bands array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def made(batch: pa.RecordBatch, owner: list[int], columns: dict) -> pa.RecordBatch:
        at = pa.array(owner, pa.int32())
        rest = [pa.array(columns[n], t) if n in columns else pa.nulls(len(owner), t) for n, t in zip(names[2:], types[2:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *rest], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in W.chunks(batches, "text"):
            joined, hashes, places, edges = W.joined_hashes(texts)
            long_grams, starts, seeds = W.windows(hashes, SEED), [], []
            owner = np.flatnonzero(np.diff(edges) >= PARAGRAPH).tolist()
            for i in owner:
                grams = long_grams[edges[i] : edges[i + 1] - SEED + 1]
                at = anchors(grams)
                starts.append(at.astype(np.int32))
                seeds.append(grams[at].view(np.int64))
            if owner:
                yield made(batch, owner, {"starts": starts, "seeds": seeds})
            line_owner, begin, n, *_ = _long_lines(joined, places, edges)
            if len(begin):
                mins = signatures(W.windows(hashes, SHINGLE), begin, begin + n - (SHINGLE - 1))
                units = [_line_unit(hashes[a:b]) for a, b in zip(begin.tolist(), (begin + n).tolist(), strict=True)]
                low = mins.astype(np.uint16)
                yield made(batch, line_owner.tolist(), {"unit": units, "start": begin - edges[line_owner], "n_words": n, "n_shingles": n - (SHINGLE - 1), "registers": [r.tobytes() for r in low], "bands": band_keys(mins).tolist()})

    return _keyed(docs).mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Per document (doc_id, text_hash) with passages to remove: spans, array of (start, n_words, kept_in),
    where kept_in is the doc_id that keeps the passage; spans may overlap."""
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    table = scratch.save(paragraph_table(docs), "paragraphs")
    linking = Scratch(docs.sparkSession, "substring-lines")
    of_lines = scratch.save(line_spans(docs, table.where("unit is not null"), scratch, linking), "of-lines")
    linking.drop()
    scratch.drop("lines")
    aligned, rest = seed_spans(docs, table.where("seeds is not null"), scratch)
    parts = of_lines.unionByName(aligned).unionByName(rest)
    found = scratch.save(parts.where("size(spans) > 0").groupBy(*DOC).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")), "spans")
    scratch.drop("paragraphs", "of-lines", "aligned")
    return found


def line_spans(docs: DataFrame, lines: DataFrame, scratch: Scratch, linking: Scratch) -> DataFrame:
    """Per document the lines that near copies of them in documents with a smaller doc_id make superfluous."""
    sketches = lines.select(*DOC, "n_shingles", F.col("unit").alias("set_hash"), "registers", "bands")
    nodes = scratch.save(nodes_of(sketches), "lines")

    def find(needed: DataFrame) -> DataFrame:
        asked = needed.groupBy(*DOC).agg(F.collect_list("node").alias("asked"))  # lines of one document
        return _texts(docs, asked).select("asked", "text").mapInArrow(_asked_lines, "node long, text binary")

    labels = linked_nodes(nodes, find, linking, SHINGLE, PERCENT, LINES)
    members = nodes.select("node", "least", "n").join(labels, "node")
    names = members.groupBy("component").agg(F.min("least").alias("kept_in"))
    named = members.join(names, "component").select(F.col("node").alias("group"), "kept_in", "n")
    places = lines.select(*DOC, "start", "n_words", F.col("unit").alias("group"))
    gone = _joined(places, named, lines.count()).where("doc_id <> kept_in")
    return gone.groupBy(*DOC).agg(F.collect_set(F.struct("start", "n_words", "kept_in")).alias("spans"))


def _asked_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in W.chunks(batches, "text"):
        nodes, lines = [], []
        joined, hashes, places, edges = W.joined_hashes(texts)
        open_ = [set(x) for x in batch.column(0).to_pylist()]
        for i, first, n, begin, end in zip(*(x.tolist() for x in _long_lines(joined, places, edges)), strict=True):
            if (unit := _line_unit(hashes[first : first + n])) in open_[i]:
                open_[i].remove(unit)
                nodes.append(unit)
                lines.append(b" ".join(joined[begin:end].split()))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lines, pa.binary())], names=["node", "text"])


def _texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, one row per (doc_id, text_hash), with the document's text. Only documents that a bit map of fixed
    size lets through are shuffled."""
    texts = let_through(_keyed(docs).where("text is not null"), "xxhash64(doc_id, text_hash)", asked.select(F.xxhash64(*DOC).alias("key")))
    return asked.join(texts.dropDuplicates(DOC), DOC)


def seed_spans(docs: DataFrame, table: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Per document the passages around seeds that stand in documents with a smaller doc_id too: those aligned with
    the seed's first place, and equal ones among the others."""
    repeated = table.select("doc_id", F.explode("seeds").alias("group")).groupBy("group")
    repeated = scratch.save(repeated.agg(F.min("doc_id").alias("kept_in"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("kept_in < last").drop("last"), "repeated")
    total = table.agg(F.sum(F.size("seeds").cast("long"))).first()[0] or 0
    hot = sorted((r["group"], r["kept_in"]) for r in repeated.where(F.col("n") > total / HOT_SHARE).collect())  # under HOT_SHARE rows
    rest = repeated.where(F.col("n") <= total / HOT_SHARE).select("group", "kept_in")
    possible = scratch.save(_possible(table, rest, hot).dropDuplicates(DOC), "possible")
    places = scratch.save(possible.select(*DOC, F.explode("rest").alias("p")).select(*DOC, "p.start", "p.group").join(rest, "group"), "places")

    first = places.where("doc_id = kept_in").select("group", *DOC, "start")
    first = first.unionByName(possible.select(*DOC, F.explode(F.filter("hot", lambda p: p["kept_in"] == F.col("doc_id"))).alias("p")).select("p.group", *DOC, "p.start"))
    leads = scratch.save(first.groupBy("group").agg(F.min(F.struct("text_hash", "start")).alias("lead")), "leads")
    hot_leads = sorted((r["group"], r["lead"]["text_hash"], r["lead"]["start"]) for r in leads.where(F.col("group").isin([g for g, _ in hot])).collect()) if hot else []

    others = places.where("doc_id <> kept_in").join(leads, "group").select(*DOC, F.struct("start", "group", "kept_in", "lead.text_hash", F.col("lead.start").alias("lead_start")).alias("p"))
    by_doc = others.groupBy(*DOC).agg(F.collect_list("p").alias("rest"))  # at most as many as the document has seeds
    hot_places = possible.select(*DOC, F.filter("hot", lambda p: p["kept_in"] != F.col("doc_id")).alias("hot")).where("size(hot) > 0")
    runs = scratch.save(_runs_of(by_doc.join(hot_places, DOC, "full"), hot_leads), "runs")
    scratch.drop("repeated", "possible", "places", "leads")

    ends = runs.select(*DOC, F.explode("ends").alias("e")).select(*DOC, F.col("e.group").alias("group"), "e.lead_doc", "e.lead_hash", "e.at")
    ends = scratch.save(ends, "ends")
    asked = ends.groupBy("group").agg(F.min("lead_doc").alias("doc_id"), F.min("lead_hash").alias("text_hash"), F.min("at").alias("at"), F.count("*").alias("n"))
    asked = asked.groupBy(*DOC).agg(F.collect_list(F.struct("group", "at", "n")).alias("asked"))  # ends of seeds of one document
    contexts = _texts(docs, asked).select("asked", "text").mapInArrow(_contexts, "group long, n long, words binary")
    near = _joined(ends.select(*DOC, "group"), scratch.save(contexts, "contexts"), ends.count(), "words")
    near = near.groupBy(*DOC).agg(F.collect_list(F.struct("group", "words")).alias("near"))
    work = runs.select(*DOC, "starts", "runs").join(near, DOC)
    aligned = _texts(docs, work).select(*DOC, "starts", "runs", "near", "text").mapInArrow(_aligned, f"doc_id long, text_hash long, spans {SPANS}, after array<struct<start:int,group:long,open:boolean>>")
    aligned = scratch.save(aligned, "aligned")
    scratch.drop("runs", "contexts", "ends")
    return aligned.select(*DOC, "spans"), _equal_after(aligned)


def _equal_after(aligned: DataFrame) -> DataFrame:
    """Per document the PARAGRAPH words after seeds that are equal in documents with a smaller doc_id, where any of
    those seeds is open: in no passage found so far."""
    after = aligned.select(*DOC, F.explode("after").alias("a")).select(*DOC, "a.*")
    again = after.groupBy("group").agg(F.min("doc_id").alias("kept_in"), F.max("doc_id").alias("last"), F.max(F.col("open").cast("int")).alias("open"), F.count("*").alias("n"))
    again = again.where("kept_in < last and open = 1").select("group", "kept_in", "n")
    total = aligned.agg(F.sum(F.size("after").cast("long"))).first()[0] or 0
    gone = _joined(after.drop("open"), again, total).where("doc_id <> kept_in")
    return gone.groupBy(*DOC).agg(F.collect_set(F.struct("start", F.lit(PARAGRAPH).alias("n_words"), "kept_in")).alias("spans"))


def _lists(flat: list[pa.Array], names: list[str], keep: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Lists of structs by owner row (ascending), of the flat values that stay."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=n))]).astype(np.int32)
    mask = pa.array(keep)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([c.filter(mask) for c in flat], names=names))


def _possible(table: DataFrame, rest: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """Per document its seeds that may be in rest (by a bit map of fixed size, 4 MB) and those that are hot."""
    shared = table.sparkSession.sparkContext.broadcast((packed(rest.select(F.col("group").alias("key"))), np.array([g for g, _ in hot], dtype=np.int64), np.array([k for _, k in hot], dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, groups, kept = shared.value
        for batch in batches:
            starts, seeds = batch.column(2).flatten(), batch.column(3).flatten()
            values = seeds.to_numpy()
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            is_rest = held(bits, values.view(np.uint64))
            at = np.minimum(np.searchsorted(groups, values), max(0, len(groups) - 1))
            is_hot = groups[at] == values if len(groups) else np.zeros(len(values), dtype=bool)
            keeper = pa.array(kept[at] if len(groups) else np.zeros(len(values), dtype=np.int64))
            any_ = np.zeros(batch.num_rows, dtype=bool)
            any_[owner[is_rest | is_hot]] = True
            out = pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), _lists([starts, seeds], ["start", "group"], is_rest & ~is_hot, owner, batch.num_rows),
                _lists([starts, seeds, keeper], ["start", "group", "kept_in"], is_hot, owner, batch.num_rows),
            ], names=[*DOC, "rest", "hot"])
            yield out.filter(pa.array(any_))

    return table.select(*DOC, "starts", "seeds").mapInArrow(run, "doc_id long, text_hash long, rest array<struct<start:int,group:long>>, hot array<struct<start:int,group:long,kept_in:long>>")


def _runs_of(by_doc: DataFrame, hot_leads: list[tuple[int, int, int]]) -> DataFrame:
    """Per document: starts of its seeds that stand first in other documents, runs of them that stand in the same order
    in the same document (with keys of both ends), and what is asked about each end's first place."""
    shared = by_doc.sparkSession.sparkContext.broadcast({g: (h, s) for g, h, s in hot_leads})  # under HOT_SHARE entries
    schema = "doc_id long, text_hash long, starts array<int>, runs array<struct<start:int,stop:int,kept_in:long,left:long,right:long>>, ends array<struct<group:long,lead_doc:long,lead_hash:long,at:int>>"
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kept_in", pa.int64()), ("left", pa.int64()), ("right", pa.int64())]))
    end_type = pa.list_(pa.struct([("group", pa.int64()), ("lead_doc", pa.int64()), ("lead_hash", pa.int64()), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                starts, runs, ends = [], [], []
                for rest, hot in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    places = [(p["start"], p["group"], p["kept_in"], p["text_hash"], p["lead_start"]) for p in rest or []]
                    places += [(p["start"], p["group"], p["kept_in"], *leads[p["group"]]) for p in hot or []]
                    places.sort()
                    starts.append([p[0] for p in places])
                    mine = open_runs(places)
                    runs.append([(a[0], b[0] + SEED, a[2], a[1], b[1] ^ _RIGHT) for a, b in mine])
                    asked = {a[1]: (a[2], a[3], a[4]) for a, _ in mine} | {b[1] ^ _RIGHT: (b[2], b[3], b[4] + SEED) for _, b in mine}
                    ends.append([(g, *x) for g, x in asked.items()])
                names = [["start", "stop", "kept_in", "left", "right"], ["group", "lead_doc", "lead_hash", "at"]]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(starts, pa.list_(pa.int32())),
                    *(pa.array([[dict(zip(n, x, strict=True)) for x in row] for row in rows], t) for rows, n, t in ((runs, names[0], run_type), (ends, names[1], end_type))),
                ], names=[*DOC, "starts", "runs", "ends"])

    return by_doc.select(*DOC, "rest", "hot").mapInArrow(run, schema)


def open_runs(places: list[tuple]) -> list[tuple[tuple, tuple]]:
    """First and last places (start, group, lead doc, lead hash, lead start) of runs along one diagonal without a
    gap: all words from the first to the last are equal to the lead's. Runs of fewer than PARAGRAPH words that
    lie amid longer ones, PARAGRAPH words from their ends, are left out."""
    runs: list[list[tuple]] = []
    last: dict[tuple, list[tuple]] = {}
    for p in places:
        diagonal = (p[2], p[3], p[0] - p[4])
        now = last.get(diagonal)
        if now is not None and p[0] - now[1][0] <= SEED:
            now[1] = p
        else:
            last[diagonal] = now = [p, p]
            runs.append(now)
    sure = merged([(a[0], b[0] + SEED - a[0]) for a, b in runs if b[0] + SEED - a[0] >= PARAGRAPH])
    begins = [a for a, _ in sure]
    out = []
    for a, b in runs:
        if b[0] + SEED - a[0] < PARAGRAPH:
            k = bisect_right(begins, a[0] - PARAGRAPH) - 1
            if k >= 0 and b[0] + SEED + PARAGRAPH <= sure[k][1]:
                continue
        out.append((a, b))
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (asked, text) to the hashes of the REACH words before each place asked for, or after it (right ends)."""
    for batch, texts in W.chunks(batches, "text"):
        groups, counts, words = [], [], []
        _, every, _, edges = W.joined_hashes(texts)
        every_gram, edges = W.windows(every, SEED).view(np.int64), edges.tolist()
        for asked, first, end in zip(batch.column(0).to_pylist(), edges, edges[1:], strict=False):
            hashes, grams = every[first:end], every_gram[first : max(first, end - SEED + 1)]
            for x in asked:
                at = x["at"]
                left = at < len(grams) and int(grams[at]) == x["group"]
                groups.append(x["group"])
                counts.append(x["n"])
                words.append((hashes[max(0, at - REACH) : at] if left else hashes[at : at + REACH]).tobytes())
                if len(groups) == 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(counts, pa.int64()), pa.array(words, pa.binary())], names=["group", "n", "words"])
                    groups, counts, words = [], [], []
        if groups:
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(counts, pa.int64()), pa.array(words, pa.binary())], names=["group", "n", "words"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text_hash, starts, runs, near, text) to passages that go, and units of the words after seeds."""
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("kept_in", pa.int64())]))
    after_type = pa.list_(pa.struct([("start", pa.int32()), ("group", pa.int64()), ("open", pa.bool_())]))
    for batch, texts in W.chunks(batches, "text"):
        spans, after = [], []
        _, every, _, edges = W.joined_hashes(texts)
        every_gram, edges = W.windows(every, SEED), edges.tolist()
        for starts, runs, near, first, end in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), edges, edges[1:], strict=False):
            hashes, grams = every[first:end], every_gram[first : max(first, end - SEED + 1)]
            beside = {x["group"]: np.frombuffer(x["words"], dtype=np.uint64) for x in near}
            found: dict[tuple[int, int], int] = {}
            for r in sorted(runs, key=lambda r: r["start"] - r["stop"]):
                if any(a <= r["start"] and r["stop"] <= b and kept == r["kept_in"] for (a, b), kept in found.items()):
                    continue  # the alignment that found the passage has gone through this run
                span = passage(hashes, r["start"], r["stop"], beside[r["left"]], beside[r["right"]])
                if span:
                    found[span] = min(r["kept_in"], found.get(span, r["kept_in"]))
            spans.append([{"start": a, "n_words": b - a, "kept_in": k} for (a, b), k in sorted(found.items())])
            cover = merged([(a, b - a) for a, b in found])
            begins, units = [a for a, _ in cover], after_units(hashes, grams, np.array(starts, dtype=np.int64))
            after.append([{"start": s, "group": u, "open": not ((k := bisect_right(begins, s) - 1) >= 0 and s + SEED <= cover[k][1])} for s, u in zip(starts, units, strict=False)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, span_type), pa.array(after, after_type)], names=[*DOC, "spans", "after"])


def after_units(hashes: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> list[int]:
    """Hashes of the PARAGRAPH words from each of the ascending starts, as far as so many words follow; grams are the
    hashes of SEED words."""
    at = starts[starts + PARAGRAPH <= len(hashes)]
    acc = grams[at]
    for step in (*range(SEED, PARAGRAPH - SEED, SEED), PARAGRAPH - SEED):
        acc = W.mix(acc * np.uint64(0x9E3779B97F4A7C15) + grams[at + step])
    return acc.view(np.int64).tolist()


def passage(hashes: np.ndarray, start: int, stop: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int] | None:
    """The longest passage (start, stop) of a text around a run whose words are another text's too; left and right
    are the other text's words before and after the run."""
    low = max(0, start - REACH)
    span = near_passage(hashes[low : stop + REACH], np.concatenate([left, hashes[start:stop], right]), start - low, len(left))
    return (low + span[0], low + span[1]) if span else None


def _equal_runs(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Ends (in a, in b) of the equal runs from the front of both, over gaps of up to GAP words in either; and how many
    shingles the runs up to there hold, but for those across the first one's front."""
    i = j = held = 0
    out = []
    while True:
        begin = i
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        held += max(0, i - begin - (SHINGLE - 1 if out else 0))
        out.append((i, j, held))
        gaps = ((x, both - x) for both in range(1, 2 * GAP + 1) for x in range(max(0, both - GAP), min(GAP, both) + 1))
        step = next(((x, y) for x, y in gaps if i + x + RESUME <= len(a) and a[i + x : i + x + RESUME] == b[j + y : j + y + RESUME]), None)
        if step is None:
            return out
        i, j = i + step[0], j + step[1]


def near_passage(a: np.ndarray, b: np.ndarray, at: int, at_b: int) -> tuple[int, int] | None:
    """The longest (start, end) in a, around the words that both have in common from at and at_b, that is alike
    to its aligned passage in b. Passages whose equal runs hold too few shingles by a margin aren't compared."""
    x, y = a.tolist(), b.tolist()
    right = [(at + i, at_b + j, n) for i, j, n in _equal_runs(x[at:], y[at_b:])]
    left = [(at - i, at_b - j, n) for i, j, n in _equal_runs(x[:at][::-1], y[:at_b][::-1])]
    if right[-1][0] - left[-1][0] < PARAGRAPH:
        return None
    grams_a, grams_b = W.windows(a, SHINGLE), W.windows(b, SHINGLE)
    spans = sorted(((s, e) for s in left for e in right if e[0] - s[0] >= PARAGRAPH and e[1] - s[1] >= PARAGRAPH), key=lambda p: p[0][0] - p[1][0])
    for (start, start_b, n), (end, end_b, m) in spans:
        one, other, common = end - start - SHINGLE + 1, end_b - start_b - SHINGLE + 1, n + m - SHINGLE + 1
        if one == other == common:
            return start, end
        if 100 * common < (PERCENT - 10) * (one + other - common):
            continue
        common, union = W.jaccard_counts(np.unique(grams_a[start : end - SHINGLE + 1]), np.unique(grams_b[start_b : end_b - SHINGLE + 1]))
        if 100 * common >= PERCENT * union:
            return start, end
    return None


def _joined(found: DataFrame, repeated: DataFrame, total: int, value: str = "kept_in") -> DataFrame:
    """found with the value of its group. Rows without a group are left out first. Groups with over a HOT_SHARE-th of
    all places, of which there are fewer than HOT_SHARE, are joined by broadcast; the others by shuffling, so no task
    gets more than such a group."""
    found = let_through(found, "group", repeated.select(F.col("group").alias("key")))
    common = F.broadcast(repeated.where(F.col("n") > total / HOT_SHARE).select("group", value))
    rest = repeated.where(F.col("n") <= total / HOT_SHARE).select("group", value)
    return found.join(common, "group").unionByName(found.join(common.select("group"), "group", "left_anti").join(rest, "group"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of (start, length) ranges as ascending (start, end)."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], a + n)
        else:
            out.append((a, a + n))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (start, n_words) and without the space after each span."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in merged(spans):
        start = places[a][0]
        out.append(text[at:start])
        at = places[b][0] if b < len(places) else len(text)
    return b"".join([*out, text[at:]])


def remove(docs: DataFrame, scratch: Scratch | None = None, text: str = "text") -> DataFrame:
    """docs with their repeated passages cut out of the text; every row and column stays."""
    own = docs.select(F.col("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    spans = repeated_spans(own, scratch).select(*DOC, F.transform("spans", lambda s: F.struct(s["start"], s["n_words"])).alias("spans"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_DOC)).alias("doc_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_hash"), F.struct("*").alias("row"), F.col(f"`{text}`").cast("binary").alias("text"))
    joined = rows.join(spans, DOC, "left").select("row", "spans", "text")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in W.chunks(batches, "text"):
            new = [t.decode() if t is not None and not s else t if t is None else cut(t, [tuple(x.values()) for x in s]).decode() for t, s in zip(texts, batch.column(1).to_pylist(), strict=True)]
            row = batch.column(0)
            columns = row.flatten()
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in row.type])

    return joined.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: per document with repeated passages: how many spans and words go, and the documents that keep them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = repeated_spans(docs, Scratch(spark, "op2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            unions = [merged([(x["start"], x["n_words"]) for x in s]) for s in lists]
            yield pa.RecordBatch.from_arrays([
                pa.array([None if i == _NO_DOC else i for i in ids], pa.int64()),
                pa.array([len(u) for u in unions], pa.int64()),
                pa.array([sum(b - a for a, b in u) for u in unions], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in u] for u in unions], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([sorted({x["kept_in"] for x in s}) for s in lists], pa.list_(pa.int64())),
            ], names=["doc_id", "n_spans", "n_words_removed", "spans", "kept_in"])

    return found.select("doc_id", "spans").mapInArrow(run, "doc_id long, n_spans long, n_words_removed long, spans array<struct<start:int,end:int>>, kept_in array<long>")
