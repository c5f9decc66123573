"""Near-duplicate documents by SetSketch registers, banding, a joint likelihood estimate and exact checks.

Sketch. Every shingle is the start of a Poisson process whose points fall on registers; a register keeps
the least point, and its value is that minimum on an exponential scale, truncated to 16 bits. Only
points below a bound that depends on the set's size are made (about m log m a document for m
registers, besides one a shingle), and a sketch is a function of the set alone, so sketches merge by
the maximum of their registers. Values agree with a probability close to the Jaccard similarity.

Candidates. Equal sets collapse to one node first, so copies cost nothing. Bands of registers give
buckets; each bucket's members are compared with its leader (linear in the members), by the maximum
likelihood of the similarity given both sets' sizes and the registers that are larger, smaller, equal.
Exact checks on whole texts confirm links: each node's best candidate first, then those that still
join different components. What is left in a bucket with more than one component (the rest) is compared
with all its members, in blocks of bounded size that hold whole texts and give back links only. So no
link that collides in any band is lost, without making pairs of a group's members as rows.

With 32 bands of 5 registers (DOCUMENTS), a pair at similarity 0.80 is missed with probability 3e-6.

Null texts and texts without words are linked with nothing. Rows that repeat a doc_id are one document
each and share that doc_id; null doc_ids belong to the component of their text and are never its name
unless they are all it has. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .components import components
from .store import Scratch


class Scheme(NamedTuple):
    """Registers of a sketch; bands times rows of them make the buckets. plain: registers are minimum
    hashes' low bits, which agree with the similarity as probability, and not on an exponential scale."""

    registers: int
    bands: int
    rows: int
    plain: bool = False


DOCUMENTS = Scheme(160, 32, 5)
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
BLOCK_ROWS, BLOCK_BYTES = 256, 8_000_000
SLACK = 6.0
BROADCAST_ROWS = 100_000
_STEP = np.uint64(0xD1342543DE82EF95)
_LOW = np.uint64(0xFFFFFFFF)


def sketches(sets: list[np.ndarray], scheme: Scheme = DOCUMENTS) -> np.ndarray:
    """Registers (len(sets), registers) as uint16 of non-empty sets of 64-bit hashes."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    m = scheme.registers
    least = np.full((len(sets), m), np.inf)
    bounds = (np.log(m) + 8) / sizes
    todo = np.arange(len(sets))
    while len(todo):
        hashes = W.mix(np.concatenate([sets[i] for i in todo]))
        owner = np.repeat(todo, sizes[todo])
        bound, at = np.repeat(bounds[todo], sizes[todo]), np.zeros(len(hashes))
        while len(hashes):
            hashes = hashes + _STEP
            drawn = W.mix(hashes)
            at = at - np.log(((drawn >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32) / m
            live = at <= bound
            hashes, owner, bound, at = hashes[live], owner[live], bound[live], at[live]
            register = ((drawn[live] & _LOW) * np.uint64(m)) >> np.uint64(32)
            np.minimum.at(least.reshape(-1), owner * m + register.astype(np.int64), at)
        todo = np.flatnonzero(np.isinf(least).any(axis=1))
        least[todo], bounds[todo] = np.inf, bounds[todo] * 3
    return np.clip(np.floor(1 + np.log(RATE / least) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray, scheme: Scheme = DOCUMENTS) -> np.ndarray:
    """A signed 64-bit key for each band of each sketch."""
    _, bands, width, _ = scheme
    rows = registers.reshape(len(registers), bands, width).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(width):
        acc = W.mix(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return acc.view(np.int64)


_GRID = np.concatenate([np.linspace(0, 0.5, 26)[:-1], np.linspace(0.5, 1, 101)])


def estimate(larger: np.ndarray, smaller: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, scheme: Scheme = DOCUMENTS) -> np.ndarray:
    """Joint maximum-likelihood similarity of pairs with so many larger and smaller registers."""
    if scheme.plain:
        return 1 - (larger + smaller) / scheme.registers
    total = size_a + size_b
    u, v = (size_a / total)[:, None], (size_b / total)[:, None]
    j = np.minimum(_GRID[None], np.minimum(u / v, v / u))

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, None) * (BASE - 1) / BASE) / np.log(BASE)

    above, below = p(u - v * j), p(v - u * j)
    equal = scheme.registers - larger - smaller
    tiny = 1e-12
    likely = larger[:, None] * np.log(above + tiny) + smaller[:, None] * np.log(below + tiny) + equal[:, None] * np.log(np.maximum(1 - above - below, tiny))
    return j[np.arange(len(j)), likely.argmax(axis=1)]


def floor_for(similarity: float, scheme: Scheme = DOCUMENTS) -> float:
    """Estimates below this are SLACK standard deviations under the threshold."""
    return similarity - SLACK * np.sqrt(similarity * (1 - similarity) / scheme.registers)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common, union = W.jaccard_counts(a, b)
    return union > 0 and 100 * common >= percent * union


def sketch_table(docs: DataFrame, shingle: int, scheme: Scheme = DOCUMENTS) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, set_hash (of the set), registers and bands (null for no set)."""
    schema = "doc_id long, text_hash long, n_shingles long, set_hash long, registers binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in W.chunks(batches, "text"):
            sets = [W.shingles(t, shingle) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            hashes, registers, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                found = sketches([sets[i] for i in full], scheme)
                for i, row, keys in zip(full, found, band_keys(found, scheme).tolist(), strict=True):
                    hashes[i] = int(W.mix(np.array([np.add.reduce(W.mix(sets[i])) + np.uint64(len(sets[i]))])).view(np.int64)[0])
                    registers[i], bands[i] = row.tobytes(), keys
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.int64()),
                pa.array(registers, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
            ], names=["doc_id", "text_hash", "n_shingles", "set_hash", "registers", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


def _estimated(pairs: DataFrame, nodes: DataFrame, floor: float, scheme: Scheme) -> DataFrame:
    """Pairs (a, b) whose estimate reaches the floor, with it."""
    side = nodes.select("node", "n_shingles", "registers")
    joined = pairs.join(side.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a")), "a")
    joined = joined.join(side.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, r_a, n_b, r_b = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "n_a", "r_a", "n_b", "r_b"))
            left, right = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint16).reshape(-1, scheme.registers) for c in (r_a, r_b))
            s = estimate((left > right).sum(axis=1), (left < right).sum(axis=1), np.asarray(n_a, dtype=np.float64), np.asarray(n_b, dtype=np.float64), scheme)
            keep = pa.array(s >= floor)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), pa.array(s[s >= floor], pa.float64())], names=["a", "b", "estimate"])

    return joined.select("a", "b", "n_a", "r_a", "n_b", "r_b").mapInArrow(run, "a long, b long, estimate double")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole texts' sets are linked."""
    joined = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("t_a")), "a")
    joined = joined.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, dtype=np.uint64))
        for whole in batches:
            for start, stop in W.cuts(W.byte_sizes(whole.column(2)) + W.byte_sizes(whole.column(3)), BLOCK_BYTES):
                batch, hits = whole.slice(start, stop - start), []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if y != last[0]:
                        last = y, W.shingles(y, shingle)
                    hits.append(linked(W.shingles(x, shingle), last[1], percent))
                keep = pa.array(hits, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return joined.select("a", "b", "t_a", "t_b").mapInArrow(run, "u long, v long")


class _Block:
    """Members of one bucket on one side of a block, as sets, sketches and components."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.labels: list[int] = []
        self.sets: list[np.ndarray] = []
        self.registers: list[np.ndarray] = []

    def add(self, node: int, label: int, registers: bytes, found: np.ndarray) -> None:
        self.nodes.append(node)
        self.labels.append(label)
        self.sets.append(found)
        self.registers.append(np.frombuffer(registers, dtype=np.uint16))


def _block_links(rest: _Block, members: _Block, band: int, floor: float, percent: int, scheme: Scheme) -> list[tuple[int, int]]:
    """Links between the rest and the members that join different components, found in this block.

    Pairs that already collide in an earlier band are left to that band's bucket, where registers tell (plain
    ones are low bits of what makes the bands, so they don't); once a link joins two components here, their
    other pairs are passed over.
    """
    if not rest.nodes or not members.nodes:
        return []
    left, right = np.stack(rest.registers), np.stack(members.registers)
    sizes_l, sizes_r = (np.array([len(s) for s in x.sets], dtype=np.float64) for x in (rest, members))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    found = []
    bands_r = right.reshape(len(right), scheme.bands, scheme.rows)
    label_r, node_r = np.array(members.labels), np.array(members.nodes)
    for i in range(len(left)):
        other = label_r != rest.labels[i]
        earlier = (bands_r[:, :band] == left[i].reshape(scheme.bands, scheme.rows)[None, :band]).all(axis=2).any(axis=1) if band and not scheme.plain else np.zeros(len(right), dtype=bool)
        at = np.flatnonzero(other & ~earlier & (np.minimum(sizes_l[i], sizes_r) * 100 >= percent * np.maximum(sizes_l[i], sizes_r)))
        if not len(at):
            continue
        s = estimate((left[i] > right[at]).sum(axis=1), (left[i] < right[at]).sum(axis=1), np.full(len(at), sizes_l[i]), sizes_r[at], scheme)
        order = np.argsort(-s, kind="stable")
        for k in at[order[s[order] >= floor]].tolist():
            a, b = root(rest.labels[i]), root(int(label_r[k]))
            if a != b and linked(rest.sets[i], members.sets[k], percent):
                parent[max(a, b)] = min(a, b)
                found.append((rest.nodes[i], int(node_r[k])))
    return found


def _rest_links(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int, percent: int, floor: float, scheme: Scheme) -> DataFrame:
    """Links from the members of a bucket that are outside its leader's component to any of its members.

    buckets: (key, band, node, leader). Each bucket is cut into blocks: a part of its rest, all its
    members. A task streams over the members of a block and holds BLOCK_ROWS texts of either side.
    """
    label = labels.select("node", "component")
    with_label = buckets.join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    lead = label.select(F.col("node").alias("leader"), F.col("component").alias("lead_label"))
    with_label = with_label.join(lead, "leader", "left").withColumn("is_rest", F.col("label") != F.coalesce("lead_label", "leader")).drop("lead_label")
    with_label = scratch.save(with_label.select("key", "band", "node", "label", "is_rest"), "labelled")
    sizes = with_label.groupBy("key").agg(F.sum(F.col("is_rest").cast("long")).alias("n_rest"), F.count("*").alias("n_all")).where("n_rest > 0")
    rows = with_label.join(sizes, "key")
    rows = rows.withColumn("rest_blocks", F.ceil(F.col("n_rest") / BLOCK_ROWS).cast("int")).withColumn("all_blocks", F.ceil(F.col("n_all") / (2 * BLOCK_ROWS)).cast("int"))
    spread = F.pmod(F.xxhash64("node", F.lit(5)), F.col("rest_blocks")).cast("int")
    spread_all = F.pmod(F.xxhash64("node", F.lit(9)), F.col("all_blocks")).cast("int")
    as_rest = rows.where("is_rest").select("key", "band", "node", "label", F.lit(0).alias("side"), spread.alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"))
    as_member = rows.select("key", "band", "node", "label", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("i"), spread_all.alias("j"))
    sides = as_rest.unionByName(as_member)
    held = nodes.select("node", "registers").join(texts.select("node", "text"), "node")
    full = sides.join(held, "node").select("key", "i", "j", "side", "band", "node", "label", "registers", "text")
    full = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rest, members, band, size, held = None, _Block(), _Block(), 0, 0, 0
        kept: dict[int, np.ndarray] = {}
        out: list[tuple[int, int]] = []

        def compare() -> None:
            nonlocal members, size
            out.extend(_block_links(rest, members, band, floor, percent, scheme))
            members, size = _Block(), 0

        for key, i, j, side, b, node, label, registers, text in (row for x in batches for start, stop in W.cuts(W.byte_sizes(x.column(8)), BLOCK_BYTES) for row in zip(*(c.slice(start, stop - start).to_pylist() for c in x.columns), strict=True)):
            if (key, i, j) != at:
                compare()
                at, rest, band = (key, i, j), _Block(), b
            if node not in kept:
                if len(kept) >= 2 * BLOCK_ROWS or held >= 2 * BLOCK_BYTES:
                    kept.clear()
                    held = 0
                kept[node] = W.shingles(text, shingle)
                held += kept[node].nbytes
            if side == 0:
                rest.add(node, label, registers, kept[node])
            else:
                members.add(node, label, registers, kept[node])
                size += len(text)
                if len(members.nodes) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    compare()
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])
                out.clear()
        compare()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])

    return full.mapInArrow(run, "u long, v long")


def nodes_of(rows: DataFrame) -> DataFrame:
    """Equal sets of the sketches as one node each: node, least doc_id, one row, n rows, and the set's sketch."""
    return rows.where("set_hash is not null").groupBy(F.col("set_hash").alias("node")).agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.first("bands").alias("bands"),
    )


def linked_nodes(nodes: DataFrame, find: Callable[[DataFrame], DataFrame], scratch: Scratch, shingle: int, percent: int, scheme: Scheme = DOCUMENTS) -> DataFrame:
    """Rows (node, component) of the nodes that are linked to another; component is the least node reachable.

    find: from (node, doc_id, text_hash) of the nodes that collide, (node, text) with their whole texts.
    """
    floor = floor_for(percent / 100, scheme)
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    lead = keys.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("x"), F.count("*").alias("n")).where("n > 1")
    lead = lead.select("key", F.col("x").bitwiseXOR(F.col("key")).alias("leader"))
    buckets = scratch.save(keys.join(lead, "key"), "buckets")
    stars = buckets.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    stars = scratch.save(_estimated(stars, nodes, floor, scheme), "stars")

    needed = buckets.select("node").distinct().join(nodes.select("node", "row"), "node").select("node", "row.doc_id", "row.text_hash")
    texts = scratch.save(find(scratch.save(needed, "needed")).dropDuplicates(["node"]), "texts")

    best = stars.select(F.col("a").alias("node"), F.struct("estimate", "a", "b").alias("s")).unionByName(stars.select(F.col("b").alias("node"), F.struct("estimate", "a", "b").alias("s")))
    first = best.groupBy("node").agg(F.max("s").alias("s")).select("s.a", "s.b").distinct()
    links = scratch.save(_confirmed(first, texts, shingle, percent), "links-1")
    labels = scratch.save(components(links, scratch, "cc-1"), "labels-1")
    of = labels.select("node", "component")
    open_pairs = stars.join(of.select(F.col("node").alias("a"), F.col("component").alias("c_a")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("component").alias("c_b")), "b", "left")
    open_pairs = open_pairs.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b").join(first, ["a", "b"], "left_anti")
    labels = _joined_labels(labels, scratch.save(_confirmed(open_pairs, texts, shingle, percent), "links-2"), scratch, 2)
    rest = scratch.save(_rest_links(buckets, labels, nodes, texts, scratch, shingle, percent, floor, scheme), "links-3")
    labels = _joined_labels(labels, rest, scratch, 3)
    scratch.drop("buckets", "stars", "needed", "texts", "links-1", "links-2", "links-3", "labelled")
    return labels


def _joined_labels(labels: DataFrame, links: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """The labels after more links: components start from each node's present label, not from all links."""
    if not links.head(1):
        return labels
    stars = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return scratch.save(components(stars.unionByName(links), scratch, f"cc-{k}"), f"labels-{k}")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, scratch: Scratch | None = None, scheme: Scheme = DOCUMENTS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text_hash, n_shingles, component_id.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets, and
    component_id is the least doc_id reachable over links. Rows without a set name themselves. Up to
    broadcast_rows nodes that collide (24 bytes each) find their texts by broadcast, more by shuffling.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.save(sketch_table(docs, shingle, scheme), "sketches")
    nodes = scratch.save(nodes_of(rows), "nodes")

    def find(needed: DataFrame) -> DataFrame:
        if needed.count() <= broadcast_rows:
            needed = F.broadcast(needed)
        keyed = docs.withColumn("text_hash", F.xxhash64("text"))
        same = keyed["doc_id"].eqNullSafe(needed["doc_id"]) & (keyed["text_hash"] == needed["text_hash"])
        return keyed.join(needed, same).select("node", keyed["text"].cast("binary").alias("text"))

    labels = linked_nodes(nodes, find, scratch, shingle, percent, scheme)
    named = nodes.select("node", "least").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.save(named.join(names, "component").select("node", "component_id"), "named")
    scratch.drop("labels-1", "labels-2", "labels-3", "nodes")
    found = rows.select("doc_id", "text_hash", "n_shingles", "set_hash").join(named, F.col("set_hash") == F.col("node"), "left")
    return found.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: per document its set's size, its component at similarity 0.8 of 4-word shingles, and whether it stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, shingle=4, percent=80, scratch=Scratch(spark, "op3"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The same rows by exact Jaccard of all pairs that share a shingle, and closure over links.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, doc_id, array_to_string(w[j : j + 3], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS j FROM d WHERE len(w) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM g GROUP BY 1, 2),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x.doc_id AS u, y.doc_id AS v FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c) AND x.doc_id <> y.doc_id),
reach AS (SELECT DISTINCT doc_id AS u, doc_id AS v FROM d UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.component_id, d.doc_id = least.component_id AS kept FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN least ON least.u = d.doc_id
"""
