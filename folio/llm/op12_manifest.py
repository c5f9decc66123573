"""A Merkle manifest of a dataset: leaves by row, a tree for each group, one tree over the groups' roots, and for every
row the proof that it is in the dataset.

Rows are dealt by range of (group, order), so a group of any size lies over many tasks; each task numbers its rows by
group, and the tasks' counts give every row its place. A group's places are cut into aligned blocks of
``fanout ** LEVELS`` rows: a block's tree doesn't depend on the other blocks. In a block the digests are one contiguous
matrix of 64-byte hex strings; a level is the matrix of ``fanout`` digests a row, hashed row by row, and every sibling
is found by index arithmetic. The blocks' roots are the next table, some thousandth of the first, until each group has
one root; these are the leaves of the top tree. Then the paths come down: a block gets its root's path once and each of
its rows its own part below.

A digest is the lowercase hex sha256 of the concatenation of what it covers. A row's leaf covers its fields, each ``-``
if null, else the value's bytes in UTF-8, ``:`` and the value, so no two rows have equal inputs. While a tree has more
than one node, every ``fanout`` consecutive nodes, the last run shorter or even one, become the digest of their digests.

Null groups come first and are a group of their own, apart from the empty string; null ids come first in their group;
rows that repeat an id stand in the order of their leaves, and whole rows that repeat have a place each. A text of any
length is hashed by the JVM alone. An empty table has no root and gives no rows. Only the columns named are read; others
never clash with the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import Scratch

FANOUT, LEVELS = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "grp string, pos long, size long, node binary"
_PATHS = "grp string, pos long, before array<string>, after array<string>, subroot string, root string"
_PROOFS = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row's values, as binary."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hexed(nodes: pa.Array) -> np.ndarray:
    """Binary digests of 32 bytes as a contiguous matrix of 64 hex characters a row."""
    raw = np.frombuffer(b"".join(nodes.to_pylist()), dtype=np.uint8)
    return np.frombuffer(raw.tobytes().hex().encode(), dtype=np.uint8).reshape(-1, 64)


def block_levels(leaves: np.ndarray, depth: int, fanout: int) -> list[np.ndarray]:
    """The matrices of a block's levels, leaves first."""
    levels = [leaves]
    for _ in range(depth):
        below = levels[-1]
        whole = len(below) // fanout
        runs = below[: whole * fanout].reshape(whole, fanout * 64)
        found = [_digest(r.tobytes()) for r in runs]
        if len(below) > whole * fanout:
            found.append(_digest(below[whole * fanout :].tobytes()))
        levels.append(np.frombuffer(b"".join(found), dtype=np.uint8).reshape(-1, 64))
    return levels


def depth_of(size: int, fanout: int, most: int) -> int:
    """Levels above a tree's ``size`` leaves that a block of ``most`` levels holds."""
    depth = 0
    while size > 1 and depth < most:
        size = -(-size // fanout)
        depth += 1
    return depth


def siblings(levels: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Per leaf and level: the run's other digests (empty where the run is short), and how many stand before it."""
    m, depth = len(levels[0]), len(levels) - 1
    others, places = np.zeros((m, depth, fanout - 1), dtype="S64"), np.zeros((m, depth), dtype=np.int64)
    at = np.arange(m)
    for k in range(depth):
        digests = np.ascontiguousarray(levels[k]).view("S64").ravel()
        place = at % fanout
        for s in range(fanout - 1):
            other = at - place + s + (s >= place)
            there = other < len(digests)
            others[there, k, s] = digests[other[there]]
        places[:, k] = place
        at = at // fanout
    return others, places


def _numbered(rows: DataFrame, order: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with pos (place in its group by ``order``, from 0) and size (rows of the group)."""
    names = rows.columns
    sort = ["grp", *order, "tie"]  # rows alike in all else are dealt out by any number
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort).select(*names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, before = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n, groups = batch.num_rows, batch.column(batch.schema.get_field_index("grp"))
            if not n:
                continue
            opens = np.ones(n, dtype=bool)
            opens[1:] = pc.not_equal(groups[1:], groups[:-1]).to_numpy(zero_copy_only=False)
            opens[0] = groups[0].as_py() != last
            starts = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
            at = np.where(starts < 0, before + np.arange(n), np.arange(n) - starts)
            last, before = groups[-1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(at, pa.int64())], names=[*batch.schema.names, "part", "at"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    counted = scratch.save(ranged.mapInArrow(number, f"{schema}, part int, at long"), name)
    by_group = Window.partitionBy("grp")
    parts = counted.groupBy("grp", "part").agg(F.count("*").alias("n"))  # a row a task, and one a group that it holds whole
    parts = parts.select("grp", "part", (F.sum("n").over(by_group.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(by_group).alias("size"))
    return counted.join(parts, ["grp", "part"]).select(*names, (F.col("before") + F.col("at")).alias("pos"), "size")


def _upward(nodes: DataFrame, scratch: Scratch, name: str, fanout: int, height: int) -> list[DataFrame]:
    """Tables of nodes (grp, pos, size, node): the given one, then the roots of its blocks, until each group has one."""

    def roots(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        size = table.column("size")[0].as_py()
        levels = block_levels(hexed(table.column("node")), depth_of(size, fanout, height), fanout)
        root = bytes.fromhex(levels[-1][0].tobytes().decode())
        return pa.table({"grp": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "size": pa.array([-(-size // fanout**height)], pa.int64()), "node": pa.array([root], pa.binary())})

    tables = [nodes]
    while (tables[-1].agg(F.max("size")).first()[0] or 1) > 1:
        blocked = tables[-1].select("grp", F.expr(f"pos div {fanout**height}").alias("block"), "pos", "size", "node")
        tables.append(scratch.save(blocked.groupBy("grp", "block").applyInArrow(roots, _NODES), f"{name}-{len(tables)}"))
    return tables


def _block_paths(table: pa.Table, fanout: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    size = table.column("size")[0].as_py()
    return siblings(block_levels(hexed(table.column("node")), depth_of(size, fanout, height), fanout), fanout)


def _split(others: np.ndarray, places: np.ndarray) -> tuple[list[str], list[str]]:
    """Per level what stands before and after a node, as strings."""
    both = [(b"".join(row[:p]).decode(), b"".join(row[p:]).decode()) for row, p in zip(others.tolist(), places.tolist(), strict=True)]
    return [b for b, _ in both], [a for _, a in both]


def _downward(tables: list[DataFrame], paths: DataFrame, scratch: Scratch, name: str, fanout: int, height: int) -> DataFrame:
    """Paths of the nodes of tables[0], given those of the roots in the last table."""

    def extend(table: pa.Table, above: pa.Table) -> pa.Table:
        table, (up,) = table.sort_by("pos"), above.to_pylist()
        others, places = _block_paths(table, fanout, height)
        out = []
        for i, pos in enumerate(table.column("pos").to_pylist()):
            before, after = _split(others[i], places[i])
            out.append({"grp": up["grp"], "pos": pos, "before": before + up["before"], "after": after + up["after"], "subroot": up["subroot"], "root": up["root"]})
        return pa.Table.from_pylist(out, pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]))

    for k in range(len(tables) - 2, -1, -1):
        blocked = tables[k].withColumn("block", F.expr(f"pos div {fanout**height}"))
        paths = scratch.save(blocked.groupBy("grp", "block").cogroup(paths.groupBy("grp", "pos")).applyInArrow(extend, _PATHS), f"{name}-paths-{k}")
    return paths


def _proofs(rows: DataFrame, paths: DataFrame, fanout: int, height: int) -> DataFrame:
    """Proofs of the rows (grp, pos, size, id, node, changed) of blocks whose roots' paths are given."""

    def prove(table: pa.Table, above: pa.Table) -> pa.Table:
        table, (up,) = table.sort_by("pos"), above.to_pylist()
        others, places = _block_paths(table, fanout, height)
        uppers = [(b.encode(), a.encode()) for b, a in zip(up["before"], up["after"], strict=True)]
        tail = b"".join(b + a for b, a in uppers)
        given = np.ascontiguousarray(hexed(table.column("changed"))).view("S64").ravel().tolist()
        proofs, folded = [], []
        for mine, at, value in zip(others.tolist(), places.tolist(), given, strict=True):
            proofs.append(hashlib.sha256(b"".join([d for run in mine for d in run]) + tail).hexdigest())
            for run, p in zip(mine, at, strict=True):
                value = _digest(b"".join([*run[:p], value, *run[p:]]))
            for before, after in uppers:
                value = _digest(before + value + after)
            folded.append(value.decode())
        n = len(proofs)
        leaves = np.ascontiguousarray(hexed(table.column("node"))).view("S64").ravel().astype("U64").tolist()
        return pa.table({"id": table.column("id"), "leaf": pa.array(leaves, pa.string()), "subroot": pa.array([up["subroot"]] * n, pa.string()), "root": pa.array([up["root"]] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})

    blocked = rows.withColumn("block", F.expr(f"pos div {fanout**height}"))
    return blocked.groupBy("grp", "block").cogroup(paths.groupBy("grp", "pos")).applyInArrow(prove, _PROOFS)


def manifest(docs: DataFrame, scratch: Scratch, fields: Sequence[str] = FIELDS, ident: str = "doc_id", group: str = "source", changed: Mapping[str, Column] | None = None, fanout: int = FANOUT, height: int = LEVELS) -> DataFrame:
    """Per row of docs: ``ident``, leaf, subroot (of its group), root, proof_sha256 (of all siblings from the leaf up),
    folded_root (from the row as it is now and the siblings as they were) and verified (equals root).

    ``changed`` gives fields as they are now, for rows that may have been tampered with since the manifest was made. A task
    hashes blocks of ``fanout ** height`` rows."""
    now = {**{f: F.col(f"`{f}`") for f in fields}, **(changed or {})}
    group_key = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = docs.select(group_key.alias("grp"), F.col(f"`{ident}`").cast("long").alias("id"), leaf([F.col(f"`{f}`") for f in fields]).alias("node"), leaf([now[f] for f in fields]).alias("changed"))
    placed = scratch.save(_numbered(rows, ["id", "node"], scratch, "numbered"), "leaves")
    scratch.drop("numbered")
    trees = _upward(placed.select("grp", "pos", "size", "node"), scratch, "group", fanout, height)
    subroots = trees[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "node")
    top = scratch.save(_numbered(subroots, ["of"], scratch, "numbered-top"), "subroots")
    tops = _upward(top.select("grp", "pos", "size", "node"), scratch, "top", fanout, height)
    root = F.lower(F.hex("node"))
    none = F.array().cast("array<string>")
    paths = _downward(tops, tops[-1].select("grp", "pos", none.alias("before"), none.alias("after"), root.alias("subroot"), root.alias("root")), scratch, "top", fanout, height)
    named = top.select("pos", F.col("of"), root.alias("own")).join(paths.drop("grp", "subroot"), "pos")
    paths = scratch.save(named.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "before", "after", F.col("own").alias("subroot"), "root"), "subroot-paths")
    proofs = _proofs(placed, _downward(trees[1:], paths, scratch, "group", fanout, height), fanout, height)
    return proofs.withColumnRenamed("id", ident).withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines(text: str = "text", ident: str = "doc_id") -> Column:
    """The query's tampering: the text without its line ends where 2 divides the id's crc32."""
    hit = F.crc32(F.col(ident).cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the manifest of documents by source, with the proofs of rows half of which were tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    return manifest(docs, Scratch(spark, "op12"), changed={"text": without_newlines()})


SQL = r"""
WITH RECURSIVE field AS (
  SELECT *, CASE WHEN list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda v, b: list_reduce(list_prepend(xor(v, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda w, k: CASE WHEN w % 2 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END)) % 2 = 1
    THEN replace(text, chr(10), '') ELSE text END AS now
  FROM documents),
base AS (
  SELECT doc_id, source, text, now,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head
  FROM field),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS changed FROM base),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
up AS (
  SELECT source, 0 AS lv, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT source, any_value(lv) + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY source, pos // 3),
subroots AS (
  SELECT source, lv AS height, node AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS place, count(*) OVER () AS n_sources FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lv, place AS pos, n_sources AS n, subroot AS node FROM subroots
  UNION ALL
  SELECT any_value(lv) + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY pos // 3),
nodes AS (
  SELECT p.doc_id, p.leaf, p.pos AS own, p.source, u.lv, u.pos, u.node, (p.pos // power(3, u.lv)::BIGINT) AS mine FROM placed p
    JOIN up u ON u.source IS NOT DISTINCT FROM p.source AND u.n > 1 AND u.pos // 3 = p.pos // power(3, u.lv + 1)::BIGINT
  UNION ALL
  SELECT p.doc_id, p.leaf, p.pos, p.source, s.height + t.lv, t.pos, t.node, s.place // power(3, t.lv)::BIGINT FROM placed p
    JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN top t ON t.n > 1 AND t.pos // 3 = s.place // power(3, t.lv + 1)::BIGINT),
steps AS (
  SELECT source, own, lv, coalesce(string_agg(node, '' ORDER BY pos) FILTER (WHERE pos < mine), '') AS l, coalesce(string_agg(node, '' ORDER BY pos) FILTER (WHERE pos > mine), '') AS r
  FROM nodes GROUP BY source, own, lv),
fold AS (
  SELECT source, pos, 0 AS lv, changed AS v, '' AS proof FROM placed
  UNION ALL
  SELECT f.source, f.pos, f.lv + 1, sha256(s.l || f.v || s.r), f.proof || s.l || s.r FROM fold f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.own = f.pos AND s.lv = f.lv),
ends AS (
  SELECT source, pos, arg_max(v, lv) AS folded_root, sha256(arg_max(proof, lv)) AS proof_sha256 FROM fold GROUP BY source, pos)
SELECT p.doc_id, p.leaf, s.subroot, t.node AS root, e.proof_sha256, e.folded_root, e.folded_root = t.node AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN ends e ON e.source IS NOT DISTINCT FROM p.source AND e.pos = p.pos
JOIN top t ON t.n = 1
"""
