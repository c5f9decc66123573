from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import components as C, op2_substring as S, op3_minhash as M, words as W
from folio.llm.store import Scratch

from .fixtures import corpus, frame, lowered, words


def shingles(text, k):
    w = words(lowered(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t, k))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(d, s) for d, ss in sets.items() for s in ss if s]
    for i, (a, s) in enumerate(flat):
        for b, t in flat[i + 1 :]:
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def test_components_match_brute_force(spark):
    rows, *_ = corpus()
    want = brute(rows, 4)
    found = M.near_duplicates(frame(spark, rows), 4).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in found} == set(want.items())
    sizes = {(d, len(shingles(t, 4))) for d, t in rows}
    assert {(r["doc_id"], r["n_shingles"]) for r in found} == sizes


def test_rest_of_a_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 3)
    rows, *_ = corpus(8, 10)
    base = rows[5][1].split()
    rng = np.random.default_rng(1)
    for k in range(60):
        near = list(base)
        for at in rng.integers(0, len(near), 4 + k % 5):
            near[at] = f"w{rng.integers(50)}"
        rows.append((1000 + k, " ".join(near)))
    found = {(r["doc_id"], r["component_id"]) for r in M.near_duplicates(frame(spark, rows), 4).collect()}
    assert found == set(brute(rows, 4).items())


def test_empty_table_and_null_ids(spark):
    empty = frame(spark, [], False)
    assert M.near_duplicates(empty).count() == 0 and S.repeated_spans(empty).count() == 0 and S.remove(empty).count() == 0
    rows = [(None, "a b c d e f g"), (9, "a b c d e f g"), (None, "q r s t u v w")]
    found = {(r["doc_id"], r["component_id"]) for r in M.near_duplicates(frame(spark, rows), 4).collect()}
    assert found == {(None, 9), (9, 9), (None, None)}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    left, right = a[:2400], a[600:]
    x, y, z = M.sketches([left, right, a])
    assert (M.merge(x, y) == z).all()
    s = M.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([2400.0]), np.array([2400.0]))
    assert abs(s[0] - 0.6) < 0.15


@pytest.mark.parametrize("shape", ["chain", "star", "pairs"])
def test_connected_components(spark, shape):
    n = 60
    edges = {"chain": list(pairwise(range(n))), "star": [(n, i) for i in range(n)], "pairs": [(2 * i, 2 * i + 1) for i in range(n)]}[shape]
    df = spark.createDataFrame(edges, "u long, v long")
    found = {r["node"]: r["component"] for r in C.components(df, Scratch(spark, "t"), "c").collect()}
    want = {x: (0 if shape != "pairs" else x - x % 2) for e in edges for x in e}
    assert found == want


def test_passages_over_fifty_words_are_found_and_clean_documents_stay(spark):
    rows, passage, _ = corpus()
    seen, want = {}, {}
    for d, t in sorted({r for r in rows if r[1]}, key=lambda r: r[0]):
        w = words(lowered(t))
        for i in range(len(w) - 50):
            if seen.setdefault(tuple(w[i : i + 51]), d) != d:
                want.setdefault(d, seen[tuple(w[i : i + 51])])
    found = {r["doc_id"]: r for r in S.repeated_spans(frame(spark, rows)).collect()}
    assert set(want) <= set(found)
    assert {301, 302, 303} <= set(found) and 300 not in found
    clean = {d for d, _ in rows if d < 60 and d not in (5, 7)} | {400, 401, 402, 403, 404, 408}
    assert not clean & set(found)
    for d, first in want.items():
        assert first in {s["kept_in"] for s in found[d]["spans"]}


def test_removed_text_is_the_rest(spark):
    rows, passage, _ = corpus()
    df = frame(spark, rows)
    out = S.remove(df)
    assert out.columns == df.columns and out.count() == len(rows)
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    original = dict(rows)
    assert kept[400] is None and kept[401] == "" and kept[300] == original[300]
    for d in (301, 302, 303):
        left = words(kept[d])
        assert 0 < len(left) < len(words(original[d])) - 27
        assert all(w in words(original[d]) for w in left)


def test_cut_keeps_what_lies_between():
    assert S.cut(b"a b  c d", [(1, 2)]) == b"a d" and S.cut(b"a b", [(0, 2)]) == b"" and S.cut(b" a b c", [(2, 1)]) == b" a b "
    assert S.merged([(5, 2), (0, 3), (3, 1)]) == [(0, 4), (5, 7)]


def test_shingles_agree_with_words():
    for t in (None, "", "a", "A b", "a b c d e", "x\x0by\x1cz é", "a b"):
        assert len(W.shingles(t.encode() if t is not None else None, 4)) == len(shingles(t, 4))
