"""Token counts, manifests and filter audits against the library and brute force, on tables with every awkward row."""

import hashlib
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folio.llm import op11_token_counts as C, op12_manifest as M, op13_filter_audit as A
from folio.llm.store import Scratch

from .fixtures import corpus, frame, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
PARTS = [" ", "  ", "\n", "\t", "\r", "▁", "word", "Word,", "the", "12", "3.5", "²", "é", "е́", "日本語", "<s>", "</s>", "<unk>", "<0x41>", ");", "ab" * 50, "\U0001f600", "-" * 90, " ", "\x00", "̀"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_pieces_of_pretokens_add_up(text):
    pieces = C._load(MODEL)
    pretokens = [t for c in C.chunks(text) for t in pieces.pattern.findall(c)]
    assert "".join(pretokens) == (" " + text.replace("▁", " ") if text else "")
    assert sum(pieces.counts(pretokens)) == len(LIBRARY.encode(text))


@pytest.mark.parametrize("head", [0, 40, C.HEAD])
def test_counts_are_the_librarys(spark, head):
    rows, *_ = corpus(5, 40)
    rows += [(None, "null id"), (None, None), (600, "-" * 5000 + " end"), (601, "x" * 40_000), (602, "a ▁b  c \n d"), (603, " " * 70), (600, "-" * 5000 + " end")]
    given = frame(spark, rows).selectExpr("*", "'c' as n_bytes", "'d' as `odd.name`", "7 as row", "8 as kept")
    out = C.count(given, MODEL, Scratch(spark, "t11"), keep=("doc_id", "odd.name", "row", "n_bytes"), head=head, limit=300)
    assert out.columns == ["doc_id", "odd.name", "row", "n_bytes", "n_tokens", "over_limit"]
    found = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"], r["odd.name"], r["row"]) for r in out.collect())
    sizes = [(str(d), len((t or "").encode()), len(LIBRARY.encode(t or ""))) for d, t in rows]
    assert found == sorted((*s, s[2] > 300, "d", 7) for s in sizes)


def test_frequent_pretokens_are_few_and_the_rest_is_the_rest(spark):
    rows, *_ = corpus(5, 40)
    known = C.vocabulary(frame(spark, rows), MODEL).cache()
    head, rare = C._frequent(known, 40)
    assert 0 < len(head) <= 40 and len(head) + rare.count() == known.count() == known.select("key").distinct().count()
    assert known.agg(F.sum(F.col("occurrences") * F.col("pieces"))).first()[0] == sum(len(LIBRARY.encode(t or "")) for _, t in rows)


def test_a_model_whose_pieces_lie_across_cuts_is_refused(monkeypatch):
    monkeypatch.setattr(C, "PRETOKEN", r" |[^ ]")
    with pytest.raises(ValueError, match="lies across a cut"):
        C.Pieces(MODEL)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout):
    """Levels of a tree as lists, by the definition."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        run = i // fanout * fanout
        out.append((level[run:i], level[i + 1 : run + fanout]))
        i //= fanout
    return out


def brute_manifest(rows, fanout):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        now = (*r[:4], r[4].replace("\n", "") if hit else r[4])
        groups.setdefault(r[1], []).append((r[0], sha(*map(field, r)), sha(*map(field, now))))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in groups[s]], fanout) for s in order}
    top = climb([trees[s][-1][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for i, (d, own, now) in enumerate(groups[s]):
            steps = path(trees[s], i, fanout) + path(top, k, fanout)
            value = now
            for before, after in steps:
                value = sha(*before, value, *after)
            out.append((str(d), own, trees[s][-1][0], top[-1][0], sha(*[x for b, a in steps for x in b + a]), value, value == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize(("fanout", "height", "n"), [(3, 8, 60), (3, 1, 60), (3, 2, 47), (2, 2, 30), (4, 1, 5), (3, 8, 1)])
def test_manifests_match_brute_force(spark, fanout, height, n):
    texts = [t for _, t in corpus(6)[0]][:n]
    sources = ["hot", "hot", "hot", None, "", "é", "z", "Z", "one"]
    rows = [(i, sources[i % 8], None if i % 5 == 0 else "en", None if i % 7 == 0 else i, t if i % 3 else f"{t}\nline\n" if t else t) for i, t in enumerate(texts)]
    rows += [(None, "hot", "en", 1, "a\nb"), (None, "hot", None, None, None), (2, "hot", "en", 9, "other text\n"), rows[0], rows[0], (900, "one", "-", 1, ""), (901, "10 rows"[:n], None, 3, "x" * 100_000 + "\n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as grp", "'x' as node", "2 as pos", "3 as leaf").repartition(5)
    found = M.manifest(df, Scratch(spark, "t12"), changed={"text": M.without_newlines()}, fanout=fanout, height=height)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found.columns == names
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in found.collect())
    assert got == brute_manifest(rows, fanout)
    assert n == 1 or {g[-1] for g in got} == {True, False}


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert M.manifest(df, Scratch(spark, "t12")).count() == 0


def brute_features(text):
    w = words(text)
    return len(w), len(set(w)), len(text), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text)


TEXTS = st.lists(st.text(alphabet=st.sampled_from("aAbBZ \n\t\x0b#$|é日\U0001f600  ")), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.sampled_from([3, 17, 1 << 20]))
def test_scanned_features(texts, slice_bytes):
    before, A.SLICE_BYTES = A.SLICE_BYTES, slice_bytes
    try:
        data, cuts = A._buffers(pa.array(texts, pa.string()))
        f = A.features(data, cuts)
    finally:
        A.SLICE_BYTES = before
    got = list(zip(*(f[k].tolist() for k in ("words", "distinct", "code_points", "capitals", "symbols")), strict=True))
    assert got == [brute_features(t) for t in texts]


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(A, "_hashes", lambda data, starts, ends: ((ends - starts) % 2).astype(np.uint64))
    texts = ["aa bb aa cc a", "", "a b a", "x"]
    data, cuts = A._buffers(pa.array(texts, pa.string()))
    assert A.features(data, cuts)["distinct"].tolist() == [4, 0, 2, 1]


def test_sliced_columns_keep_their_borders():
    data, cuts = A._buffers(pa.array(["zero", "one two", None, "three"], pa.string()).slice(1, 3).fill_null(""))
    assert data.tobytes() == b"one twothree" and cuts.tolist() == [0, 7, 7, 12]


def brute_audit(rows, labels):
    """Rows (part, order, step, ...) by applying the filters one after the other; rows are (doc_id, source, text)."""
    docs = []
    for d, s, t in rows:
        t = t or ""
        w, distinct, points, capitals, symbols = brute_features(t)
        copy = d is not None and any(e is not None and e < d and (u or "") == t for e, _, u in rows)
        docs.append((s or "", {"A": w < 50, "B": 100 * distinct < 65 * w, "C": 100 * capitals > 5 * points, "D": symbols > 0, "E": copy}, any(i == d and q == 1 for i, q, _ in labels if d is not None), any(i == d and x == 1 for i, _, x in labels if d is not None)))
    out = []
    for part in {p for p, *_ in docs}:
        mine, shapley, found = [x for x in docs if x[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order):
                gone = [x for x in left if x[1][c]]
                before, left = left, [x for x in left if not x[1][c]]
                shapley[c] += len(gone)
                found.append((part, order, k + 1, len(left), len(gone), sum(x[1][c] for x in mine) - sum(x[1][c] for x in before), sum(x[1][c] and sum(x[1].values()) == 1 for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone), c))
        out += [(*f[:-1], shapley[f[-1]]) for f in found]
    return sorted(out)


def test_audit_matches_brute_force(spark):
    texts = corpus(7, 25)[0]
    rows = [(d, ["hot", "hot", None, "", "x"][i % 5], t if i % 4 else t and t.upper() if i % 8 else t and f"{t} #") for i, (d, t) in enumerate(texts)]
    rows += [(None, "hot", rows[1][2]), (None, None, None), (None, "hot", ""), (700, "x", rows[1][2]), (700, "x", rows[1][2]), (-1, "new", rows[1][2]), (-1, "new", rows[1][2]), (-1, "hot", "another text of this id"), rows[3]]
    rows += [(800 + k, "hot", "copy " * 60) for k in range(30)]
    labels = [(d, i % 2, (i // 2) % 2) for i, (d, _, _) in enumerate(rows) if d is not None and i % 3] + [(None, 1, 1), (800, None, None), (801, 1, 0), (801, 0, 1), (-1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as n", "'m' as mask", "2 as good", "3 as quality").repartition(4)
    out = A.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[n] for n in names) for r in out.collect()) == brute_audit(rows, labels)
    assert A.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
