import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from folio.llm import op4_bpe as B, op9_repair as R
from folio.llm.store import Scratch

from .fixtures import corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["'s", " ", "  ", "\n", "\t", " ", "é", "word", " the", "12", "!", "<|endoftext|>", "日本", "x" * 300, "ab" * 200, "\U0001f600", "'ll"]), max_size=12).map("".join))
def test_encoding_is_the_librarys(text):
    bpe, chunked = B.load(PATH), R.ChunkEncoder.__new__(R.ChunkEncoder)
    found = np.frombuffer(bpe.encode(text), "<u4")
    assert found.tolist() == ids(text)
    assert bpe.texts.join(found, np.array([0, len(found)]))[0].decode("utf-8", "replace") == LIBRARY.decode(ids(text), skip_special_tokens=False)
    del chunked
    assert np.frombuffer(R.load(PATH).encode([text])[0], "<u4").tolist() == ids(text)


def test_digests(spark):
    rows, *_ = corpus()
    out = B.decode(B.encode(frame(spark, rows), PATH), PATH)
    found = out.select("doc_id", "n_tokens", "ids_sha256", "decoded").collect()
    assert len(found) == len(rows)
    want = {d: t or "" for d, t in rows}
    for r in found:
        expected = ids(want[r["doc_id"]])
        assert r["n_tokens"] == len(expected) and r["decoded"] == want[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
    assert B.encode(frame(spark, []), PATH).count() == 0


def test_words_marks_and_line_ends_are_encoded_once(monkeypatch):
    encoder, marks = R.ChunkEncoder(PATH), [",", ".", "!?", ""]
    texts = [f"Straße{a} größe{b} wörd{a}\nStraße{b}\nwörd" for a in marks for b in marks] + ["a\n b", "\na", "a\n", " a", "5\n\nx", None, "a\u00a0 b", "x<|endoftext|>,", "don't\n's"]
    want = [np.array(ids(t), dtype="<u4").tobytes() for t in texts]
    assert encoder.encode(texts[:16]) == want[:16]
    assert set(encoder.known) == {"Straße", " größe", " wörd", "wörd", "\n", *marks[:3]}  # not one for each word with its marks
    monkeypatch.setattr(R, "CACHE_ENTRIES", 2)
    assert all(encoder.encode(texts) == want for _ in range(3))
    assert encoder.encode([]) == []


def test_shards_read_back_in_order(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARD_IDS", 3000)
    rows, *_ = corpus()
    rows = [*rows, (None, "null id"), (-5, "first")]
    shards = R.write_shards(frame(spark, rows), PATH, Scratch(spark, "t9"))
    found = R.read_shards(shards).collect()
    by = {}
    for d, t in rows:
        by.setdefault(d, []).append(np.array([*ids(t), 0], dtype="<u4"))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((str(d), len(a), zlib.crc32(a.tobytes())) for d, x in by.items() for a in x)
    at = 0
    for r in sorted(found, key=lambda r: (r["start"])):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert R.read_shards(R.write_shards(frame(spark, []), PATH, Scratch(spark, "t9"))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=200), min_size=1, max_size=8))
def test_grammar_round_trip(documents):
    flat = np.array([x for d in documents for x in d], dtype="<u4")
    starts = np.concatenate([[0], np.cumsum([len(d) for d in documents])])
    shard = R.Shard(R.pack(list(range(len(documents))), flat, starts, 7))
    for i, d in enumerate(documents):
        assert shard.document(i).tolist() == d and shard.document(i, 2, 9).tolist() == d[2:9]


def test_frequent_pairs_become_rules():
    flat = np.array([1, 2, 3] * 200, dtype="<u4")
    rules, symbols, _ = R.compress(flat, np.array([0, 600]), 10)
    assert len(rules) >= 2 and len(symbols) < 420
    with pytest.raises(ValueError):
        R.Shard(b"x" * 40)
