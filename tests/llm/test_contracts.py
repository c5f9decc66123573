"""Each query over a small folder with null ids, repeated rows, ties, empty, word-less and very long texts, and columns
whose names clash: names, types, held-out rows and values, against brute-force versions and the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import queries as Q

from .fixtures import corpus, lowered, words
from .test_near_and_substring import brute, shingles

ITEM = " ".join(f"item{i}" for i in range(20))
TYPES = {
    "op2_substring": {"doc_id": "bigint"}, "op7_decontaminate": {"doc_id": "bigint", "item_id": "bigint"}, "op5_html": {"page_id": "bigint", "text": "string"},
    "op1_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op3_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}, "op4_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6_suffix_tree": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}, "op9_repair": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op11_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op12_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op13_filter_audit": {"part": "string", "filter_order": "string", "step": "int", "kept": "bigint", "removed": "bigint", "redundant": "bigint", "unique_fails": "bigint", "good_lost": "bigint", "toxic_lost": "bigint", "shapley": "bigint"},
    "op10_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


def folder(spark, path, rows):
    docs = spark.createDataFrame([(d, t, None if t is None or (d or 0) % 9 == 4 else "xx" if (d or 0) % 2 else "yy", "s") for d, t in rows], "doc_id long, text string, lang string, source string")
    clashing = docs.withColumn("n_chars", F.length("text").cast("long")).selectExpr("*", "'x' as score", "1 as n_tokens", "2L as text_hash", "'k' as key", "'g' as `group`", "true as kept")
    clashing.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(d, 1 if d % 5 == 0 else 0) for d, _ in rows if d is not None and d % 4] + [(8, None), (None, 1), (5, 0)]
    spark.createDataFrame([(d, 3, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "tiny item"), (5, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(1, "u", "<p>Hello <b>World</b>"), (2, "u", None), (3, None, ""), (1, "u", "<p>Hello <b>World</b>"), (None, "u", "<p hidden>no</p>yes"), (4, "u", "<div>" * 3000 + "deep")]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as n_lines").write.parquet(f"{path}/pages.parquet")


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rows, *_ = corpus(4, 30)
    rng = random.Random(9)
    rows += [(None, "null id of its own words here and there"), (None, "null id of its own words here and there"), (None, None), (7, "another text of a repeated doc_id"), (500, f"head {ITEM} tail"), (501, "here a tiny item stands"), (502, "<|endoftext|> a  b c é ''it's 12345 ###"), (503, "x" * 70_000), (504, "word, " * 20_000 + " ".join(f"w{rng.random()}" for _ in range(2000)))]
    path = str(tmp_path_factory.mktemp("contract"))
    folder(spark, path, rows)
    return rows, path


@pytest.fixture(scope="module")
def results(spark, given):
    found = {}
    for name, query in Q.queries().items():
        df = query(spark, given[1])
        types = dict(df.dtypes)
        assert TYPES[name].items() <= types.items(), name
        found[name] = df.collect()
    return found


@pytest.mark.parametrize("name", sorted(set(TYPES) - {"op2_substring", "op7_decontaminate", "op5_html", "op13_filter_audit"}))
def test_every_row_of_documents_has_one(given, results, name):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in results[name]) == sorted((d is None, d or 0) for d, _ in given[0])


@pytest.mark.parametrize(("name", "modulus", "rest"), [("op6_suffix_tree", 7, 2), ("op8_toxicity", 3, 1), ("op10_langid", 4, 2)])
def test_held_out_rows(results, name, modulus, rest):
    for r in results[name]:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)


def test_near_duplicates_match_brute_force(given, results):
    rows = [(d, t) for d, t in given[0] if d is not None and d not in (503, 504)]
    want = brute([*rows, (503, "other"), (504, "texts")], 4)
    found = {(r["doc_id"], r["component_id"]) for r in results["op3_minhash"] if r["doc_id"] is not None}
    assert found == set(want.items())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in results["op3_minhash"])
    assert sorted(r["n_shingles"] for r in results["op3_minhash"]) == sorted(len(shingles(t, 4)) for _, t in given[0])


def test_ids_are_the_librarys(given, results):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    ids = {(d, t): library.encode(t or "", add_special_tokens=False).ids for d, t in given[0]}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(d), len(ids[d, t]), sha(",".join(map(str, ids[d, t]))), sha(library.decode(ids[d, t], skip_special_tokens=False))) for d, t in given[0])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in results["op4_bpe"]) == want
    crc = sorted((str(d), len(ids[d, t]) + 1, zlib.crc32(np.array([*ids[d, t], 0], dtype="<u4").tobytes())) for d, t in given[0])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in results["op9_repair"]) == crc
    ordered = sorted(results["op9_repair"], key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()
    known = [r["doc_id"] for r in ordered if r["doc_id"] is not None]
    assert known == sorted(known)


def test_toxicity_is_cut_at_seven_tenths(given, results):
    empty = {d for d, t in given[0] if not words(t)}
    for r in results["op8_toxicity"]:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    low = min(r["score"] for r in results["op8_toxicity"])
    assert all(r["score"] == low for r in results["op8_toxicity"] if r["doc_id"] in empty - {None})


def test_languages_are_learnt_ones(given, results):
    letters = {}
    for d, t in given[0]:
        letters.setdefault(d, []).append(any(c.isalpha() for c in t or ""))
    for r in results["op10_langid"]:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {"xx", "yy", "und"}
        if not any(letters[r["doc_id"]]):
            assert r["lang_pred"] == "und"


def test_items_are_found_by_their_shingles(given, results):
    want = set()
    for d, t in given[0]:
        for item, text in ((1, ITEM), (4, "tiny item"), (5, ITEM)):
            k = min(5, len(text.split()))
            mine, whole = shingles(text, k), shingles(t, k) if len(words(lowered(t))) >= k else set()
            if 100 * len(mine & whole) >= 80 * len(mine):
                want.add((d, item))
    assert {(r["doc_id"], r["item_id"]) for r in results["op7_decontaminate"]} == want == {(500, 1), (500, 5), (501, 4)}


def test_pages_are_told_as_read(results):
    assert sorted((str(r["page_id"]), r["text"]) for r in results["op5_html"]) == sorted([("1", "Hello World")] * 2 + [("2", ""), ("3", ""), ("None", "yes"), ("4", "deep")])


def test_repeated_passages_are_those_of_brute_force(given, results):
    """Every run of 51 words that stands in a document with a smaller id is cut, and whatever is cut stands elsewhere."""
    first, texts = {}, {}
    for d, t in sorted({(d, t) for d, t in given[0] if d is not None and t}):
        texts.setdefault(d, []).append(words(lowered(t)))
        w = words(lowered(t))
        for i in range(len(w) - 50):
            first.setdefault(tuple(w[i : i + 51]), d)
    found = {r["doc_id"]: r for r in results["op2_substring"]}
    for d, lists in texts.items():
        for w in lists:
            if any(first[tuple(w[i : i + 51])] < d for i in range(len(w) - 50)):
                assert d in found
    for d, r in found.items():
        assert all(k < d for k in r["kept_in"]) and r["n_words_removed"] == sum(s["end"] - s["start"] for s in r["spans"])
        near = [brute([(k, " ".join(w[s["start"] : s["end"]])) for k, w in enumerate([texts[d][0]])], 5) for s in r["spans"]]
        assert near
        for s in r["spans"]:
            mine = shingles(" ".join(texts[d][0][s["start"] : s["end"]]), 5) if len(texts[d]) == 1 else None
            held = set().union(*(shingles(" ".join(w), 5) for k in r["kept_in"] for w in texts[k]))
            assert mine is None or 100 * len(mine & held) >= 80 * len(mine)


def test_queries_over_empty_tables(spark, tmp_path, given):
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{given[1]}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in Q.queries().items():
        df = query(spark, str(tmp_path))
        assert TYPES[name].items() <= dict(df.dtypes).items() and df.count() == 0, name
