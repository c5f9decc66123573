import math
import os
import random
import zlib
from collections import Counter

from folio.llm import op6_suffix_tree as L, op8_toxicity as X, op10_langid as I
from folio.llm.store import Scratch

from .fixtures import corpus, frame, lowered, words


def test_language_is_told_on_held_out_texts(spark):
    rng = random.Random(1)
    syllables = {"aa": ["tion", "the", "ing"], "bb": ["keit", "und", "sch"], "cc": ["ción", "que", "los"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(20)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = I.train(docs.where("doc_id % 4 <> 2"))
    found = I.predict(docs, model).where("doc_id % 4 = 2").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "é")], "doc_id long, text string").selectExpr("*", "'clash' as lang_pred", "7 as other")
    got = {r["doc_id"]: r for r in I.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in syllables and got[1]["rejected"] and got[1]["other"] == 7
    assert I.predict(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in I.predict(docs.limit(3), I.train(docs.where("false"))).collect()} == {"und"}


def test_base_scores_match_counts(spark):
    rows, *_ = corpus()
    found = L.score_documents(frame(spark, rows), Scratch(spark, "t6")).collect()
    tokens = lambda t: [*words(lowered(t)), None]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        t = tokens(text[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_suffix_tree_beats_single_words_where_context_tells(spark):
    rng = random.Random(5)
    pairs = {f"a{i}": f"b{i}" for i in range(30)}
    rows = [(i, " ".join(f"{k} {pairs[k]}" for k in (rng.choice(list(pairs)) for _ in range(60)))) for i in range(120)]
    found = [r for r in L.score_documents(frame(spark, rows, False), Scratch(spark, "t6b")).collect() if r["held_out"]]
    assert found and all(r["score"] > 0.6 * r["base_score"] for r in found)


def test_language_model_of_nothing(spark):
    assert L.score_documents(frame(spark, [], False), Scratch(spark, "t6c")).count() == 0
    (r,) = L.score_documents(frame(spark, [(1, None)], False), Scratch(spark, "t6d")).collect()
    assert r["n_tokens"] == 1 and math.isfinite(r["score"])


def suffix_tree(texts, least, depth):
    """A brute-force version: the probability of a word after the words before it."""
    runs = Counter()
    for t in texts:
        w = ["<start>", *words(lowered(t)), "<end>"]
        runs.update(tuple(w[i : i + k]) for k in range(1, depth + 2) for i in range(len(w) - k + 1))
    single = {r[0]: n for r, n in runs.items() if len(r) == 1 and r != ("<start>",)}
    total, vocabulary = sum(single.values()), len(single)
    after = {}
    for r, n in runs.items():
        if len(r) > 1 and n >= least:
            after.setdefault(r[:-1], {})[r[-1]] = n

    def p(context, w, ok):
        if not context:
            return (single.get(w, 0) + 1) / (total + vocabulary + 1)
        if not ok(context):
            return p(context[1:], w, ok)
        n, held = runs[context], after[context]
        rest = 1 - sum(x - 0.75 for x in held.values()) / n
        return max(0, held.get(w, 0) - 0.75) / n + rest * p(context[1:], w, ok)

    kept = set()
    for context, held in after.items():
        n, everything = runs[context], lambda c: c in after
        rest = 1 - sum(x - 0.75 for x in held.values()) / n
        gain = sum(x * math.log(p(context, w, everything) / p(context[1:], w, everything)) for w, x in held.items()) + (n - sum(held.values())) * math.log(rest)
        if gain > 0.5 * len(held) * math.log(n + 1):
            kept |= {context[i:] for i in range(len(context))}
    return lambda context, w: p(context, w, kept.__contains__), [*single, "<none>"], kept


def test_scores_are_those_of_a_brute_force_tree(spark):
    rng = random.Random(8)
    links = {w: rng.sample(range(40), 3) for w in range(40)}
    rows = [(None, "w1 w2"), (900, None), (901, ""), (902, "never seen"), (903, "w1 " * 3000)]
    for i in range(150):
        now, t = rng.randrange(40) if rng.random() < 0.1 else 0, []
        for _ in range(rng.randint(5, 60)):
            t.append(f"W{now}" if rng.random() < 0.1 else f"w{now}")
            now = rng.choice(links[now]) if rng.random() < 0.8 else rng.randrange(40)
        rows.append((i, " ".join(t)))
    rows += rows[6:9]
    found = L.score_documents(frame(spark, rows), Scratch(spark, "t6e"), min_count=4, depth=3).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    p, vocabulary, kept = suffix_tree([t for d, t in rows if not held(d)], 4, 3)
    assert {len(c) for c in kept} == {1, 2, 3} and any(c[0] == "<start>" for c in kept)
    for context in list(kept)[:60]:
        assert math.isclose(sum(p(context, w) for w in vocabulary), 1, abs_tol=1e-9)
    want = Counter()
    for d, t in rows:
        w = ["<start>", *words(lowered(t)), "<end>"]
        want[d, round(sum(math.log10(p(tuple(w[max(0, i - 3) : i]), w[i])) for i in range(1, len(w))), 2)] += 1
    assert Counter((r["doc_id"], round(r["score"], 2)) for r in found) == want


def test_blocks_ask_only_for_what_the_tree_holds(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(400))) for i in range(60)]
    scratch = Scratch(spark, "t6f")
    blocks = scratch.save(L.block_table(frame(spark, rows, False)), "blocks")
    words = scratch.save(L.word_table(blocks, 4), "words")
    tree, maps = L.tree_table(blocks, words, 20_000, 31, 4, scratch, min_count=8)
    assert sorted(os.listdir(scratch.root.removeprefix("file://"))) == ["blocks", "tree", "words"]
    held = {r["run"] for r in tree.collect()}
    for batch in blocks.toArrow().to_batches():
        for i in range(batch.num_rows):
            block = L.Block(batch, i, maps)
            keys, _ = L._asked(block)
            assert set(keys.view("i8").tolist()) - set(block.words.view("i8").tolist()) <= held | {0}  # 0: no run


def test_toxic_texts_are_told_on_held_out_rows(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    bad = ["horrible", "wretched", "dreadful", "nastyish"]
    rows, labels = [], []
    for i in range(600):
        t = [rng.choice(plain) for _ in range(120)]
        if i % 3 == 0:
            for _ in range(6):
                t[rng.randrange(len(t))] = rng.choice(bad)
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 3 == 0)))
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = X.train(docs.where("doc_id % 4 <> 1"), lab.where("doc_id % 4 <> 1"))
    found = [r for r in X.score(docs, model).collect() if r["doc_id"] % 4 == 1]
    right = sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in found)
    assert right >= 0.9 * len(found) and all(0 <= r["score"] <= 1 for r in found)
    odd = X.score(frame(spark, [(1, None), (2, ""), (3, " \n"), (4, "x" * 100_000)]), model).collect()
    assert len(odd) == 4 and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in X.score(docs.limit(5), X.train(docs, lab.where("false"))).collect()} == {0.0}
    assert X.score(docs.limit(0), model).count() == 0
