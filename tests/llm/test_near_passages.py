import random

from folio.llm import op2_substring as S, words as W

from .fixtures import frame, sentence


def planted(words, changed, n=60, seed=1):
    """n passages, each once whole and once with words changed, in the middle of other text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    rows = []
    for k in range(n):
        passage = sentence(rng, words, vocabulary).split()
        near = list(passage)
        for c in range(changed):
            near[(c + 1) * words // (changed + 1)] = f"other{c}"
        for half, p in enumerate((passage, near)):
            rows.append((k + 1000 * half, f"{sentence(rng, 40, vocabulary)} {' '.join(p)} {sentence(rng, 40, vocabulary)}"))
    return rows


def test_near_copies_in_mid_line_are_found(spark):
    for words, changed in ((55, 1), (60, 1), (100, 2)):
        found = {r["doc_id"]: r["spans"] for r in S.repeated_spans(frame(spark, planted(words, changed))).collect()}
        told = [d for d in range(1000, 1060) if any(s["kept_in"] == d - 1000 for s in found.get(d, []))]
        assert len(told) == 60 and not any(d < 1000 for d in found)
        for d in told:
            (start, end), *rest = S.merged([(s["start"], s["n_words"]) for s in found[d]])
            assert not rest and 38 <= start <= 40 and 40 + words <= end <= 42 + words


def test_less_alike_passages_stay(spark):
    assert S.repeated_spans(frame(spark, planted(55, 3))).count() == 0  # Jaccard 0.55, no run of 28 words


def test_a_slice_of_texts_is_hashed_at_once():
    texts = [b"", b"one", None, b"A b\nc", b" \n ", b"\n", b"x\x0by z\n"]
    joined, hashes, places, edges = W.joined_hashes(texts)
    for i, t in enumerate(texts):
        assert hashes[edges[i] : edges[i + 1]].tolist() == W.text_hashes((t or b"").lower()).tolist()
    assert [joined[p : p + 1] for p in places.tolist()] == [b"o", b"a", b"b", b"c", b"x", b"y", b"z"]
    words = [b" ".join(b"w%d" % (i * 100 + j) for j in range(n)) for i, n in enumerate((27, 28, 40))]
    texts = [b"\n".join([words[1].upper(), words[0], words[2]]), b"", words[0], b"\n" + words[1].replace(b" ", b"\t ")]
    joined, hashes, places, edges = W.joined_hashes(texts)
    found = [[x.tolist() for x in S._long_lines(joined, places, edges)][k] for k in range(5)]
    assert found[0] == [0, 0, 3] and found[2] == [28, 40, 28] and [f - int(edges[i]) for i, f in zip(found[0], found[1], strict=True)] == [0, 55, 0]
    assert [joined[a:b].split() for a, b in zip(*found[3:], strict=True)] == [words[1].split(), words[2].split(), words[1].split()]
    units = [S._line_unit(hashes[f : f + n]) for f, n in zip(*found[1:3], strict=True)]
    assert units[0] == units[2] != units[1]
