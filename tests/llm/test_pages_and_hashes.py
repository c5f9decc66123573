import html.parser
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import op5_html as H, op9_repair as R, words as W
from folio.llm.bits import held


@pytest.mark.parametrize(("page", "text"), [
    ("<div>" * 450 + "<p hidden>SECRET</p>shown" + "</div>" * 450 + "end", "shown\nend"),
    ("<div>" * 450 + "<span style='visibility:hidden'>no</span>yes", "yes"),
    ("<p>a <math><mi>x</mi><mo>+</mo><mn>1</mn></math>", "a x+1"),
    ("<select><option>one<option selected>two<option>three</select>", "two"),
    ("<select><option>one<option>two</select> <select multiple><option>a<option>b</select>", "one a b"),
    ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</div>", "yes"),
    ("<svg><title>no</title><text>axis</text><desc>no</desc></svg>", "axis"),
    ("a < b <c>d</c> <!-- x > y --> e", "a < b d e"),
    ("<p title='never closed>first <b>second</b>", "first second"),
    ("<textarea>a <b>c</textarea><script>x</script>", "a <b>c"),
    ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n\n  3. c"),
])
def test_what_a_reader_sees(page, text):
    assert H.render(page) == text


@pytest.mark.parametrize("page", ['<a b="x', "<!--", "<b", "<i>x</b>", "</p>", '<a href="q">', "<div>", "<"])
def test_time_grows_with_the_page(page):
    took = []
    for n in (100_000, 400_000):
        began = time.process_time()
        H.render(page * (n // len(page)))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


class Words(html.parser.HTMLParser):
    """All words outside raw elements, by another parser."""

    def __init__(self):
        super().__init__()
        self.raw, self.words = 0, []

    def handle_starttag(self, tag, attributes):
        self.raw += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style", "title") and self.raw > 0

    def handle_data(self, data):
        if not self.raw:
            self.words += data.split()


def test_all_pages_keep_their_words(spark, data):
    for r in spark.read.parquet(f"{data}/pages.parquet").select("html").collect():
        other = Words()
        other.feed(r["html"] or "")
        other.close()
        left = sorted(w for w in other.words)
        mine = sorted(w for w in H.render(r["html"]).split() if not w.rstrip(".").isdigit() and w != "-")
        assert [w for w in left if not w.rstrip(".").isdigit() and w != "-"] == mine


def test_words_are_hashed_alike_in_any_text(monkeypatch):
    monkeypatch.setattr(W, "SEGMENT", 64)
    rng, seen = random.Random(1), {}
    for _ in range(2000):
        text = "".join(rng.choice("ab é \n\tx") for _ in range(rng.randint(0, 300))).encode()
        found = W.text_hashes(text)
        assert len(found) == len(text.split())
        for word, h in zip(text.split(), found.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(W.text_hashes(b"a" * 500 + b" b")) == 2 and len(W.text_hashes(b" " * 300)) == 0


def test_slices_of_batches_are_bounded_by_bytes():
    texts = [b"x" * n for n in (10, 900, 2000, 5, 5, 5)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.binary())], names=["i", "text"])
    found = [(b.column(0).to_pylist(), t) for b, t in W.chunks(iter([batch]), "text", 1000)]
    assert [i for i, _ in found] == [[0, 1], [2], [3, 4, 5, 6]] and [t for _, ts in found for t in ts] == texts


def test_bit_maps_miss_nothing():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    words = np.zeros(1 << 10, dtype=np.int64)
    place = keys >> np.uint64(48)
    np.bitwise_or.at(words, (place >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (place & np.uint64(63))).view(np.int64))
    assert held(words, keys).all()
    assert held(words, np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64)).mean() < 0.2


def test_rules_are_made_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    phrase = rng.integers(1, 50_000, 64)
    docs = [np.concatenate([phrase, rng.integers(1, 50_000, 5), [0]]) for _ in range(80)]
    ids, starts = np.concatenate(docs).astype(np.uint32), np.cumsum([0, *map(len, docs)])
    rules, symbols, places = R.compress(ids, starts, 50_257)
    pairs = [p for a, b in zip(places, places[1:], strict=False) for p in zip(symbols[a:b], symbols[a + 1 : b], strict=False)]
    assert max(pairs.count(p) for p in set(pairs)) < R.MIN_COUNT and len(symbols) < 80 * 9
    shard = R.Shard(R.pack(list(range(80)), ids, starts, 50_257))
    assert (shard.expand(shard.symbols) == ids).all() and (shard.document(7) == docs[7]).all() and (shard.document(7, 10, 30) == docs[7][10:30]).all()
    wide = R.Shard(R.pack(list(range(80)), ids, starts, 70_000))  # symbols beyond 16 bits
    assert (wide.expand(wide.symbols) == ids).all()
