from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from folio.llm import op1_quality as Q, op5_html as H, op7_decontaminate as D

from ..compare import spark_rows, sql_rows
from .fixtures import corpus, frame, lowered, words


def counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark):
    rows, *_ = corpus()
    rows += [(500, "a b c d e a b c d e"), (501, "# $$ <x> | &"), (502, "x y \x1c z"), (503, "l1\n l1\nl1\nl1\n\n \n")]
    found = Q.judged(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        want = counts(text[r["doc_id"]])
        assert tuple(r[c] for c in Q.REPORTED) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (not r["kept"] or not r["base_failed"])
    assert Q.judged(frame(spark, [])).count() == 0


def test_order_changes_work_and_not_verdicts(spark):
    rows, *_ = corpus()
    df = frame(spark, rows)
    costs = {r.name: (1.0, 0.1 * i) for i, r in enumerate(Q.RULES)}
    assert [r.name for r in Q.ordered(Q.RULES, costs)][0] == Q.RULES[-1].name
    kept = lambda rules: {(r["doc_id"], r["failed_rule"] is None) for r in Q.cascade(df, rules).select("doc_id", "failed_rule").collect()}
    assert kept(Q.RULES) == kept(Q.RULES[::-1])


def test_no_python_in_the_plan(spark, data):
    plan = Q.query(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_sql(spark, data):
    assert spark_rows(Q.query(spark, data)) == sql_rows(Q.SQL, data)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<ul><li>x<li>y</ul>", "- x\n- y"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"), ("<p hidden>no<p>yes", "yes"), ("<div style='display:none'>no</div>yes", "yes"), ("<script>a<b</script>x<style>y</style>", "x"),
    ("a &amp; b&nbsp;&copy;", "a & b ©"), ("<pre>\n x\n  y</pre>", " x\n  y"), ("<b>a</b> <i>b</i>", "a b"), ("x<!-- <p>no -->y", "xy"), ("<!-- open", ""), ("</p></div>x", "x"), ("a < b", "a < b"), ("<a href='x>y'>t</a>", "t"),
    ("<head><title>t</title></head><body>b</body>", "b"), ("<blockquote>q</blockquote>", "  q"), ("<dl><dt>a<dd>b</dl>", "a\n  b"),
])
def test_rendering(page, text):
    assert H.render(page) == text


def test_deep_nesting_and_long_pages(spark):
    assert H.render("<div>" * 20000 + "x") == "x"
    assert H.render("<ul><li>" * 3000 + "y").endswith("y")
    rows = [(1, "u", "<p>x" * 20000), (2, "u", None), (2, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as n_lines")
    found = H.extract(df).collect()
    assert len(found) == 3 and {r["n_lines"] for r in found} == {39999, 0} and H.extract(df.limit(0)).count() == 0


def test_all_visible_words_of_real_pages(spark, data):
    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, text):
            if not self.skip:
                self.out += text.split()

    for r in spark.read.parquet(f"{data}/pages.parquet").limit(60).collect():
        p = Words()
        p.feed(r["html"])
        p.close()
        assert "".join(x for x in H.render(r["html"]).split() if x != "-") == "".join(x for x in p.out if x != "-")


def test_containment_matches_brute_force(spark):
    rows, _, vocabulary = corpus()
    text = dict(rows)
    items = [(1, " ".join(text[3].split()[10:40])), (2, " ".join(text[4].split()[:12])), (3, None), (4, ""), (5, "one two"), (6, " ".join([*text[6].split()[:30], "zz", "yy"])), (7, "not anywhere at all in these texts"), (8, text[408]), (1, " ".join(text[3].split()[10:40]))]

    def grams(t, k):
        w = words(lowered(t))
        k = min(k, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    want = set()
    for i, t in items:
        g = grams(t, 5)
        width = min(5, len(words(t or "")))
        for d, x in rows:
            held = {tuple(words(lowered(x))[j : j + width]) for j in range(len(words(lowered(x))) - width + 1)} if g else set()
            if g and 100 * len(g & held) >= 80 * len(g):
                want.add((d, i, len(g), len(g & held)))
    frame_items = spark.createDataFrame(items, "item_id long, text string")
    found = D.contained(frame(spark, rows), frame_items).collect()
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_common"]) for r in found} == want
    clean = D.decontaminate(frame(spark, rows), frame_items)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _ in rows if d not in {w[0] for w in want})
    assert D.contained(frame(spark, []), frame_items).count() == 0 and D.contained(frame(spark, rows), frame_items.limit(0)).count() == 0
