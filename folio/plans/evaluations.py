"""Queries over evaluation summaries and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V, prefix as P
from .registry import query, table


@query("""WITH s AS (SELECT p_brand AS g, CAST(p_retailprice AS DOUBLE) AS a, CAST(p_size * 20 AS DOUBLE) AS b FROM part), g AS (SELECT g, sum(a) AS a, sum(b) AS b, count(*) AS c, row_number() OVER (ORDER BY g) - 1 AS slot FROM s GROUP BY 1), n AS (SELECT count(*) AS n FROM g),
draws AS (SELECT r, (('0x' || substr(md5('2026:' || r || ':' || k), 1, 12))::BIGINT) % n AS slot FROM n, range(200) t(r), (SELECT unnest(range(0, (SELECT n FROM n))) AS k)), m AS (SELECT list_sort(list(d)) AS ds FROM (SELECT r, (sum(a) - sum(b)) / sum(c) AS d FROM draws JOIN g USING (slot) GROUP BY r))
SELECT round((SELECT avg(a) - avg(b) FROM s), 5) AS difference, round(ds[6], 5) AS low, round(ds[196], 5) AS high FROM m""")
def paired_bootstrap(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_retailprice", (F.col("p_size") * 20).cast("double").alias("b"))
    return V.paired_bootstrap(p, "p_brand", "p_retailprice", "b").select(*[F.round(c, 5).alias(c) for c in ("difference", "low", "high")])


@query("""WITH p AS (SELECT s_suppkey AS k, CAST(s_acctbal AS DOUBLE) AS y, CAST(s_nationkey AS DOUBLE) AS x, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), r AS (SELECT p.*, t.r FROM p, range(1, 101) t(r)),
d AS (SELECT r, y, row_number() OVER (PARTITION BY r ORDER BY md5('2026:' || r || ':' || k), k) AS i FROM r), c AS (SELECT r.r, abs(corr(r.x, d.y)) AS c FROM r JOIN d ON d.r = r.r AND d.i = r.i GROUP BY 1), o AS (SELECT abs(corr(x, y)) AS o FROM p)
SELECT round((count(CASE WHEN c >= o THEN 1 END) + 1) / 101, 9) AS p FROM c, o""")
def permutation_test(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"))
    return V.permutation_p(s, "x", "y", "s_suppkey", 100).select(F.round("p", 9).alias("p"))


@query("""WITH a AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN round(o_totalprice, 0) END AS s FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT count(*) AS n, count(*) - count(s) AS z FROM a),
c AS (SELECT s, count(*) AS c FROM a WHERE s IS NOT NULL GROUP BY 1), b AS (SELECT s, coalesce(sum(c) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT max(s) AS threshold FROM b, n WHERE (below + z) / n <= 0.2""")
def constrained_threshold(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("answerable"), F.when(k % 11 != 0, F.round("o_totalprice", 0)).alias("s"))
    return V.constrained_threshold(o, "answerable", "s", 0.2)


@query("""WITH g AS (SELECT p_brand, sum(p_retailprice) AS s, count(*) AS c FROM part GROUP BY 1) SELECT p_brand, round(((SELECT sum(s) FROM g) - s) / ((SELECT sum(c) FROM g) - c), 4) AS others, round(s / c, 4) AS own FROM g""")
def leave_one_brand_out(spark, d):
    return V.leave_one_out(table(spark, d, "part"), "p_brand", "p_retailprice").select("p_brand", F.round("others", 4).alias("others"), F.round("own", 4).alias("own"))


@query("""WITH l AS (SELECT * FROM (VALUES (0, 'BUILDING'), (1, 'MACHINERY'), (2, 'NONE')) v(place, level)) SELECT place, level, count(c_custkey) AS n, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median FROM l LEFT JOIN customer ON c_mktsegment = level GROUP BY 1, 2""")
def balances_per_level(spark, d):
    return V.per_level(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", ["BUILDING", "MACHINERY", "NONE"]).select("place", "level", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("""SELECT source, count(CASE WHEN lang = 'en' THEN 1 END) AS en, count(CASE WHEN lang = 'de' THEN 1 END) AS de, count(CASE WHEN lang = 'fr' THEN 1 END) AS fr FROM documents GROUP BY 1""")
def language_coverage(spark, d):
    return V.coverage_matrix(table(spark, d, "documents"), "source", "lang", ["en", "de", "fr"])


@query("""WITH r AS (SELECT o_orderpriority AS rung, o_orderkey % 3 AS seed, o_custkey AS item, o_totalprice AS v FROM orders), i AS (SELECT rung, item, avg(v) AS v FROM r GROUP BY 1, 2), s AS (SELECT rung, stddev_samp(v) AS seed_spread FROM (SELECT rung, seed, avg(v) AS v FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT rung, round(avg(v), 4) AS mean, count(*) AS items, round(max(seed_spread), 4) AS seed_spread FROM i JOIN s USING (rung) GROUP BY 1""")
def rung_summaries(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderpriority").alias("rung"), (F.col("o_orderkey") % 3).alias("seed"), F.col("o_custkey").alias("item"), F.col("o_totalprice").alias("v"))
    return V.rung_summary(r, "rung", "seed", "item", "v").select("rung", F.round("mean", 4).alias("mean"), "items", F.round("seed_spread", 4).alias("seed_spread"))


@query("""WITH m AS (SELECT p_type AS field, p_brand AS rung, avg(p_size) AS v FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY round(v, 9) DESC, rung) AS n, max(v) OVER (PARTITION BY field) AS score FROM m) SELECT field, rung AS best, round(score, 9) AS score FROM r WHERE n = 1""")
def best_brand_per_type(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "part").select(F.col("p_type").alias("field"), F.col("p_brand").alias("rung"), "p_size")
    order = F.dense_rank().over(Window.partitionBy("field").orderBy("rung"))
    return V.best_per_field(p, "field", "rung", "p_size", order).select("field", "best", F.round("score", 9).alias("score"))


@query("""WITH g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) AS k FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority), (o_orderstatus)))
SELECT o_orderpriority, o_orderstatus, n, CAST(k AS BIGINT) AS k, round(k / n, 9) AS rate, round((k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 9) AS low FROM g""")
def rates_by_set(spark, d):
    o = table(spark, d, "orders").withColumn("hit", F.col("o_totalprice") > 150000)
    return V.rates(o, "hit", [[], ["o_orderpriority"], ["o_orderstatus"]]).select("o_orderpriority", "o_orderstatus", "n", "k", F.round("rate", 9).alias("rate"), F.round("low", 9).alias("low"))


@query("""SELECT source, doc_id, n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY quality, doc_id) AS n FROM labels JOIN documents USING (doc_id)) WHERE n <= 5""")
def misses_first(spark, d):
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return V.misses_first(l, ["source"], "quality", "doc_id", 5).select("source", "doc_id", "n")


@query("""SELECT count(o_totalprice) AS n, round(quantile_cont(o_totalprice, 1/3.0), 4) AS low, round(quantile_cont(o_totalprice, 2/3.0), 4) AS high FROM orders""")
def price_terciles(spark, d):
    return V.terciles(table(spark, d, "orders"), "o_totalprice").select("n", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


_REASONS = "CASE WHEN n_chars < 50 THEN 'too_short' WHEN lang <> 'en' THEN 'language' WHEN n_chars > 5000 THEN 'too_long' END"


@query(f"SELECT r.reason, count(d.doc_id) AS n FROM (VALUES ('too_short'), ('language'), ('too_long'), ('never'), (NULL)) r(reason) LEFT JOIN (SELECT doc_id, {_REASONS} AS reason FROM documents) d ON d.reason IS NOT DISTINCT FROM r.reason GROUP BY 1")
def filter_report(spark, d):
    docs = V.first_reason(table(spark, d, "documents"), [("too_short", F.col("n_chars") < 50), ("language", F.col("lang") != "en"), ("too_long", F.col("n_chars") > 5000)])
    return V.report(docs, "reason", ["too_short", "language", "too_long", "never"])


@query("""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'money' WHEN 1 THEN 'percent' ELSE 'pe' END AS kind, CAST(o_orderkey % 400 AS DOUBLE) AS gold, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey % 400 AS DOUBLE) + (o_orderkey % 5) * 0.25 END AS pred FROM orders)
SELECT o_orderkey, CASE WHEN pred IS NULL THEN false WHEN kind = 'money' THEN abs(pred - gold) <= 0.005 * gold WHEN kind = 'percent' THEN abs(pred - gold) <= 0.05 ELSE abs(pred - gold) <= 0.01 * gold END AS ok FROM v""")
def value_matches(spark, d):
    k = F.col("o_orderkey")
    gold = (k % 400).cast("double")
    kind = F.when(k % 3 == 0, "money").when(k % 3 == 1, "percent").otherwise("pe")
    return table(spark, d, "orders").select("o_orderkey", V.value_matches(kind, gold, F.when(k % 17 != 0, gold + (k % 5) * 0.25)).alias("ok"))


@query("""WITH c AS (SELECT l_orderkey AS k, CAST(l_quantity AS DOUBLE) AS value, l_returnflag AS source, l_discount AS score, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS p FROM lineitem), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, score DESC, value) AS n FROM c) WHERE n = 1),
m AS (SELECT c.k, bool_or(c.value = b.value AND c.source <> b.source) AS confirmed, bool_or(c.value <> b.value AND c.source = b.source AND c.score = b.score) AS clash FROM c JOIN b USING (k) GROUP BY 1) SELECT b.k, b.value, b.source, CASE WHEN clash THEN 'clash' WHEN confirmed THEN 'confirmed' ELSE 'single' END AS verdict FROM b JOIN m USING (k)""")
def selected_fields(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("double").alias("v"), F.col("l_returnflag").alias("s"), F.col("l_discount").alias("c"))
    priority = F.when(F.col("s") == "R", 0).when(F.col("s") == "A", 1).otherwise(2)
    return V.select_field(c, ["k"], "v", "s", "c", priority).select("k", "value", "source", "verdict")


@query("""SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN s END) AS urgent, max(CASE WHEN o_orderpriority = '2-HIGH' THEN s END) AS high FROM (SELECT o_custkey, o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM orders GROUP BY 1, 2) GROUP BY 1""")
def wide_inputs(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("s"))
    return V.wide(s, "o_custkey", "o_orderpriority", "s", ["1-URGENT", "2-HIGH"]).select("o_custkey", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 3 <= 1 THEN 'consistent' ELSE 'inconsistent' END AS sum_check FROM orders""")
def consistent_sums(spark, d):
    k = F.col("o_orderkey")
    check = V.adds_up(F.when(k % 7 != 0, k), k * 2, k * 3 + k % 3, F.lit(1))
    return table(spark, d, "orders").select("o_orderkey", check.alias("sum_check"))


_TAG = "CASE WHEN event_type = 'view' THEN 'O' WHEN event_id % 4 = 0 THEN concat('B-', event_type) ELSE concat('I-', event_type) END"


@query(f"""WITH t AS (SELECT user_id, event_id, {_TAG} AS tag FROM events), l AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS label FROM t), o AS (SELECT *, CASE WHEN label IS NOT NULL AND (tag LIKE 'B-%' OR lag(label) OVER w IS NULL OR lag(label) OVER w <> label) THEN 1 ELSE 0 END AS opens FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(label) AS label, min(event_id) AS first, max(event_id) AS last FROM g WHERE label IS NOT NULL GROUP BY user_id, g""")
def tagged_spans(spark, d):
    return V.tag_spans(table(spark, d, "events").select("user_id", "event_id", F.expr(_TAG).alias("tag")), "user_id", "event_id", "tag")


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00012') AND c_mktsegment = 'BUILDING' AND c_acctbal < 5000""")
def listed_customers(spark, d):
    c = table(spark, d, "customer")
    return V.listed(c, "00012", ["c_name"], {"c_mktsegment": "BUILDING", "c_nationkey": None}, ("c_acctbal", 5000.0), [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_custkey", "c_name")


@query()
def text_classifier(spark, d):
    """Toxicity told by TF-IDF and a logistic regression with balanced classes, learnt on three quarters of the labels."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").withColumn("label", F.col("toxic").cast("double"))
    model = V.text_classifier(V.balanced(rows.where("doc_id % 4 <> 0"), "label"), "text", "label", "weight")
    return model.transform(rows.where("doc_id % 4 = 0")).select("doc_id", "toxic", F.col("prediction").cast("int").alias("predicted"))


@query("""WITH q AS (SELECT coalesce(source, '') AS source, quality = 1 AS yes, CAST(n_chars AS DOUBLE) AS s FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
n AS (SELECT source, count(*) FILTER (yes) AS na, count(*) FILTER (NOT yes) AS nu FROM q GROUP BY 1), c AS (SELECT DISTINCT g.source, q.s AS t FROM n g JOIN q ON q.source <> g.source WHERE q.s IS NOT NULL),
k AS (SELECT source, t FROM c UNION SELECT source, min(t) - 1 FROM c GROUP BY 1),
b AS (SELECT k.source, k.t, ((count(*) FILTER (q.yes AND q.s >= k.t))::DOUBLE / count(*) FILTER (q.yes) + (count(*) FILTER (NOT q.yes AND (q.s IS NULL OR q.s < k.t)))::DOUBLE / count(*) FILTER (NOT q.yes)) / 2 AS balanced FROM k JOIN q ON q.source <> k.source GROUP BY 1, 2),
r AS (SELECT source, t, row_number() OVER (PARTITION BY source ORDER BY round(balanced, 12) DESC, t) AS n FROM b)
SELECT n.source, r.t AS threshold, n.nu AS unanswerable, count(*) FILTER (NOT q.yes AND (q.s IS NULL OR q.s < r.t)) AS abstained, n.na AS answerable, count(*) FILTER (q.yes AND (q.s IS NULL OR q.s < r.t)) AS wrongly_abstained
FROM n JOIN r ON r.source = n.source AND r.n = 1 JOIN q ON q.source = n.source GROUP BY ALL""")
def held_out_source_thresholds(spark, d):
    """The length from which documents count as good, tuned on all other sources for each source, and how it does there."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_chars")
    rated = docs.join(table(spark, d, "labels").where("quality is not null").select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
    return P.held_out_thresholds(rated, "source", "good", "n_chars")
