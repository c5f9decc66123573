"""Queries over statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from .registry import query, table


def _quality(spark, d):
    """A rule predictor of quality: texts of middling length are good."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    return table(spark, d, "labels").join(docs, "doc_id").withColumn("pred", ((F.col("n_chars") > 400) & (F.col("n_chars") < 20000)).cast("int"))


_Q = "q AS (SELECT l.*, d.source, d.n_chars, CASE WHEN n_chars > 400 AND n_chars < 20000 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d USING (doc_id))"


@query(f"WITH {_Q} SELECT quality AS gold, pred, count(*) AS n FROM q GROUP BY 1, 2")
def quality_confusion(spark, d):
    return S.confusion(_quality(spark, d), "quality", "pred")


@query(f"""WITH {_Q}, c AS (SELECT label, sum(CASE WHEN quality = label AND pred = label THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN quality = label THEN 1 ELSE 0 END) AS support, sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS predicted
  FROM q, (VALUES (0), (1)) v(label) GROUP BY label), s AS (SELECT label, support, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM c)
SELECT label, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM s""")
def quality_class_scores(spark, d):
    s = S.class_scores(_quality(spark, d), "quality", "pred")
    return s.select("label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH b AS (SELECT 1 + p_size % 5 AS gold, 1 + CAST(floor(p_retailprice) AS BIGINT) % 5 AS pred FROM part)
SELECT count(*) AS n, round(avg(abs(gold - pred)), 9) AS mae, round(avg(CASE WHEN abs(gold - pred) <= 1 THEN 1 ELSE 0 END), 9) AS within_1,
  round(sum(CASE WHEN gold >= 4 AND pred >= 4 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN gold >= 4 THEN 1 ELSE 0 END), 0), 9) AS severe_recall,
  round(sum(CASE WHEN gold >= 4 AND pred >= 4 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN pred >= 4 THEN 1 ELSE 0 END), 0), 9) AS severe_precision FROM b""")
def band_scores(spark, d):
    b = table(spark, d, "part").select((1 + F.col("p_size") % 5).alias("gold"), (1 + F.floor("p_retailprice") % 5).alias("pred"))
    return S.band_scores(b, "gold", "pred").select("n", *[F.round(c, 9).alias(c) for c in ("mae", "within_1", "severe_recall", "severe_precision")])


@query(f"""WITH {_Q}, g AS (SELECT source, count(*) AS n, sum(quality) AS k FROM q GROUP BY source)
SELECT source, n, k, round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 9) AS low,
  round(least(1, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 9) AS high FROM g""")
def quality_wilson(spark, d):
    g = _quality(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("k")).withColumn("w", S.wilson(F.col("k"), F.col("n")))
    return g.select("source", "n", "k", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


@query(f"""WITH {_Q}, g AS (SELECT source, sum(CASE WHEN quality = 1 AND pred = 0 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN quality = 0 AND pred = 1 THEN 1 ELSE 0 END) AS c FROM q GROUP BY source),
t AS (SELECT source, b, c, unnest(range(0, CAST(least(b, c) AS BIGINT) + 1)) AS i FROM g)
SELECT source, CAST(max(b) AS BIGINT) AS b, CAST(max(c) AS BIGINT) AS c, round(CASE WHEN max(b) + max(c) = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))) END, 7) AS p FROM t GROUP BY source""")
def quality_mcnemar(spark, d):
    q = _quality(spark, d)
    g = q.groupBy("source").agg(F.sum(((F.col("quality") == 1) & (F.col("pred") == 0)).cast("int")).alias("b"), F.sum(((F.col("quality") == 0) & (F.col("pred") == 1)).cast("int")).alias("c"))
    return g.select("source", "b", "c", F.round(S.mcnemar(F.col("b"), F.col("c")), 7).alias("p"))


@query("""WITH q AS (SELECT o_orderpriority, list_transform([0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0], lambda x: 0.0) AS z, quantile_cont(o_totalprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0]) AS d FROM orders GROUP BY 1)
SELECT o_orderpriority, i, round(d[i], 4) AS value FROM (SELECT o_orderpriority, d, unnest(range(1, 12)) AS i FROM q)""")
def price_deciles(spark, d):
    q = table(spark, d, "orders").groupBy("o_orderpriority").agg(S.deciles("o_totalprice").alias("d"))
    return q.select("o_orderpriority", F.posexplode("d").alias("i", "value")).select("o_orderpriority", (F.col("i") + 1).cast("long").alias("i"), F.round("value", 4).alias("value"))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0]) AS d FROM customer WHERE c_mktsegment = 'BUILDING'),
s AS (SELECT c_custkey, c_acctbal AS x, d, len(list_filter(d, lambda v: v < c_acctbal)) AS i FROM customer, q)
SELECT c_custkey, CASE WHEN x <= d[1] THEN 0 WHEN x >= d[11] THEN 100 ELSE round((i - 1 + coalesce((x - d[i]) / nullif(d[i + 1] - d[i], 0), 0)) * 10, 1) END AS pct FROM s""")
def balance_percentiles(spark, d):
    c = table(spark, d, "customer")
    points = c.where("c_mktsegment = 'BUILDING'").agg(S.deciles("c_acctbal").alias("d"))
    return c.crossJoin(F.broadcast(points)).select("c_custkey", S.percentile_rank(F.col("c_acctbal"), F.col("d")).alias("pct"))


@query("""WITH g AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n, round(list_aggregate(v, 'median'), 6) AS median, round(v[CAST(round_even(0.9 * (n - 1), 0) AS INTEGER) + 1], 6) AS p90, round(v[CAST(floor(0.975 * n) AS INTEGER) + 1], 6) AS p975, round(v[len(v)], 6) AS longest FROM g""")
def latency_summary(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.array_sort(F.collect_list("value")).alias("v"), F.median("value").alias("m"), F.count("*").alias("n"))
    return g.select("event_type", "n", F.round("m", 6).alias("median"), F.round(S.rounded_index_percentile(F.col("v"), 0.9), 6).alias("p90"), F.round(S.floor_index_percentile(F.col("v"), 0.975), 6).alias("p975"), F.round(F.array_max("v"), 6).alias("longest"))


@query("""WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS ry FROM part)
SELECT p_brand, round(corr(rx, ry), 7) AS rho, count(*) AS n FROM r GROUP BY p_brand""")
def size_price_spearman(spark, d):
    return S.spearman(table(spark, d, "part"), "p_size", "p_retailprice", ["p_brand"]).select("p_brand", F.round("rho", 7).alias("rho"), "n")


@query("""WITH g AS (SELECT o_orderpriority AS g, sum(o_totalprice) AS s, count(*) AS c, row_number() OVER (ORDER BY o_orderpriority) - 1 AS slot FROM orders GROUP BY 1),
n AS (SELECT count(*) AS n FROM g), draws AS (SELECT r, (('0x' || substr(md5('2026:' || r || ':' || k), 1, 12))::BIGINT) % n AS slot FROM n, range(200) t(r), (SELECT unnest(range(0, (SELECT n FROM n))) AS k)),
m AS (SELECT r, sum(s) / sum(c) AS m FROM draws JOIN g USING (slot) GROUP BY r), o AS (SELECT list_sort(list(m)) AS ms FROM m)
SELECT round((SELECT avg(o_totalprice) FROM orders), 4) AS mean, round(ms[6], 4) AS low, round(ms[196], 4) AS high FROM o""")
def order_value_bootstrap(spark, d):
    b = S.cluster_bootstrap(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", 200)
    return b.select(*[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {_Q}, c AS (SELECT DISTINCT CAST(n_chars AS DOUBLE) AS t FROM q), s AS (SELECT t, (sum(CASE WHEN quality = 1 AND n_chars >= t THEN 1 ELSE 0 END) / sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)
  + sum(CASE WHEN quality = 0 AND n_chars < t THEN 1 ELSE 0 END) / sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)) / 2 AS b FROM c, q GROUP BY t)
SELECT CAST(t AS BIGINT) AS threshold, round(b, 9) AS balanced FROM s ORDER BY b DESC, t LIMIT 1""")
def length_threshold(spark, d):
    q = _quality(spark, d).withColumn("answerable", F.col("quality") == 1)
    return S.tune_threshold(q, "answerable", "n_chars").select("threshold", F.round("balanced", 9).alias("balanced"))


@query("""WITH h AS (SELECT o_custkey % 200 AS question, o_orderpriority AS language, row_number() OVER (PARTITION BY o_custkey % 200, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderstatus = 'F' AS hit FROM orders),
f AS (SELECT question, language, min(CASE WHEN hit THEN rank END) AS r FROM h GROUP BY 1, 2)
SELECT language, round(avg(CASE WHEN r <= 1 THEN 1 ELSE 0 END), 9) AS recall_1, round(avg(CASE WHEN r <= 5 THEN 1 ELSE 0 END), 9) AS recall_5, round(avg(coalesce(1 / r, 0)), 9) AS mrr, count(*) AS n FROM f GROUP BY ROLLUP (language)""")
def retrieval_scores(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders").withColumn("question", F.col("o_custkey") % 200)
    w = Window.partitionBy("question", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    h = o.select("question", F.col("o_orderpriority").alias("language"), F.row_number().over(w).alias("rank"), (F.col("o_orderstatus") == "F").alias("hit"))
    return S.recall_and_mrr(h, "question", "rank", "hit", "language").select("language", *[F.round(c, 9).alias(c) for c in ("recall_1", "recall_5", "mrr")], "n")


@query("""SELECT p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 6) AS mean_price, round(median(p_retailprice), 6) AS median_price FROM part GROUP BY p_brand""")
def weighted_prices(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(S.weighted_mean("p_retailprice", "p_size"), 6).alias("mean_price"), F.round(F.median("p_retailprice"), 6).alias("median_price"))


@query("""WITH t AS (SELECT a.p_partkey, string_split(a.p_name, ' ') AS g, string_split(b.p_name || ' ' || a.p_brand, ' ') AS p FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
c AS (SELECT p_partkey, g, p, list_sum(list_transform(list_distinct(g), lambda t: least(len(list_filter(g, lambda x: x = t)), len(list_filter(p, lambda x: x = t))))) AS k, len(list_intersect(g, p)) AS s, len(list_distinct(g)) + len(list_distinct(p)) AS u FROM t)
SELECT p_partkey, round(CASE WHEN k = 0 THEN 0 ELSE 2 * (k / len(p)) * (k / len(g)) / (k / len(p) + k / len(g)) END, 9) AS token_f1, round(2 * s / u, 9) AS list_f1 FROM c""")
def name_overlap(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    t = p.join(after, "p_partkey").select("p_partkey", F.split("p_name", " ").alias("g"), F.split(F.concat_ws(" ", "next", "p_brand"), " ").alias("p"))
    return t.select("p_partkey", F.round(S.token_f1(F.col("p"), F.col("g")), 9).alias("token_f1"), F.round(S.list_f1(F.col("p"), F.col("g")), 9).alias("list_f1"))


@query("""SELECT kind, source, count(*) AS docs, sum(n_chars) AS chars, round(avg(CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END), 9) AS long_share FROM (SELECT lang AS kind, source, n_chars FROM documents) GROUP BY GROUPING SETS ((), (kind), (source))""")
def corpus_stats(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("kind"), "source", "n_chars")
    return docs.groupingSets([[], [docs.kind], [docs.source]], docs.kind, docs.source).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.round(F.avg((F.col("n_chars") >= 1000).cast("int")), 9).alias("long_share"))
