"""Queries over order-dependent operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import windows as O
from .registry import query, table

_TOP = "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5"


@query(_TOP)
def top_five_orders(spark, d):
    return O.top_k(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('2026:' || o_orderkey), o_orderkey) AS n FROM orders) WHERE n <= 3")
def capped_per_customer(spark, d):
    return O.capped(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query("""SELECT doc_id, md5(text) AS h FROM (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def keyed_dedup(spark, d):
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    return O.keyed_dedup(table(spark, d, "documents").select("doc_id", "text"), key, [F.col("doc_id")]).select("doc_id", F.md5("text").alias("h"))


@query("""WITH r AS (SELECT 0 AS list, p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part
  UNION ALL SELECT 1, p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) FROM part),
f AS (SELECT p_brand, p_partkey, sum(1 / (60 + rank)) AS score, min(list * 100000 + rank) AS first FROM r WHERE rank <= 20 GROUP BY 1, 2)
SELECT p_brand, p_partkey, round(score, 9) AS score FROM f""")
def fused_ranks(spark, d):
    p = table(spark, d, "part")
    a = O.top_k(p, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 20).select(F.lit(0).alias("list"), "p_brand", "p_partkey", "rank")
    b = O.top_k(p, ["p_brand"], [F.desc("p_size"), F.col("p_partkey")], 20).select(F.lit(1).alias("list"), "p_brand", "p_partkey", "rank")
    return O.rrf(a.unionByName(b), "list", "p_partkey", "rank", by=["p_brand"]).select("p_brand", "p_partkey", F.round("score", 9).alias("score"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def event_sequence(spark, d):
    return O.sequence(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "seq")


@query("""WITH y AS (SELECT o_orderpriority AS p, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS fy, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN lag(fy) OVER w = fy - 1 THEN lag(revenue) OVER w END AS previous, max(fy) OVER (PARTITION BY p) - fy AS gap, dense_rank() OVER (PARTITION BY p ORDER BY fy DESC) - 1 AS r FROM y WINDOW w AS (PARTITION BY p ORDER BY fy))
SELECT p, fy, revenue, round(CASE WHEN previous > 0 THEN (revenue - previous) / previous END, 9) AS growth, CASE WHEN gap = r THEN r END AS recency FROM l""")
def fiscal_year_growth(spark, d):
    from ..functions.numbers import fiscal_year

    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), fiscal_year("o_orderdate").alias("fy"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    y = o.groupBy("p", "fy").agg(F.sum("v").cast("double").alias("revenue"))
    y = O.recency_rank(O.year_on_year(y, ["p"], "fy", "revenue"), ["p"], "fy")
    return y.select("p", "fy", "revenue", F.round("growth", 9).alias("growth"), "recency")


_RUNS = """WITH e AS (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS run FROM g)"""


@query(_RUNS + " SELECT event_id, run FROM r")
def event_runs(spark, d):
    return O.run_lengths(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "run")


@query(_RUNS + ", h AS (SELECT *, max(CASE WHEN run >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS h FROM r) SELECT event_id, user_id FROM h WHERE h = 0")
def events_before_loops(spark, d):
    return O.trim_repeats(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "user_id")


@query("""WITH s AS (SELECT conv_id, turn, sum(length(text) + 40) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, turn, spent FROM s WHERE spent <= 1500 OR n = 1""")
def turns_within_budget(spark, d):
    return O.within_budget(table(spark, d, "conversations"), "conv_id", [F.col("turn")], F.length("text") + 40, 1500).select("conv_id", "turn", "spent")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS about FROM events""")
def nearest_earlier_purchase(spark, d):
    e = table(spark, d, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return O.nearest_earlier(e, "user_id", [F.col("ts"), F.col("event_id")], "p").select("event_id", "about")


@query("""WITH s AS (SELECT o_custkey AS doc, CAST(o_orderkey % 500 AS BIGINT) AS start, o_orderkey FROM orders)
SELECT doc, start, o_orderkey, coalesce(min(start) OVER (PARTITION BY doc ORDER BY start RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, 500) AS "end" FROM s""")
def section_ends(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 500).cast("long").alias("start"), "o_orderkey")
    return O.section_ends(s, "doc", "start", F.lit(500))


@query("""WITH v AS (SELECT l_suppkey, CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) % 30 AS shift, count(*) AS votes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, shift) AS n FROM v) SELECT l_suppkey, CASE WHEN votes >= 30 THEN shift END AS shift, votes FROM b WHERE n = 1""")
def voted_shift(spark, d):
    l, o = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_shipdate"), table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return O.voted_shift(l.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "l_suppkey", F.datediff("l_shipdate", "o_orderdate") % 30, 30)


@query("""WITH i AS (SELECT o_orderkey, year(o_orderdate) AS y, o_custkey, row_number() OVER (PARTITION BY year(o_orderdate), o_custkey ORDER BY md5('2026:' || o_orderkey), o_orderkey) AS i FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY i, md5('2026:' || o_custkey), o_custkey) AS round FROM i) SELECT o_orderkey, y, round FROM t ORDER BY round, y, o_orderkey LIMIT 200""")
def round_robin_years(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), "o_custkey")
    return O.round_robin(o, "y", "o_custkey", "o_orderkey", 200).select("o_orderkey", "y", "round")


@query("""WITH b AS (SELECT c_custkey, CAST(floor((c_acctbal - 0) / 1000) AS BIGINT) + 1 AS bin FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 10000)
SELECT c_custkey, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('2026:' || c_custkey), c_custkey) AS n FROM b) WHERE n <= 6""")
def binned_customers(spark, d):
    return O.per_bin(table(spark, d, "customer"), "c_acctbal", "c_custkey", 0.0, 10000.0, 10, 60).select("c_custkey", "bin")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, pow((('0x' || substr(md5('2026:' || o_orderkey), 1, 12))::BIGINT + 0.5) / 281474976710656.0, 1 / CASE WHEN year(o_orderdate) >= 1999 THEN 2.0 ELSE 1.0 END) AS draw FROM orders) ORDER BY draw DESC, o_orderkey LIMIT 300""")
def weighted_sample(spark, d):
    o = table(spark, d, "orders")
    return O.weighted_sample(o, "o_orderkey", F.when(F.year("o_orderdate") >= 1999, 2.0).otherwise(1.0), 300).select("o_orderkey")


@query("""WITH c AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1), q AS (SELECT event_type, 100 * c / (SELECT sum(c) FROM c) AS q FROM c), f AS (SELECT event_type, q, floor(q) AS f, 100 - sum(floor(q)) OVER () AS l, row_number() OVER (ORDER BY q - floor(q) DESC, event_type) AS r FROM q),
t AS (SELECT event_type, f + CASE WHEN r <= l THEN 1 ELSE 0 END AS take FROM f) SELECT event_id, event_type FROM (SELECT e.*, row_number() OVER (PARTITION BY event_type ORDER BY md5('2026:' || event_id), event_id) AS n FROM events e) JOIN t USING (event_type) WHERE n <= take""")
def stratified_events(spark, d):
    return O.stratified(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 100)


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n, count(*) OVER () AS c FROM orders) SELECT o_orderkey FROM n WHERE n IN (SELECT CAST(floor(i * greatest(1.0, (SELECT count(*) FROM orders) / 20)) AS BIGINT) FROM range(20) t(i))""")
def evenly_spread_orders(spark, d):
    return O.even_spread(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], 20).select("o_orderkey")


@query("""WITH a AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12 ORDER BY md5('2026:' || o_custkey), o_custkey LIMIT 25) SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('2026:' || o_orderkey), o_orderkey) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM a)) WHERE n <= 12""")
def group_then_row_sample(spark, d):
    return O.largest_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 25, 12, "o_orderkey")


@query("SELECT user_id, count(*) AS calls, max(c) AS busiest FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS c FROM events) GROUP BY 1")
def call_rates(spark, d):
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-60, 0)
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("t")).withColumn("c", F.count("*").over(w))
    return e.groupBy("user_id").agg(F.count("*").alias("calls"), F.max("c").alias("busiest"))


@query()
def admitted_calls(spark, d):
    """Calls that a limiter of 3 an hour admits for each user (a fold: denied calls leave no trace)."""
    return O.admitted(table(spark, d, "events"), "user_id", "ts", "event_id", 3, 3600)


@query("""SELECT o_custkey, min_by(o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) * 1e18 + epoch(o_orderdate) * 1e6 + o_orderkey % 1000000) AS o_orderkey FROM (SELECT * FROM orders) GROUP BY 1""")
def earliest_filing(spark, d):
    order = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1) * F.lit(1e18) + F.unix_timestamp("o_orderdate") * F.lit(1e6) + F.col("o_orderkey") % 1000000
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("o_orderkey"))
