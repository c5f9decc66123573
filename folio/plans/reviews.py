"""Queries over banks of rows, their labels and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reviews as R
from .registry import query, table


@query("SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def labelled_rows(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    return R.labelled(orders, table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_orderkey", "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("l_orderkey", "l_linenumber", "l_shipdate", "o_custkey", "o_orderpriority")


@query("""WITH s AS (SELECT l_orderkey AS id, sum(l_quantity) AS score FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), t AS (SELECT o_orderkey AS id, o_orderpriority AS category FROM orders WHERE o_orderkey % 3 = 0), m AS (SELECT o_orderkey AS id, o_orderstatus AS category FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey AS id, o_custkey AS document, score, coalesce(t.category, m.category) AS category, CASE WHEN t.id IS NOT NULL THEN 'teacher' WHEN m.id IS NOT NULL THEN 'model' END AS label_source
FROM orders o LEFT JOIN s ON s.id = o_orderkey LEFT JOIN t ON t.id = o_orderkey LEFT JOIN m ON m.id = o_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def merged_bank(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document"), "o_orderpriority", "o_orderstatus")
    scored = table(spark, d, "lineitem").where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("score"))
    taught = o.where("id % 3 = 0").select("id", F.col("o_orderpriority").alias("category"))
    told = o.where("id % 2 = 0").select("id", F.col("o_orderstatus").alias("category"))
    excluded = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("document"))
    return R.merged_bank(o.select("id", "document"), scored, taught, told, excluded, "id", "document", ["category"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def two_subsets(spark, d):
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return R.concatenated(R.subset(o, c.where("c_acctbal < 0"), "o_custkey"), R.subset(o, c.where("c_acctbal > 9000"), "o_custkey"))


@query("""SELECT DISTINCT a.c_custkey AS asked, o_orderkey, o_totalprice AS score FROM customer a JOIN orders ON o_custkey = a.c_custkey WHERE a.c_custkey % 100 = 0 AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus <> 'P'""")
def scores_in_window(spark, d):
    o = table(spark, d, "orders")
    window = o.where("o_custkey % 100 = 0 and o_orderdate < timestamp '1997-01-01'").select(F.col("o_custkey").alias("asked"), "o_orderkey")
    scores = o.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score"))
    return R.scores_in_window(scores, window, "o_orderkey", "asked").select("asked", "o_orderkey", "score")


@query("""WITH a AS (SELECT p_partkey AS name, p_brand AS h FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS name, CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE p_brand END AS h FROM part WHERE p_partkey % 11 <> 0)
SELECT * FROM (SELECT name, CASE WHEN a.h IS NULL THEN 'unlisted' WHEN b.h IS NULL THEN 'missing' WHEN a.h <> b.h THEN 'changed' END AS state FROM a FULL JOIN b USING (name)) WHERE state IS NOT NULL""")
def changed_files(spark, d):
    p = table(spark, d, "part")
    found = p.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("name"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("h"))
    return R.changed(p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("h")), found, "name", "h")


@query("SELECT d.doc_id, e.existing FROM documents d LEFT JOIN (SELECT md5(text) AS h, min(doc_id) AS existing FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) e ON e.h = md5(d.text) WHERE d.doc_id % 2 = 1")
def duplicate_uploads(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return R.already_there(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), "h", "doc_id").select("doc_id", "existing")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def rows_by_year(spark, d):
    return R.counts_by_year(table(spark, d, "orders"), F.year("o_orderdate"))


@query("""WITH r AS (SELECT source, len(regexp_extract_all(text, '\\bthe\\b')) AS n FROM documents WHERE text IS NOT NULL)
SELECT source, count(*) AS documents, count(CASE WHEN n = 0 THEN 1 END) AS without, CAST(sum(n) AS BIGINT) AS risks, CAST(median(n) AS DOUBLE) AS median FROM r GROUP BY 1""")
def segmentation_by_source(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("source", F.regexp_count("text", F.lit(r"\bthe\b")).cast("long").alias("n"))
    return R.segmentation(docs, "source", "n")


_JUDGED = "SELECT o_orderkey % 13 AS \"check\", o_orderstatus AS gold, CASE WHEN o_custkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS told FROM orders"


def _judged(spark, d):
    return table(spark, d, "orders").select((F.col("o_orderkey") % 13).alias("check"), F.col("o_orderstatus").alias("gold"), F.when(F.col("o_custkey") % 4 == 0, "F").otherwise(F.col("o_orderstatus")).alias("told"))


@query(f'SELECT "check", count(*) AS n, count(CASE WHEN gold = told THEN 1 END) AS "right", count(CASE WHEN gold = told THEN 1 END) / count(*) AS accuracy FROM ({_JUDGED}) GROUP BY GROUPING SETS (("check"), ())')
def status_summary(spark, d):
    return R.status_summary(_judged(spark, d), "check", "gold", "told")


@query(f"SELECT gold, count(CASE WHEN told = 'F' THEN 1 END) AS F, count(CASE WHEN told = 'O' THEN 1 END) AS O, count(CASE WHEN told = 'P' THEN 1 END) AS P FROM ({_JUDGED}) GROUP BY 1")
def status_confusion(spark, d):
    return R.status_confusion(_judged(spark, d), "gold", "told", ["F", "O", "P"])


_STATUS = "CASE ({} % 7) WHEN 0 THEN 'not_available' WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'watch' WHEN 3 THEN 'concern' ELSE 'ok' END"
_RUN = lambda k: f"SELECT o_custkey AS doc, o_orderkey AS id, o_orderkey % 13 AS \"check\", {_STATUS.format(k)} AS status FROM orders"


def _run(spark, d, k):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 13).alias("check"), F.expr(_STATUS.format(k)).alias("status"))


@query(f"SELECT \"check\", count(CASE WHEN status NOT LIKE 'not_a%' THEN 1 END) AS decided, count(*) AS n FROM ({_RUN('o_custkey')}) GROUP BY 1")
def decided_counts(spark, d):
    return R.decided(_run(spark, d, "o_custkey"), "check", "status")


@query(f"""WITH j AS (SELECT a."check", a.status AS was, b.status AS now, a.status NOT LIKE 'not_a%' AS w, b.status NOT LIKE 'not_a%' AS n FROM ({_RUN('o_custkey')}) a JOIN ({_RUN('(o_custkey + o_orderkey)')}) b USING (id, "check") WHERE id % 5 <> 0)
SELECT "check", count(*) AS n, count(CASE WHEN w THEN 1 END) AS before, count(CASE WHEN n THEN 1 END) AS after, count(CASE WHEN NOT w AND n THEN 1 END) AS gained, count(CASE WHEN w AND NOT n THEN 1 END) AS lost, count(CASE WHEN w AND n AND was <> now THEN 1 END) AS otherwise FROM j GROUP BY 1""")
def decided_before_after(spark, d):
    return R.before_after(_run(spark, d, "o_custkey"), _run(spark, d, "(o_custkey + o_orderkey)").where("id % 5 <> 0"), ["id", "check"], "check", "status")


_VERDICT = "CASE l_linenumber % 4 WHEN 0 THEN 'contradicted' WHEN 1 THEN 'verified' WHEN 2 THEN 'unverifiable' END"


@query(f"SELECT l_orderkey, avg(CASE WHEN v IS NOT NULL THEN CASE WHEN v = 'verified' THEN 1.0 ELSE 0.0 END END) AS score FROM (SELECT l_orderkey, {_VERDICT} AS v FROM lineitem) GROUP BY 1")
def answer_scores(spark, d):
    return R.answer_score(table(spark, d, "lineitem").select("l_orderkey", F.expr(_VERDICT).alias("v")), "l_orderkey", "v")


@query(f"""SELECT l_returnflag, count(*) AS n, count(CASE WHEN v = 'verified' THEN 1 END) AS verified, count(CASE WHEN v = 'contradicted' THEN 1 END) AS contradicted, count(CASE WHEN v = 'unverifiable' THEN 1 END) AS unverifiable, count(CASE WHEN l_tax > 0.02 THEN 1 END) AS cited
FROM (SELECT l_returnflag, l_tax, {_VERDICT} AS v FROM lineitem) GROUP BY 1""")
def answer_run_summary(spark, d):
    return R.answer_run(table(spark, d, "lineitem").select("l_returnflag", "l_tax", F.expr(_VERDICT).alias("v")), "l_returnflag", "v", F.col("l_tax") > 0.02)


@query("""SELECT p_brand, count(*) AS seeds, round(avg(p_retailprice), 6) AS mean, round(coalesce(stddev_samp(p_retailprice), 0), 6) AS spread, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS best_seed, avg(p_retailprice) > 1400 AS passes FROM part GROUP BY 1""")
def seed_summary(spark, d):
    s = R.seed_summary(table(spark, d, "part"), "p_brand", "p_partkey", "p_retailprice", 1400.0)
    return s.select("p_brand", "seeds", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), "best_seed", "passes")


_RATED = "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN 'no' ELSE 'yes' END AS faithful, CASE WHEN o_orderkey % 3 = 0 THEN 'partly' ELSE 'yes' END AS correct"


@query(f"""WITH g AS (SELECT p, avg(CASE WHEN faithful IS NOT NULL THEN CASE WHEN faithful = 'yes' THEN 1.0 ELSE 0.0 END END) AS faithful, avg(CASE WHEN correct = 'yes' THEN 1.0 ELSE 0.0 END) AS correct FROM (SELECT o_orderpriority AS p, {_RATED} FROM orders) GROUP BY 1)
SELECT *, coalesce(faithful >= 0.8, false) AND coalesce(correct >= 0.66, false) AS go FROM g""")
def quality_gate(spark, d):
    rated = table(spark, d, "orders").selectExpr("o_orderpriority as p", *[x.strip() for x in _RATED.split(", CASE WHEN o_orderkey % 3")[:1]], "CASE WHEN o_orderkey % 3 = 0 THEN 'partly' ELSE 'yes' END AS correct")
    return R.quality_gate(rated, "p", {"faithful": 0.8, "correct": 0.66})


@query("""WITH m AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'issuer' WHEN 1 THEN 'promoter' ELSE 'director' END AS who FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY who <> 'issuer', o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS mentions FROM m)
SELECT o_custkey, o_orderkey, who, mentions FROM r WHERE n = 1""")
def first_mentions(spark, d):
    k = F.col("o_orderkey") % 5
    m = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(k == 0, "issuer").when(k == 1, "promoter").otherwise("director").alias("who"))
    return R.first_preferred(m, ["o_custkey"], "who", "o_orderkey")


@query("SELECT event_id, user_id, CASE WHEN event_id % 50 = 0 THEN min(value) OVER (PARTITION BY user_id) - 1 ELSE value END AS value FROM events")
def moved_to_front(spark, d):
    return R.moved_to_front(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value", F.col("event_id") % 50 == 0)


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 3")
def newest_orders(spark, d):
    return R.newest(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def queued_customers(spark, d):
    return R.queued(table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "queued")), "o_custkey")


@query("SELECT c_custkey, CASE WHEN CAST(('0x' || substr(sha256('13:' || c_custkey), 1, 8)) AS BIGINT) / 4294967296.0 < 0.2 THEN 'dev' ELSE 'train' END AS part FROM customer")
def shuffled_split(spark, d):
    return R.shuffled_split(table(spark, d, "customer"), "c_custkey", 0.2)


_METRIC = "CASE c_custkey % 5 WHEN 0 THEN 'pe' WHEN 1 THEN 'ofs_share' WHEN 2 THEN 'issue_size_inr' WHEN 3 THEN 'insider_price_gap' END"
_VALUE = "CASE c_custkey % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 600.0 WHEN 3 THEN 1e9 WHEN 4 THEN -1.0 WHEN 5 THEN 1.0 END"


@query(f"""SELECT c_custkey, coalesce(CASE m WHEN 'pe' THEN v > 0 AND v <= 500 WHEN 'ofs_share' THEN v BETWEEN 0 AND 1 WHEN 'issue_size_inr' THEN v BETWEEN 1e8 AND 1e12 WHEN 'insider_price_gap' THEN v BETWEEN 0.1 AND 1000 END, false) AS plausible, least(c_custkey % 6 + 1, 4) AS band,
  CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 THEN (c_custkey % 3) + (c_custkey % 4) END AS total FROM (SELECT c_custkey, {_METRIC} AS m, {_VALUE} AS v FROM customer)""")
def plausible_values(spark, d):
    part = lambda m: F.when(F.col("c_custkey") % m != 0, F.col("c_custkey") % m)
    c = table(spark, d, "customer").select("c_custkey", F.expr(_METRIC).alias("m"), F.expr(_VALUE).cast("double").alias("v"))
    return c.select("c_custkey", R.plausible(F.col("m"), F.col("v")).alias("plausible"), R.severity_band(F.col("c_custkey") % 6 + 1).alias("band"), R.all_or_nothing(part(3), part(4)).alias("total"))


_TITLES = ["Currency of Presentation", "We depend on few customers", "Objects", "Our Promoters may sell", "Table of Contents", "Use of market data in this document and elsewhere", "A long heading without any of the words here", "", "Fiscal 2024", "Capital Structure"]
_TITLE = "concat(CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TITLES)) + " END, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE ' and Offer' END)"


@query(rf"""SELECT o_orderkey, trim(t) <> '' AND (regexp_matches(trim(t), '{R.HEADING}') OR (len(string_split_regex(trim(t), '\s+')) <= 6 AND NOT regexp_matches(trim(t), '{R.RISK_WORDS}'))) AS heading, regexp_matches(concat('Any red', CASE WHEN o_custkey % 3 = 0 THEN '-' ELSE ' ' END, CASE WHEN o_custkey % 5 = 0 THEN 'flag' ELSE 'flash' END, 's?'), '(?i)\bred[- ]?flags?\b') AS red_flags
FROM (SELECT o_orderkey, o_custkey, {_TITLE} AS t FROM orders)""")
def titles_and_questions(spark, d):
    ask = "concat('Any red', CASE WHEN o_custkey % 3 = 0 THEN '-' ELSE ' ' END, CASE WHEN o_custkey % 5 = 0 THEN 'flag' ELSE 'flash' END, 's?')"
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_TITLE).alias("t"), F.expr(ask).alias("q"))
    return o.select("o_orderkey", R.is_nonrisk_title(F.col("t")).alias("heading"), R.asks_for_red_flags(F.col("q")).alias("red_flags"))


@query(r"""WITH p AS (SELECT conv_id, turn, conv_id % 7 AS doc, turn * 2 AS first, turn * 2 + 3 AS last, text FROM conversations), q AS (SELECT conv_id, 3 AS doc, conv_id % 9 AS page, split_part(min(text), ' ', 2) AS gold FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id),
j AS (SELECT p.*, q.doc AS asked, q.page, regexp_replace(lower(q.gold), '[^\p{L}\p{N}]', '', 'g') AS g, regexp_replace(lower(p.text), '[^\p{L}\p{N}]', '', 'g') AS t FROM p JOIN q USING (conv_id))
SELECT conv_id, turn, doc = asked AND (coalesce(page BETWEEN first AND last, false) OR coalesce(length(g) >= 4 AND contains(t, g), false)) AS hit FROM j""")
def retrieval_hits(spark, d):
    c = table(spark, d, "conversations")
    p = c.select("conv_id", "turn", (F.col("conv_id") % 7).alias("doc"), (F.col("turn") * 2).alias("first"), (F.col("turn") * 2 + 3).alias("last"), "text")
    q = c.where("conv_id % 2 = 0").groupBy("conv_id").agg(F.min("text").alias("t")).select("conv_id", F.lit(3).alias("asked"), (F.col("conv_id") % 9).alias("page"), F.split_part("t", F.lit(" "), F.lit(2)).alias("gold"))
    return p.join(q, "conv_id").select("conv_id", "turn", R.is_hit(F.col("doc"), F.col("first"), F.col("last"), F.col("text"), F.col("asked"), F.col("page"), F.col("gold")).alias("hit"))


_PRICED = "concat('Rs. ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)), ',000.25 for ', CAST(o_custkey AS VARCHAR(20)), ' shares; FY', CAST(o_custkey % 90 + 10 AS VARCHAR(20)), ' (note)')"


@query(rf"SELECT o_orderkey, array_to_string(regexp_extract_all({_PRICED}, '\d+(?:,\d+)*(?:\.\d+)?|\w+|[^\w\s]'), ' ') AS tokens, list_filter([o_custkey, o_orderkey % 50, 7], lambda a: NOT (abs(a - o_custkey % 50) <= 1 OR abs(a - 7) <= 1)) AS missing FROM orders")
def tokens_and_missing_numbers(spark, d):
    o = table(spark, d, "orders")
    mine, source = F.array(F.col("o_custkey"), F.col("o_orderkey") % 50, F.lit(7).cast("long")), F.array(F.col("o_custkey") % 50, F.lit(7).cast("long"))
    return o.select("o_orderkey", F.array_join(R.span_tokens(F.expr(_PRICED)), " ").alias("tokens"), R.tolerant_difference(mine, source, 1).alias("missing"))
