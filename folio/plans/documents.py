"""Queries over documents, pages, sources and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..sources import tables as T
from ..streaming import drain as W, events as E
from .registry import query, table


def _lines(spark, d):
    return table(spark, d, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query(r"""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT DISTINCT source, doc_id, trim(regexp_replace(regexp_replace(lower(line), '\d+', '#', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS key FROM l),
p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1) SELECT source, md5(key) AS key, count(*) AS n, max(pages) AS pages FROM k JOIN p USING (source) WHERE key <> '' GROUP BY source, key HAVING max(pages) >= 3 AND count(*) > 0.04 * max(pages)""")
def repeated_lines(spark, d):
    return D.boilerplate(_lines(spark, d), "source", "doc_id", "line", 0.04).select("source", F.md5("key").alias("key"), "n", "pages")


@query("""SELECT page_id, i - 1 AS i, link FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS i FROM (SELECT page_id, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL) AS l FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]+href\\s*=\\s*["'']([^"'']+)["'']', 1) AS a FROM pages)))""".replace("\\\\s", "\\s"))
def page_links(spark, d):
    return D.links(table(spark, d, "pages"), "page_id", "html")


@query()
def document_passages(spark, d):
    """Passages of about 1,500 characters that end with a sentence (a fold over sentences)."""
    return D.passages(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "k", F.length("passage").alias("chars"))


@query(r"""SELECT o_orderkey, 'Mr X, ' || CASE WHEN o_orderkey % 2 = 0 THEN 'residing at [address removed]' ELSE 'director' END || '. Age ' || o_custkey AS text FROM orders""")
def redacted_addresses(spark, d):
    text = F.expr("concat('Mr X, ', CASE WHEN o_orderkey % 2 = 0 THEN concat('residing at ', o_custkey, ', Long Street, Old Town') ELSE 'director' END, '. Age ', o_custkey)")
    return table(spark, d, "orders").select("o_orderkey", D.redacted(text).alias("text"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 5 + 1 AS n FROM orders) SELECT k, CAST(number AS INTEGER) AS number, 'Risk ' || number || ' of ' || k || '. See 99.' AS risk FROM (SELECT k, unnest(range(1, n + 1)) AS number FROM r)""")
def numbered_risks(spark, d):
    return _risks(table(spark, d, "orders"))


def _risks(o):
    text = F.concat(F.lit("Preface\n"), F.array_join(F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int")), lambda i: F.concat(i.cast("string"), F.lit(". Risk "), i.cast("string"), F.lit(" of "), F.col("o_orderkey").cast("string"), F.lit(". See 99."))), "\n"))
    r = o.select(F.col("o_orderkey").alias("k"), text.alias("t"))
    return D.numbered_risks(r, "k", "t")


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT k, CAST(CASE WHEN k % 3 <> 0 THEN day END AS DATE) AS day, '/doc/' || k AS link, 'Offer ' || k AS title FROM o WHERE k % 3 <> 0""")
def listing_rows(spark, d):
    return _listing(table(spark, d, "orders"))


def _listing(o):
    k = F.col("o_orderkey")
    row = F.concat(F.lit("<table><tr><td>Date</td></tr><tr><td>"), F.when(k % 3 != 0, F.date_format("o_orderdate", "MMM dd, yyyy")).otherwise(""), F.lit("</td><td><a href='/doc/"), k, F.lit("'><b>Offer</b> "), k, F.lit("</a></td></tr></table>"))
    return D.listing(o.select(k.alias("k"), row.alias("html")), "k", "html")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_nationkey = 3 THEN 'nation' WHEN c_custkey % 50 = 0 THEN 'sampled' END AS skip_reason, list_filter([CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_custkey % 50 = 0 THEN 'key' END], lambda x: x IS NOT NULL) AS problems FROM customer""")
def validated_rows(spark, d):
    c = T.with_skip_reason(table(spark, d, "customer"), [("negative", "c_acctbal < 0"), ("nation", "c_nationkey = 3"), ("sampled", "c_custkey % 50 = 0")])
    return T.invalid_rows(c, [("balance", "c_acctbal < 0"), ("key", "c_custkey % 50 = 0")]).select("c_custkey", "skip_reason", "problems")


@query("SELECT o_orderpriority AS artefact, list_sort(list(DISTINCT o_custkey)) AS ids FROM orders GROUP BY 1")
def manifests(spark, d):
    return T.manifest(table(spark, d, "orders").select(F.col("o_orderpriority").alias("artefact"), F.col("o_custkey").alias("id")))


@query("SELECT day, user_id, count(*) AS n FROM (SELECT CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, user_id FROM events) GROUP BY GROUPING SETS ((day, user_id), (day))")
def day_quota_counts(spark, d):
    return E.day_counts(table(spark, d, "events"), "user_id", "ts")


@query("""WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) SELECT user_id, event_type, round(max_by(value, seq), 6) AS status, max(seq) AS seq FROM e GROUP BY 1, 2""")
def stage_statuses(spark, d):
    from ..operators.windows import sequence

    e = sequence(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")])
    return E.stage_status(e, "user_id", "event_type", "value", "seq").select("user_id", "event_type", F.round("status", 6).alias("status"), "seq")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id = 7 AND event_id > 1000")
def resumed_events(spark, d):
    return E.after(table(spark, d, "events"), "user_id", 7, "event_id", 1000).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def expired_events(spark, d):
    return E.expired(table(spark, d, "events"), "ts", F.lit("2024-01-31").cast("timestamp"), 10).select("event_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'legacy' WHEN o_orderkey % 4 = 1 THEN 'stale_version' WHEN o_orderkey % 4 = 2 THEN 'stale_models' ELSE 'fresh' END AS state FROM orders""")
def cache_states(spark, d):
    k = F.col("o_orderkey") % 4
    version = F.when(k == 1, "v1").when(k > 1, "v2")
    return table(spark, d, "orders").select("o_orderkey", E.cache_state(version, "v2", F.when(k == 2, "m1").otherwise("m2"), "m2").alias("state"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS position FROM events")
def queue_positions(spark, d):
    return E.queue_positions(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "value", "event_id").select("event_id", "user_id", "position")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def remaining_work(spark, d):
    done = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return E.remaining(done, table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query()
def streamed_sequence(spark, d):
    """Gapless numbers per user from a stream over the events, through the state store into a table."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    numbered = E.numbered(stream, "user_id", "event_id")
    folder = T.run_folder(spark, "sequence")
    numbered.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(numbered.schema).parquet(f"{folder}/rows")


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS doubled, CASE WHEN o_orderkey % 7 = 3 THEN 1 ELSE 0 END AS attempt FROM orders WHERE o_orderkey % 7 <> 5")
def drained_orders(spark, d):
    """Orders as a queue of jobs: a seventh fails once and is done by the second try, a seventh fails to the end."""
    schema = table(spark, d, "orders").schema
    queue = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d).select("o_orderkey", "o_totalprice", "o_orderstatus")
    tries = []

    def work(jobs):
        tries.append(1)
        k = F.col("o_orderkey") % 7
        return jobs.select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("doubled"), F.when((k == 5) | ((k == 3) & F.lit(len(tries) == 1)), "busy").alias("error"))

    folder = T.run_folder(spark, "drain")
    W.drain(queue, work, "o_orderkey", folder, attempts=2).awaitTermination()
    return W.drained(spark, folder).select("o_orderkey", "doubled", "attempt")
