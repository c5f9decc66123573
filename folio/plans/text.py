"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N, text as X
from .registry import query, table

_COUNTS = r"""
c AS (
  SELECT doc_id, source,
    len(regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]*')) AS words,
    greatest(1, len(list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '[A-Za-z][A-Za-z''’-]*')))) AS sentences,
    coalesce(list_sum(list_transform(list_transform(regexp_extract_all(lower(text), '[a-z][a-z''’-]*'), lambda w: regexp_replace(w, '[''’-]+$', '')), lambda w:
      greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND w NOT LIKE '%le' AND w NOT LIKE '%ee' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))), 0) AS syllables
  FROM documents WHERE lang = 'en'
)"""


@query(f"""WITH {_COUNTS}
SELECT source, count(*) AS docs, sum(words) AS words, sum(sentences) AS sentences, sum(syllables) AS syllables,
  round(avg(CASE WHEN words = 0 THEN 0 ELSE 0.39 * words / sentences + 11.8 * syllables / words - 15.59 END), 6) AS grade,
  round(avg(CASE WHEN words = 0 THEN 0 ELSE 206.835 - 1.015 * words / sentences - 84.6 * syllables / words END), 6) AS ease
FROM c GROUP BY source""")
def readability_by_source(spark, d):
    docs = table(spark, d, "documents").where("lang = 'en'").select("source", X.reading_counts("text").alias("n"))
    return docs.groupBy("source").agg(
        F.count("*").alias("docs"), *[F.sum(f"n.{k}").alias(k) for k in ("words", "sentences", "syllables")],
        F.round(F.avg(X.fkgl(F.col("n"))), 6).alias("grade"), F.round(F.avg(X.flesch(F.col("n"))), 6).alias("ease"),
    )


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words, md5(k) AS key_hash, length(k) AS key_length FROM (
  SELECT doc_id, text, trim(regexp_replace(regexp_replace(lower(text), '\d+', '#', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS k FROM documents)""")
def line_keys(spark, d):
    k = X.line_key("text")
    return table(spark, d, "documents").select("doc_id", X.word_count("text").cast("long").alias("words"), F.md5(k).alias("key_hash"), F.length(k).alias("key_length"))


_NAMES = "concat(c_name, CASE c_nationkey % 5 WHEN 0 THEN ' Private Limited' WHEN 1 THEN ' Ltd.' WHEN 2 THEN ' & Sons IPO' WHEN 3 THEN ' (India) Pvt Ltd IPO' ELSE '' END)"


@query(rf"""WITH n AS (SELECT c_custkey, {_NAMES} AS name FROM customer)
SELECT c_custkey,
  trim(regexp_replace(regexp_replace(lower(name), '\b(?:limited|ltd|private|pvt|india|the)\b\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS company_key,
  trim(regexp_replace(regexp_replace(lower(replace(name, '&', ' and ')), '\b(?:limited|ltd|private|pvt|india|the)\b\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS name_key,
  trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(regexp_replace(trim(name), '(?i)\bipo\s*$', '')), '(?i)\b(limited|ltd)\b\.?\s*$', '')), '[^a-z0-9& ]+', ' ', 'g'), '\s+', ' ', 'g')) AS normal
FROM n""")
def company_names(spark, d):
    n = table(spark, d, "customer").select("c_custkey", F.expr(_NAMES).alias("name"))
    return n.select("c_custkey", X.company_key("name").alias("company_key"), X.name_key("name").alias("name_key"), X.normalize_company("name").alias("normal"))


@query(r"""SELECT o_orderkey, CASE WHEN length(sha256(CAST(o_orderkey AS VARCHAR))) = 64 THEN 'doc_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) END AS doc_id,
  'ipo-' || o_custkey || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ':prospectus' END || ':p' || (o_orderkey % 300) || ':c' || (o_orderkey % 7) AS passage_id,
  'ipo-' || o_custkey AS ipo, CASE WHEN o_orderstatus = 'F' THEN 'rhp' ELSE 'prospectus' END AS doc_type, CAST(o_orderkey % 300 AS INTEGER) AS page, CAST(o_orderkey % 7 AS INTEGER) AS k FROM orders""")
def ids_and_passages(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "rhp").otherwise("prospectus")
    o = o.select("o_orderkey", X.doc_id(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("doc_id"), X.passage_id(F.concat(F.lit("ipo-"), "o_custkey"), kind, F.col("o_orderkey") % 300, F.col("o_orderkey") % 7).alias("passage_id"))
    return o.withColumn("p", X.parse_passage_id("passage_id")).select("o_orderkey", "doc_id", "passage_id", "p.ipo", "p.doc_type", "p.page", "p.k")


_STOP = ",".join(f"'{w}'" for w in X.STOP_WORDS)


@query(rf"""WITH t AS (SELECT unnest(list_filter(regexp_extract_all(regexp_replace(lower(text), '(\d),(\d)', '\1\2', 'g'), '\d+(?:\.\d+)?|[a-z0-9_]+'), lambda x: x NOT IN ({_STOP}))) AS token FROM documents WHERE lang = 'en')
SELECT token, count(*) AS n FROM t GROUP BY token""")
def search_token_counts(spark, d):
    docs = table(spark, d, "documents").where("lang = 'en'")
    flat = F.regexp_replace(F.lower("text"), r"(?<=\d),(?=\d)", "")
    tokens = F.filter(F.regexp_extract_all(flat, F.lit(r"(\d+(?:\.\d+)?|[a-z0-9_]+)"), 1), lambda t: ~t.isin(X.STOP_WORDS))
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(r"""SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS squad,
  md5(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS compact FROM conversations WHERE NOT regexp_matches(text, '[^\x00-\x7F]')""")
def normalised_turns(spark, d):
    ascii_only = table(spark, d, "conversations").where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return ascii_only.select("conv_id", "turn", F.md5(X.squad_text("text")).alias("squad"), F.md5(X.compact("text")).alias("compact"))


_RISK = "concat('The company ', CASE o_orderkey % 6 WHEN 0 THEN 'may' WHEN 1 THEN 'might possibly' WHEN 2 THEN 'cannot assure that it will' WHEN 3 THEN 'has a risk; there can be no assurance that it could' WHEN 4 THEN 'will' ELSE 'did' END, ' earn Rs. ', CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR(20)), ' million, and results materially depend on demand, if any.')"
_REWRITE = "concat('It ', CASE o_custkey % 4 WHEN 0 THEN 'may' WHEN 1 THEN 'will certainly' WHEN 2 THEN 'could' ELSE 'does' END, ' earn money.')"
_HEDGE_RX = X.phrase_pattern(X.HEDGE_PHRASES)
_has = lambda col, words: "list_filter([" + ",".join(f"CASE WHEN regexp_matches(lower({col}), '\\b{w}\\b') THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL)"
_NEG = r"regexp_replace({}, '(?i)\b(?:not|no)\s+(?:be\s+)?(?:guaranteed|guarantee|certain|certainly|assured)\b', ' ', 'g')"


@query(rf"""WITH r AS (SELECT o_orderkey, {_RISK} AS risk, {_REWRITE} AS rewrite FROM orders),
h AS (SELECT o_orderkey, len(regexp_extract_all(risk, '{_HEDGE_RX}')) AS hedges, {_has('risk', X.CERTAINTY_HEDGES)} AS sh, {_has('rewrite', X.CERTAINTY_HEDGES)} AS oh,
  {_has(_NEG.format('risk'), X.DEFINITE_WORDS)} AS sd, {_has(_NEG.format('rewrite'), X.DEFINITE_WORDS)} AS od FROM r)
SELECT o_orderkey, hedges, hedges >= 3 AS flagged, CASE WHEN len(sh) > 0 AND len(oh) = 0 THEN 'hedge_dropped' WHEN len(list_filter(od, lambda x: NOT list_contains(sd, x))) > 0 THEN 'definite_added'
  WHEN len(sh) = 0 AND len(list_filter(oh, lambda x: x NOT IN ('risk', 'if'))) > 0 THEN 'hedge_added' END AS change FROM h""")
def hedging_and_certainty(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_RISK).alias("risk"), F.expr(_REWRITE).alias("rewrite"))
    return o.select("o_orderkey", X.hedge_count("risk").cast("long").alias("hedges"), (X.hedge_count("risk") >= 3).alias("flagged"), X.certainty_changed("risk", "rewrite").alias("change"))


_CELL = "CASE o_orderkey % 6 WHEN 0 THEN concat('(', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)), '.5)') WHEN 1 THEN concat('-', CAST(o_custkey AS VARCHAR(20)), '%') WHEN 2 THEN '-' WHEN 3 THEN concat('₹ ', CAST(o_custkey AS VARCHAR(20)), ',000.25') WHEN 4 THEN 'n.a.' ELSE CAST(o_orderkey AS VARCHAR(20)) END"


@query(rf"""WITH c AS (SELECT o_orderkey, regexp_extract(replace({_CELL}, ' ', ''), '\(?-?\d[\d,]*(?:\.\d+)?\)?') AS raw FROM orders)
SELECT o_orderkey, CASE WHEN raw <> '' THEN CAST(regexp_replace(raw, '[(),-]', '', 'g') AS DOUBLE) * CASE WHEN raw LIKE '(%)' OR raw LIKE '-%' OR raw LIKE '(-%' THEN -1 ELSE 1 END END AS value FROM c""")
def cell_numbers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.cell_number(F.expr(_CELL)).cast("double").alias("value"))


_INDIAN = "CASE WHEN length(t) <= 3 THEN t ELSE regexp_replace(reverse(regexp_replace(reverse(left(t, length(t) - 3)), '(\\d\\d)', '\\1,', 'g')), '^,', '') || ',' || right(t, 3) END"


@query(rf"""WITH p AS (SELECT o_orderkey, o_orderdate, CAST(CAST(o_totalprice * 1000 AS BIGINT) AS VARCHAR) AS t FROM orders)
SELECT o_orderkey, {_INDIAN} AS indian, format('{{:,}}', CAST(t AS BIGINT)) AS western, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS fiscal_year,
  CASE WHEN month(o_orderdate) BETWEEN 4 AND 6 THEN 1 WHEN month(o_orderdate) BETWEEN 7 AND 9 THEN 2 WHEN month(o_orderdate) >= 10 THEN 3 ELSE 4 END AS fiscal_quarter,
  CAST(CAST(o_orderdate AS DATE) - INTERVAL 4 YEAR AS DATE) AS four_years_before FROM p""")
def money_and_periods(spark, d):
    o = table(spark, d, "orders").withColumn("v", F.round(F.col("o_totalprice") * 1000).cast("long"))
    return o.select("o_orderkey", N.group_indian("v").alias("indian"), N.group_western("v").alias("western"), N.fiscal_year("o_orderdate").alias("fiscal_year"), N.fiscal_quarter("o_orderdate").alias("fiscal_quarter"), N.years_before("o_orderdate", 4).alias("four_years_before"))


@query("""WITH p AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS paise, o_orderkey % 3 AS k FROM orders), v AS (
  SELECT o_orderkey, CAST(paise AS DOUBLE) / 100 AS a, CAST(round(CAST(paise AS DECIMAL(18,0)) / 100000) AS BIGINT) * 1000 AS b, CAST(paise AS DOUBLE) / 100 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 0.04 ELSE 700 END AS c FROM p)
SELECT o_orderkey, floor(a / 1000 + 0.5) = floor(CAST(b AS DOUBLE) / 1000 + 0.5) AS same_in_thousands, abs(a - c) <= 0.0500001 AS within_tolerance FROM v""")
def amount_equality(spark, d):
    o = table(spark, d, "orders").withColumn("paise", F.round(F.col("o_totalprice") * 100).cast("long"))
    a = (F.col("paise").cast("decimal(20,0)") / 100).cast("decimal(24,2)")
    b = (F.round(F.col("paise").cast("decimal(18,0)") / 100000, 0).cast("long") * 1000).cast("decimal(24,2)")
    c = a + F.expr("CASE o_orderkey % 3 WHEN 0 THEN 0.00BD WHEN 1 THEN 0.04BD ELSE 700.00BD END")
    same = N.money_equal(a, F.lit(None).cast("string"), F.lit(2), b, F.lit("thousand"), F.lit(0))
    return o.select("o_orderkey", same.alias("same_in_thousands"), N.percent_equal(a, c).alias("within_tolerance"))


@query(r"""WITH a AS (SELECT conv_id, turn, text || ' [' || (turn % 4) || '] and [' || (conv_id % 9) || '][2] ०१२' AS answer FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, '\[\d\]', '   ', 'g'), '\[\d\d\]', '    ', 'g'), '\[\d\d\d\]', '     ', 'g'), '\[\d\d\d\d\]', '      ', 'g')) AS masked, list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda s: TRY_CAST(s AS INTEGER)), lambda i: i BETWEEN 1 AND 5)) AS cited_unordered,
  md5(translate(answer, '०१२३४५६७८९', '0123456789')) AS digits FROM a""".replace("list_distinct(", "list_sort(list_distinct(").replace("BETWEEN 1 AND 5))", "BETWEEN 1 AND 5)))"))
def answers_and_citations(spark, d):
    a = table(spark, d, "conversations").withColumn("answer", F.expr("concat(text, ' [', turn % 4, '] and [', conv_id % 9, '][2] ०१२')"))
    return a.select("conv_id", "turn", F.md5(X.mask_citations("answer")).alias("masked"), F.array_sort(X.cited("answer", 5)).alias("cited_unordered"), F.md5(X.ascii_digits("answer")).alias("digits"))


@query()
def amounts_in_text(spark, d):
    """Typed amounts read from sentences composed of order rows (spans are resolved in Python)."""
    text = F.expr("concat('Order of Rs. ', CAST(CAST(o_totalprice AS BIGINT) AS STRING), ' million, up ', o_custkey % 40, '.5% on ', o_orderkey, ' equity shares at ₹ ', o_custkey % 90 + 10, ' to ₹ ', o_custkey % 90 + 20, ' in ', year(o_orderdate))")
    o = table(spark, d, "orders").select("o_orderkey", N.parse_amounts(text).alias("a"))
    return o.select("o_orderkey", F.posexplode("a").alias("i", "x")).select("o_orderkey", "i", "x.kind", F.col("x.value").cast("double").alias("value"), F.col("x.high").cast("double").alias("high"), "x.scale", "x.raw")
