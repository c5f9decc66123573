"""Queries over what texts state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import statements as S
from .registry import query, table

_pick = lambda items, k: f"CASE {k} % {len(items)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(items)) + " END"
_plain = lambda rx: rx.replace("'", "''")

_CAUSE = ["We depend on a few large customers", "Our business and results", "If we lose our licence", "Delays", "The Company’s operations", "Changes in rules on imports of goods", "Unless we renew our leases in time", "Our growth in the past"]
_EFFECT = [", our profit falls", " may adversely affect our reputation", ", which could hurt us", " could be materially impacted by a fall in demand", " have had an adverse trend due to weather", " resulting in losses from fires", " is told here", ". Sales fell"]
_TITLE = f"concat({_pick(_CAUSE, 'o_orderkey')}, {_pick(_EFFECT, 'o_custkey')})"
_FRONT = _plain(S.CONSEQUENCE.replace(r"\.\s+(?=[A-Z])", r"\.\s+[A-Z]"))  # RE2 has no look-ahead; what stands before is the same


@query(rf"""WITH t AS (SELECT o_orderkey, {_TITLE} AS t FROM orders), m AS (SELECT *, regexp_matches(t, '(?i){_FRONT}') AS told, regexp_extract(t, '(?is)^(.*?)(?:{_FRONT})', 1) AS before, regexp_extract(t, '(?is)^.*?(?:{_FRONT})(.*)$', 1) AS rest FROM t),
s AS (SELECT *, CASE WHEN told THEN before ELSE t END AS subject FROM m)
SELECT o_orderkey, CASE WHEN regexp_matches(t, '(?i){_plain(S.CONDITIONAL)}') THEN regexp_extract(t, '(?i){_plain(S.CONDITIONAL)}') WHEN told AND regexp_matches(t, '(?i){_plain(S.PASSIVE_EFFECT)}') THEN regexp_extract(rest, '(?is){_plain(S.PASSIVE_CAUSE)}.*$')
  WHEN len(regexp_extract_all(subject, '\S+')) >= 4 THEN subject ELSE t END AS subject FROM s""")
def title_subjects(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.subject_clause(F.expr(_TITLE)).alias("subject"))


_SAID = ["Investors should read it [1].", "The offer is attractive [2].", "Revenue rose [3].", "You may want to wait.", "निवेशकों को सावधान रहना चाहिए", "It is a good [4] investment", "Recommended reading", "Risk factors are listed"]


@query(f"SELECT conv_id, turn, regexp_matches(regexp_replace(concat(text, ' ', {_pick(_SAID, '(conv_id + turn)')}), '\\[\\d+\\]', ' ', 'g'), '(?i){_plain(S.OPINION)}') AS opinion FROM conversations")
def opinions(spark, d):
    said = F.concat("text", F.lit(" "), F.expr(_pick(_SAID, "(conv_id + turn)")))
    return table(spark, d, "conversations").select("conv_id", "turn", S.has_opinion(said).alias("opinion"))


_DAY = "(o_orderkey % 31 + 1)"
_NAMES = ["January", "Feb", "March", "Apr", "May", "June", "Jul", "August", "Sept", "October", "Nov", "December"]
_CLOSING = f"""concat('BID/OFFER OPENED ON May 1, 2024 ', CASE o_custkey % 4 WHEN 0 THEN 'BID/OFFER CLOSED ON: Monday, ' WHEN 1 THEN 'CLOSEED ' WHEN 2 THEN 'ISSUE CLOSED (1) Friday ' ELSE 'and ended on ' END,
  CASE WHEN o_custkey % 3 = 0 THEN concat(CAST({_DAY} AS VARCHAR(5)), 'th ', {_pick(_NAMES, 'o_orderkey')}, ', 2025') ELSE concat({_pick(_NAMES, 'o_orderkey')}, ' ', CAST({_DAY} AS VARCHAR(5)), ', 2025') END)"""


@query(f"""SELECT o_orderkey, CASE WHEN o_custkey % 4 < 3 AND o_orderkey % 12 <> 8 THEN try_cast(format('2025-{{:02d}}-{{:02d}}', CAST(o_orderkey % 12 + 1 AS INTEGER), CAST({_DAY} AS INTEGER)) AS DATE) END AS closed FROM orders""")
def closing_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.closed_date(F.expr(_CLOSING)).alias("closed"))


_KIND = [
    "Our Company will not receive any of the proceeds from the Offer.", "Our Company will not receive any proceeds from the Offer for Sale.", "Our Company does not have any identifiable promoter.", "Our Company is a non-banking financial company.",
    "We are a small private bank.", "The Company is one of India’s leading health insurers.", "Our Company makes pumps. It is an old firm.", "All amounts are Rs. in lacs unless stated.", "Amounts in INR millions", "Shown in crores of rupees", "Our company is registered with the IRDAI",
]
_SALE = _plain(S.PURE_SALE.replace(r"(?!\s+for\s+Sale)", ""))


@query(f"""WITH t AS (SELECT o_orderkey, concat({_pick(_KIND, 'o_orderkey')}, '  ', {_pick(_KIND, 'o_custkey')}) AS t FROM orders)
SELECT o_orderkey, regexp_matches(regexp_replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), '(?i)the Offer\\s+for\\s+Sale', '', 'g'), '(?i){_SALE}') AS pure_sale, regexp_matches(regexp_replace(t, '\\s+', ' ', 'g'), '(?i){_plain(S.NO_PROMOTER)}') AS no_promoter,
  {' OR '.join(f"regexp_matches(regexp_replace(t, '{chr(92)}s+', ' ', 'g'), '(?i){_plain(p)}')" for p in S.FINANCIAL)} AS financial,
  '₹ in ' || regexp_replace(regexp_replace(lower(coalesce(nullif(regexp_extract(t, '(?i){_plain(S.UNIT_SENTENCE)}', 1), ''), nullif(regexp_extract(t, '(?i){_plain(S.UNIT_SENTENCE)}', 2), ''), nullif(regexp_extract(t, '(?i){_plain(S.UNIT_SENTENCE)}', 3), ''))), 's$', ''), '^lac$', 'lakh') AS unit FROM t""")
def company_statements(spark, d):
    t = F.expr(f"concat({_pick(_KIND, 'o_orderkey')}, '  ', {_pick(_KIND, 'o_custkey')})")
    return table(spark, d, "orders").select("o_orderkey", S.is_pure_sale(t).alias("pure_sale"), S.names_no_promoter(t).alias("no_promoter"), S.is_financial_company(t).alias("financial"), S.stated_unit(t).alias("unit"))
