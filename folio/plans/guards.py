"""Queries over what people may not be asked and told."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards as G
from .registry import query, table

_q = lambda s: s.replace("'", "''")
_case = lambda text, rules, but: "CASE " + " ".join(f"WHEN {but if name != 'identity_number' or 'ASKS' in but else 'true'} AND regexp_matches({text}, '{_q(rx)}') THEN '{name}'" for name, rx in rules) + " END"


@query(f"""WITH t AS (SELECT conv_id, turn, trim(text) AS text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS plain FROM conversations)
SELECT conv_id, turn, {_case("text", G.TELLS, f"NOT regexp_matches(plain, '{_q(G.BUSINESS)}')")} AS category FROM t""")
def private_turns(spark, d):
    """Turns that tell a person's address, contact or identity number, by the first rule that they fit."""
    return table(spark, d, "conversations").select("conv_id", "turn", G.private_answer(F.col("text"))["category"].alias("category"))


_ASKED = "CASE o_orderkey % 6 WHEN 0 THEN 'What is the ' WHEN 1 THEN 'Tell me the personal ' WHEN 2 THEN 'Give me Director''s ' WHEN 3 THEN 'Is there any ' WHEN 4 THEN 'Where does the owner live, and ' ELSE 'Does the registrar know the ' END || CASE o_custkey % 5 WHEN 0 THEN 'Phone' WHEN 1 THEN 'revenue' WHEN 2 THEN 'home  address' WHEN 3 THEN 'PAN' ELSE 'e-mail' END || CASE o_orderstatus WHEN 'F' THEN ' of the promoter?' WHEN 'O' THEN ' number of the issue?' ELSE ' in 1998?' END"


@query(f"""WITH q AS (SELECT o_orderkey, trim(regexp_replace(lower({_ASKED}), '\\s+', ' ', 'g')) AS plain FROM orders)
SELECT o_orderkey, {_case("plain", G.ASKS, f"('ASKS' <> '' AND NOT regexp_matches(plain, '{_q(G.BUSINESS)}'))")} AS category FROM q""")
def private_questions(spark, d):
    """Questions put together from orders, by the first rule on personal data that they fit."""
    asked = F.expr(_ASKED.replace("''", "\\'"))
    return table(spark, d, "orders").select("o_orderkey", G.private_question(asked)["category"].alias("category"))
