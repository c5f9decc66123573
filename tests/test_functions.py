from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folio.functions import numbers as N, text as X
from folio.operators import documents as D, registry, rules as R, similar as V, stats as S, windows as O


def one(spark, column, **values):
    types = {str: "string", int: "long", float: "double", Decimal: "decimal(38,6)", date: "date", bool: "boolean", type(None): "string"}
    df = spark.range(1).select(*[F.lit(v).cast(types[type(v)]).alias(k) for k, v in values.items()] or ["id"])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "n"), [("cat", 1), ("table", 2), ("make", 1), ("see", 1), ("the", 1), ("revenue", 2), ("rhythm", 1), ("x", 1)])
def test_syllables(spark, word, n):
    assert one(spark, X.syllables(F.col("w")), w=word) == n


@pytest.mark.parametrize(("text", "n"), [("there can be no assurance", 1), ("may or might", 2), ("risks and a risk", 2), ("in the event, if any", 2), ("mayor", 0), ("", 0)])
def test_hedges_count_the_longest_phrase_once(spark, text, n):
    assert one(spark, X.hedge_count("t"), t=text) == n


@pytest.mark.parametrize(("a", "b", "why"), [("It may rise", "It rises", "hedge_dropped"), ("It rises", "It will rise", "definite_added"), ("It rises", "It could rise", "hedge_added"), ("It may rise", "It might rise", None), ("not guaranteed", "It is not guaranteed", None)])
def test_certainty(spark, a, b, why):
    assert one(spark, X.certainty_changed("a", "b"), a=a, b=b) == why


@pytest.mark.parametrize(("cell", "value"), [("1,234.5", "1234.5"), ("(3.2)", "-3.2"), ("-7%", "-7"), ("45.6x", "45.6"), ("₹ 10", "10"), ("−5", "-5"), ("n.a.", None), ("-", None), ("", None)])
def test_cell_numbers(spark, cell, value):
    found = one(spark, N.cell_number("c"), c=cell)
    assert found == (None if value is None else Decimal(value))


@pytest.mark.parametrize(("word", "name"), [("Crores", "crore"), ("Cr.", "crore"), ("mn", "million"), ("lacs", "lakh"), ("लाख", "lakh"), ("lakh  crore", "lakh crore"), ("dozen", None)])
def test_scale_names(spark, word, name):
    assert one(spark, N.scale_name("w"), w=word) == name


@pytest.mark.parametrize(("n", "text"), [(0, "0"), (999, "999"), (1000, "1,000"), (123456, "1,23,456"), (1234567, "12,34,567"), (-12345678, "-1,23,45,678")])
def test_indian_grouping(spark, n, text):
    assert one(spark, N.group_indian("n"), n=n) == text


def test_dates(spark):
    assert one(spark, N.years_before("d", 1), d=date(2024, 2, 29)) == date(2023, 2, 28)
    assert one(spark, N.fiscal_year("d"), d=date(2024, 3, 31)) == 2024
    assert one(spark, N.fiscal_year("d"), d=date(2024, 4, 1)) == 2025
    assert one(spark, N.fiscal_quarter("d"), d=date(2024, 1, 15)) == 4
    assert one(spark, N.cover_date("t"), t="Dated: March 5, 2024 (this)") == date(2024, 3, 5)
    assert one(spark, N.period_of("t"), t="FY2024-25").asDict() == {"kind": "year", "year": 2025, "part": None}
    assert one(spark, N.period_of("t"), t="Q3 FY25").asDict() == {"kind": "quarter", "year": 2025, "part": 3}
    assert one(spark, N.period_of("t"), t="Particulars") is None


@pytest.mark.parametrize(("a", "sa", "pa", "b", "sb", "pb", "same"), [
    ("1250000000", "crore", 0, "1249800000", "million", 1, True), ("1250000000", "crore", 0, "1240000000", "crore", 0, False), ("100", None, 0, "100.4", None, 1, True), ("15", "thousand", 0, None, None, 0, None),
])
def test_money_equality(spark, a, sa, pa, b, sb, pb, same):
    v = lambda x: F.lit(None if x is None else Decimal(x)).cast("decimal(38,6)")
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, N.money_equal(v(a), s(sa), F.lit(pa), v(b), s(sb), F.lit(pb))) == same


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 10**7), st.sampled_from([*N.MULTIPLIERS, None]), st.sampled_from(["₹ ", "Rs. ", "US$ "]), st.booleans())
def test_written_amounts_read_back(n, scale, currency, grouped):
    text = f"It was {currency}{n:,} {scale or ''}".strip() if grouped else f"It was {currency}{n} {scale or ''}".strip()
    (found,) = N._parse(text)
    assert found["kind"] == "money" and found["value"] == Decimal(n) * N.MULTIPLIERS.get(scale, 1) and text[found["start"] : found["end"]] == found["raw"]


@pytest.mark.parametrize(("text", "kinds"), [("5% and 50 bps", ["percent", "percent"]), ("₹ 440 to ₹ 463", ["range"]), ("from ₹ 1 crore to ₹ 2 crore", ["money", "money"]), ("[●] equity shares", ["placeholder"]), ("in 2024 on page 7", []), ("1,000 equity shares", ["count"]), (None, [])])
def test_amount_kinds(text, kinds):
    assert [x["kind"] for x in N._parse(text)] == kinds


def test_passage_ids(spark):
    ids = spark.createDataFrame([("a-1:p3:c4",), ("a:drhp:p3:c0",), ("bad",), (None,)], "id string").select(X.parse_passage_id("id").alias("p")).collect()
    assert [r["p"] and tuple(r["p"]) for r in ids] == [("a-1", "rhp", 3, 4), ("a", "drhp", 3, 0), None, None]


def test_printed_pages_and_sentences(spark):
    assert one(spark, X.printed_page("l"), l="Page 12") == "12"
    assert one(spark, X.printed_page("l"), l=" xiv ") == "xiv"
    assert one(spark, X.printed_page("l"), l="iiii") is None
    assert one(spark, X.first_sentence("t"), t="Mr. A owns it. He left.") == "Mr. A owns it."


@pytest.mark.parametrize(("row", "check", "status"), [
    ({"profit": [-1, -2, -3]}, "RF01", "concern"), ({"profit": [-1, 2, None]}, "RF01", "watch"), ({"profit": [None, 1, 1]}, "RF01", "not_available"), ({"profit": [1, -1, 1]}, "RF01", "ok"),
    ({"cash_flow": [1, -1, -1]}, "RF02", "concern"), ({"cash_flow": [-1, 1, 1]}, "RF02", "watch"), ({"debt": 201, "net_worth": 100}, "RF03", "concern"), ({"debt": 200, "net_worth": 100}, "RF03", "watch"),
    ({"debt": 100, "net_worth": 100}, "RF03", "ok"), ({"debt": 100, "net_worth": -5}, "RF03", "not_available"), ({"is_lender": True}, "RF03", "not_applicable"), ({"fresh": 10, "ofs": 90}, "RF04", "concern"),
    ({"fresh": 20, "ofs": 80}, "RF04", "watch"), ({"fresh_blank": True, "ofs": 0}, "RF04", "ok"), ({"fresh_blank": True, "ofs": 5}, "RF04", "not_available"), ({"price": 100, "promoter_cost": 5}, "RF05", "concern"),
    ({"price": 25, "promoter_cost": 5}, "RF05", "watch"), ({"price": 5}, "RF05", "not_available"), ({"has_promoter": False}, "RF06", "concern"), ({"promoter_pct": 25}, "RF06", "watch"), ({"promoter_pct": 40}, "RF06", "ok"),
    ({"general_pct": 30}, "RF07", "concern"), ({"general_pct": 20}, "RF07", "ok"), ({"fresh": 0, "ofs": 5, "general_pct": 50}, "RF07", "not_applicable"), ({"litigation": 11, "net_worth": 100, "criminal_cases": 0}, "RF08", "concern"),
    ({"litigation": 10, "net_worth": 100, "criminal_cases": 0}, "RF08", "ok"), ({"criminal_any": True}, "RF08", "watch"), ({"criminal_cases": 0}, "RF08", "not_available"), ({"related": 26, "revenue": 100}, "RF09", "concern"),
    ({"related": 10, "revenue": 100}, "RF09", "ok"), ({"top1_pct": 41}, "RF10", "concern"), ({"top10_pct": 51}, "RF10", "watch"), ({"top1_pct": 20, "top10_pct": 50}, "RF10", "ok"), ({"pe": 26, "peer_pe": 10}, "RF11", "concern"),
    ({"pe": -1, "peer_pe": 10}, "RF11", "not_applicable"), ({"pe": 15, "peer_pe": 10}, "RF11", "ok"), ({"auditor": "qualified"}, "RF12", "concern"), ({"auditor": "caro"}, "RF12", "watch"), ({}, "RF12", "not_available"),
    ({"pledged_pct": 10}, "RF13", "watch"), ({"pledged_pct": 11}, "RF13", "concern"), ({"pledged_pct": 0}, "RF13", "ok"),
])
def test_checks(spark, row, check, status):
    full = {n.split()[0]: None for n in R.INPUTS.split(", ")} | {"is_lender": False, "has_promoter": True, "fresh_blank": False, "ofs_blank": False} | row
    dec = lambda v: [None if x is None else Decimal(x) for x in v] if isinstance(v, list) else Decimal(v) if isinstance(v, int) and not isinstance(v, bool) else v
    values = tuple(v if k == "criminal_cases" else dec(v) for k, v in full.items())
    df = spark.createDataFrame([(1, *values)], f"id int, {R.INPUTS}")
    assert R.flags(df, "id").where(F.col("check") == check).first()["status"] == status


def test_guards(spark):
    ask = lambda q: one(spark, R.guarded(F.col("q")), q=q)
    assert ask("Should I buy?") == "advice" and ask("home address of Mr X") == "privacy" and ask("registered office and PAN?") is None and ask("What is the GMP?") == "forecast" and ask("How big is it?") is None
    assert one(spark, R.output_leak(F.col("a")), a="PAN ABCDE1234F") == "id_number" and one(spark, R.output_leak(F.col("a")), a="mail x@y.in") == "contact"


def test_limiter_forgets_denied_calls(spark):
    rows = [(i, 1, t) for i, t in enumerate([0, 10, 20, 30, 61, 62, 71])]
    df = spark.createDataFrame(rows, "id long, who long, s long").withColumn("ts", F.timestamp_seconds("s"))
    found = {r["id"]: r["admitted"] for r in O.admitted(df, "who", "ts", "id", 2, 60).collect()}
    assert [found[i] for i in range(7)] == [True, True, False, False, True, False, True]


def test_statistics(spark):
    assert one(spark, S.mcnemar(F.lit(1), F.lit(9))) == pytest.approx(0.021484375)
    assert one(spark, S.mcnemar(F.lit(0), F.lit(0))) == 1.0
    w = one(spark, S.wilson(F.lit(8), F.lit(10)))
    assert (round(w["low"], 4), round(w["high"], 4)) == (0.4902, 0.9433)
    assert tuple(one(spark, S.wilson(F.lit(0), F.lit(0)))) == (0.0, 0.0)
    points = F.array(*[F.lit(float(x)) for x in range(0, 101, 10)])
    assert [one(spark, S.percentile_rank(F.lit(x), points)) for x in (-1.0, 0.0, 5.0, 95.0, 100.0, 500.0)] == [0.0, 0.0, 5.0, 95.0, 100.0, 100.0]


def test_known_neighbours(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 2, [0.99, 0.1]), (3, 3, [0.0, 1.0]), (4, 1, [1.0, 0.01]), (5, 4, [0.0, 0.0])]
    bank = spark.createDataFrame(rows, "id long, key int, vec array<double>")
    n = V.novelty(bank.where("id = 1").select(F.col("id").alias("q_id"), F.col("key").alias("q_key"), F.col("vec").alias("q_vec")), bank, 0.9).first()
    assert n["novelty"] == pytest.approx(1 / 3) and [x["key"] for x in n["nearest"]] == [2, 3, 4]


def test_folds_over_documents(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(200)) + " " + "x" * 5000
    df = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "short")], "id long, t string")
    found = D.passages(df, "id", "t").collect()
    assert {r["id"] for r in found} == {1} and all(15 <= len(r["passage"]) <= 2100 for r in found)
    items = D.numbered_risks(spark.createDataFrame([(1, "Intro\n1. One\nsee\n3. not this\n2. Two"), (2, None)], "id long, t string"), "id", "t").collect()
    assert [(r["number"], r["risk"]) for r in items] == [(1, "One\nsee\n3. not this"), (2, "Two")]


def test_registry_and_stages():
    registry.register("kind", "a")(lambda: object())
    assert registry.get("kind", "a") is registry.get("kind", "a")
    with pytest.raises(KeyError, match="there are: a"):
        registry.get("kind", "b")
    fail = lambda: 1 / 0
    s = registry.Stage
    assert registry.run_stages([s("a", int), s("b", fail), s("c", int, ("b",)), s("d", int, ("a",), done=lambda: True)]) == ("partial", {"a": "done", "b": "failed", "c": "skipped", "d": "cached"})
    assert registry.run_stages([s("a", fail, critical=True), s("b", int)])[0] == "failed"
