"""Cases that reviews found: queries over changed tables against their SQL, and operators against brute force."""

import hashlib
import os
import random
from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from folio import queries as Q
from folio.functions.md5 import Tails
from folio.operators import extraction as X, joins as J, splits as P

from .compare import TABLES, spark_rows, sql_rows
from .test_names import matches

QUERIES, SQL = Q.queries(), Q.oracle_sql()


def changed(data, folder, **tables):
    """A folder of the test's tables, some of them replaced by what a query over the others gives."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
        if t not in tables:
            os.symlink(f"{data}/{t}.parquet", f"{folder}/{t}.parquet")
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
    return str(folder)


def test_peer_medians_at_halves_and_just_over_the_bound(spark, data, tmp_path):
    rows = [("a", 1, 20.003), ("a", 2, 30.5), ("b", 1, 31.005), ("c", 3, 93.015), ("d", 7, 40.0), ("e", 1, 19.999)]
    d = changed(data, tmp_path, part="SELECT * REPLACE (b AS p_brand, 1::INTEGER AS p_size, v AS p_retailprice, k::BIGINT AS p_partkey) FROM (SELECT * FROM part LIMIT 1), (VALUES " + ", ".join(f"('{b}', {k}, {v}::DOUBLE)" for b, k, v in rows) + ") AS x(b, k, v)")
    got = spark_rows(QUERIES["peer_medians"](spark, d))
    assert got == sql_rows(SQL["peer_medians"], d)
    assert len(got[1]) == 5


def test_a_price_is_not_put_together_from_other_numbers(spark, data, tmp_path):
    lines = [(1, 33088, 48, 50.0), (2, 7, 41, 33088.48), (3, 3308848, 5, 70.5), (1, 123456, 3, 99.0), (2, 8, 9, 1234.56)]
    d = changed(data, tmp_path, lineitem="SELECT * REPLACE (o::BIGINT AS l_orderkey, n::INTEGER AS l_linenumber, p::BIGINT AS l_partkey, q::DOUBLE AS l_quantity, e::DOUBLE AS l_extendedprice) FROM (SELECT * FROM lineitem LIMIT 1), range(10) AS r(o), (VALUES " + ", ".join(map(str, lines)) + ") AS x(n, p, q, e)")
    got = spark_rows(QUERIES["located_prices"](spark, d))
    assert got == sql_rows(SQL["located_prices"], d)
    assert len(got[1]) == 50


def test_counts_of_reference_windows_make_no_pairs(spark):
    rng = random.Random(3)
    day = lambda: date(2000, 1, 1) + timedelta(rng.randrange(2600))
    some = lambda x: x if rng.random() < 0.95 else None
    asked = [(i, some(rng.randrange(6)), some(day())) for i in range(60)] + [(99, 1, date(1990, 1, 1)), (100, 2, date(2004, 2, 29))]
    past = [(i, some(rng.randrange(6)), some(day())) for i in range(30, 160)]
    a = spark.createDataFrame(asked, "id long, company int, day date").repartition(3)
    b = spark.createDataFrame(past, "ref_id long, ref_company int, ref_day date").repartition(3)
    pairs = P.reference_window(a, b.withColumn("ref_id", F.col("ref_id") + 1000))
    want = {(r["id"], r["n"], r["f"]) for r in pairs.groupBy("id").agg(F.count("*").alias("n"), F.min("ref_id").alias("f")).collect()}
    counts = P.reference_counts(a, b.withColumn("ref_id", F.col("ref_id") + 1000))
    assert {tuple(r) for r in counts.collect()} == want and len(want) > 20
    # a thousand rows a day, as many pairs a window as rows: the join tells days alone
    many = spark.range(20000).select(F.col("id").alias("ref_id"), (F.col("id") % 50).alias("ref_company"), F.lit("2001-01-01").cast("date").alias("ref_day"))
    asks = spark.range(2000).select("id", (F.col("id") % 50).alias("company"), F.lit("2002-01-01").cast("date").alias("day"))
    assert {tuple(r)[1:] for r in P.reference_counts(asks, many).collect()} == {(19600, 0), (19600, 1)}


def test_names_with_common_segments_are_compared_once_and_told_by_their_letters(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(J, "SAME_SEGMENT", 3)
    names = [f"customer {rng.randrange(3000):09d}" for _ in range(150)] * 3
    listed = [f"customer {i * 7:09d}" for i in range(120)]
    seen = []
    real = DataFrame.mapInPandas
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda self, f, schema, **k: (seen.append(self.count()), real(self, f, schema, **k))[1])
    left = spark.createDataFrame(list(enumerate(names)), "k long, name string")
    right = spark.createDataFrame([(x,) for x in listed], "name string")
    got = {(r["k"], r["b"]) for r in J.name_matches(left, right, "k", "name").collect()}
    assert got == {(k, b) for k, a in enumerate(names) for b in listed if matches(a, b, 0.9)} and got
    assert seen[0] < len(set(names)) * len(listed) / 3  # every pair shares "customer", and each name stands three times
    assert all(J._apart(a, b, d) == (len(a) + len(b) - 2 * common(a, b) <= d) for a in ("abcab", "", "xaabc", "cba") for b in ("abcab", "bca", "a", "") for d in range(6))


def common(a, b):
    """Letters that two words have in common, in order."""
    return max(common(a[:-1], b), common(a, b[:-1]), (common(a[:-1], b[:-1]) + 1) * (a[-1] == b[-1])) if a and b else 0


def test_passages_with_and_without_a_value(spark):
    rng = random.Random(6)
    seeds = [(k, k % 3, rng.choice(["Rs 1", "Rs 12", "a", "ba", "", "x.y"]), "") for k in range(40)] + [(41, 1, None, ""), (42, 9, "a", "")]
    passages = [(i, i % 3, rng.choice(["Rs 1", "ab", "", "x"]) + " ba Rs 123 x.y"[rng.randrange(12) :]) for i in range(60)] + [(61, 1, None)]
    a, b = spark.createDataFrame(seeds, "k long, doc long, value string, keyword string"), spark.createDataFrame(passages, "passage long, doc long, text string")
    found = X.positives(a, b, "k", "doc", 4)
    has = {k: [p for p, e, t in passages if e == d and v is not None and t is not None and v in t] for k, d, v, _ in seeds}
    assert {(r["k"], r["passage"], r["n"]) for r in found.collect()} == {(k, p, i + 1) for k, ps in has.items() for i, p in enumerate(ps[:4])}
    order = lambda k, p: (hashlib.md5(f"2026:{k}:{p}".encode()).hexdigest(), p)
    lacks = {k: sorted((p for p, e, t in passages if e == d and v is not None and t is not None and v not in t), key=lambda p: order(k, p)) for k, d, v, _ in seeds}
    got = X.negatives(found, a, b, "k", "doc").collect()
    assert {(r["k"], r["passage"], r["n"]) for r in got} == {(k, p, i + 1) for k, ps in lacks.items() for i, p in enumerate(ps[: min(4, len(has[k]))])} and got


@pytest.mark.parametrize("prefix", ["", "2026:1", "2026:12:", "2026:12345678901:", "p" * 25, "p" * 26, "p" * 27, "p" * 28, "p" * 40])
def test_digests_of_many_strings(prefix):
    texts = ["", "1", "12", "123", "1234567", "v" * 26, "w" * 27, "x" * 46, "y" * 60, *map(str, range(1000, 1100))]
    want = [int(hashlib.md5((prefix + t).encode()).hexdigest()[:16], 16) for t in texts]
    assert list(map(int, Tails([t.encode() for t in texts]).heads(prefix.encode()))) == want
