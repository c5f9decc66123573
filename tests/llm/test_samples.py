"""Samples for learning stay within their bounds whatever the ids are."""

from pyspark.sql import functions as F

from folio.llm import op8_toxicity as X, op10_langid as G


def texts(n, *columns):
    return f"concat('word', id % {n}, ' of row ', id % {n}) as text", *columns


def test_languages_with_one_id_with_null_ids_and_with_copies(spark):
    one = spark.range(100_000).selectExpr("7L as doc_id", *texts(100_000), "'xx' as lang")
    null = spark.range(100_000).selectExpr("cast(null as long) as doc_id", *texts(100_000), "'yy' as lang")
    copies = spark.range(100_000).selectExpr("3L as doc_id", *texts(300), "'zz' as lang")
    few = spark.range(40).selectExpr("id as doc_id", *texts(40), "'qq' as lang")
    found, langs = G.sample(one.unionByName(null).unionByName(copies).unionByName(few), 500)
    n = {k: langs.count(k) for k in ("xx", "yy", "zz", "qq")}
    assert 400 < n["xx"] < 600 and 400 < n["yy"] < 600 and n["zz"] == 300 and n["qq"] == 40
    assert len(set(zip(found, langs, strict=True))) == len(found)
    assert 150 < len(G.sample(one, 10_000, 5_000)[0]) < 350  # some 21 bytes each


def test_toxic_rows_of_one_id(spark):
    docs = spark.range(100_000).selectExpr("case when id % 1000 = 1 then id else 7 end as doc_id", *texts(100_000))
    docs = docs.unionByName(spark.range(100_000).selectExpr("8L as doc_id", *texts(5))).unionByName(spark.range(10).selectExpr("9L as doc_id", "cast(null as string) as text"))
    labels = spark.range(2000).select((F.col("id") * 1000 + 1).alias("doc_id"), F.lit(0).alias("toxic")).unionByName(spark.createDataFrame([(7, 1), (8, 0), (8, 1), (9, 1), (None, 1), (7, None)], "doc_id long, toxic int"))
    found, toxic, _ = X.sample(docs, labels, 300, 400)
    assert 200 < sum(toxic) < 420 and 8 <= len(toxic) - sum(toxic) <= 40 and len(set(found)) == len(found)
    assert len(X.sample(docs, labels, 300, 400, 3000)[0]) < 400
