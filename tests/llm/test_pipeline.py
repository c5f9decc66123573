import random

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as P
from folio.llm import op3_minhash, op4_bpe

from .fixtures import corpus, lowered, words
from .test_near_and_substring import brute


def tables(spark, folder):
    """Documents in two languages with copies, a shared passage, a benchmark item and texts without letters."""
    rng = random.Random(4)
    rows, passage, _ = corpus()
    docs = [(d, t, "en") for d, t in dict(rows).items()]
    other = ["ção", "lhe", "uma", "des", "não"]
    docs += [(600 + i, " ".join("".join(rng.choice(other) for _ in range(3)) for _ in range(40)), "pt") for i in range(40)]
    item = " ".join(f"item{i}" for i in range(20))
    docs += [(700, f"{dict(rows)[9]} {item} tail words here", "en"), (701, "12 34", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    df.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, item


def test_stages_take_effect(spark, tmp_path):
    docs, item = tables(spark, str(tmp_path))
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, kept, columns = [n for n, _ in P.STAGES], {}, read.columns
    df = read
    for name, stage in P.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != names[-1]:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"] for r in df.collect()}
    assert not {400, 401, 402, 701} & kept["language"] and len(kept["language"]) >= len(docs) - 8
    text = {d: t for d, t, _ in docs if d in kept["language"]}
    groups = brute(list(text.items()), 5)
    assert kept["near_duplicates"] == {d for d in text if groups[d] == d}
    assert kept["repeated_passages"] == kept["near_duplicates"]
    assert kept["near_duplicates"] - kept["benchmark"] == {700}
    assert kept["bpe"] == kept["benchmark"]
    assert df.where("n_tokens > 0").count() == df.count()
    assert P.run(spark, str(tmp_path)).count() == len(kept["bpe"])


def test_an_empty_corpus_passes_through(spark, tmp_path):
    tables(spark, str(tmp_path))
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for name, stage in P.STAGES:
        empty = stage(spark, empty, str(tmp_path)) if name == "language" else empty
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_a_task_encodes_and_decodes_in_one_worker(spark, tmp_path):
    tables(spark, str(tmp_path))
    texts = ["a b", None, "", "<|endoftext|> x", "não é \U0001f600\n\n  end "]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    found = P.encode(spark, docs, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert found.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    two = op4_bpe.decode(op4_bpe.encode(docs, path).drop("text"), path).withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")
    assert sorted(found.collect()) == sorted(two.collect())
