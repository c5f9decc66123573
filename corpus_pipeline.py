"""A corpus pipeline: documents in, token ids of clean documents out.

Each stage gets what its predecessor kept, as a table that was written and read again, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.llm import op2_substring, op3_minhash, op4_bpe, op7_decontaminate, op10_langid
from folio.llm.store import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; null and empty texts and texts without letters go.

    Repeated rows are judged alike; of equally likely languages the first by name is told. Without labelled
    documents nothing can be told, so an empty table stays empty and a table without labels loses all rows."""
    judged = op10_langid.predict(docs, op10_langid.train(docs))
    return judged.where("not rejected").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the one with the
    least doc_id. Rows that repeat both doc_id and text count once. Null texts and texts without words are linked
    with nothing and stay; a null doc_id is the last choice of its group. An empty table stays empty."""
    found = op3_minhash.near_duplicates(docs, shingle=5, percent=80, scratch=Scratch(spark, "pipeline-near"))
    one = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("k"))
    keys = one.select("k.doc_id", "k.text_hash").unionByName(found.where("n_shingles = 0").select("doc_id", "text_hash").distinct())
    keys = keys.select(F.col("doc_id").alias("kept_doc"), F.col("text_hash").alias("kept_hash"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.struct("*").alias("row"))
    kept = rows.join(keys, rows["doc"].eqNullSafe(keys["kept_doc"]) & (rows["hash"] == keys["kept_hash"]))
    return kept.dropDuplicates(["doc", "hash"]).select("row.*")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that a document with a smaller doc_id keeps; null doc_ids come last.
    Null and empty texts stay as they are, and so does an empty table."""
    cut = op2_substring.remove(docs, Scratch(spark, "pipeline-substring"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 80 % of its shingles. Null and empty texts hold none, null and empty
    items are held nowhere, a repeated doc_id is judged by each of its texts."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return op7_decontaminate.decontaminate(docs, items, Scratch(spark, "pipeline-benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of their decoding, which must be the text's. Null and empty texts
    have no ids."""
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return op4_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer).drop("text")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark", drop_benchmark_text),
    ("bpe", encode),
]

#: SQL can't express the learnt language model, the sketches or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents, each stage written as Parquet and reread as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
