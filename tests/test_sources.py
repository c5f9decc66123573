from folio.sources import tables as T
from folio.streaming import events as E


def test_absent_files_are_empty_tables(spark, tmp_path):
    assert T.read_jsonl(spark, f"{tmp_path}/none", "a int").count() == 0
    assert T.read_csv(spark, f"{tmp_path}/none", "a int").count() == 0


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2020), (2, None, 2021)], "id int, t string, year int")
    T.write_jsonl(df, f"{tmp_path}/j", ["id"])
    assert T.read_jsonl(spark, f"{tmp_path}/j", "id int, t string, year int").orderBy("id").collect() == df.orderBy("id").collect()
    T.write_csv(df, f"{tmp_path}/c")
    assert T.read_csv(spark, f"{tmp_path}/c", "id int, t string, year int").count() == 2
    T.write_parquet(df, f"{tmp_path}/p", ["year"])
    found = T.read_years(spark, f"{tmp_path}/p", ["id"], (2021, 2030))
    assert [r["id"] for r in found.collect()] == [2]


def test_invalid_rows_stop_a_write(spark, tmp_path):
    df = spark.createDataFrame([(1,), (-1,)], "a int")
    assert T.write_if_valid(df, [("negative", "a < 0")], f"{tmp_path}/v").count() == 1
    assert not T.exists(spark, f"{tmp_path}/v")
    assert T.write_if_valid(df.where("a > 0"), [("negative", "a < 0")], f"{tmp_path}/v").count() == 0
    assert T.exists(spark, f"{tmp_path}/v")


def test_page_maps_and_profiles(spark):
    df = spark.sql("select 1 as id, map('Page_10', 'j', 'Page_2', 'b', 'x', 'no') as pages")
    assert [tuple(p) for p in T.page_texts(df, "pages").first()["pages"]] == [(2, "b"), (10, "j")]
    rows = {r["column"]: r for r in T.profile(spark.createDataFrame([(1, None), (2, "a")], "a int, b string")).collect()}
    assert rows["b"]["values"] == 1 and rows["b"]["missing"] == 0.5


def test_streams_number_and_limit(spark, tmp_path):
    rows = [(i, i % 2, f"2024-01-01 00:00:{i:02d}") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, who long, ts string")
    df.withColumn("ts", df.ts.cast("timestamp")).write.parquet(f"{tmp_path}/s/x.parquet")
    stream = lambda: spark.readStream.schema("id long, who long, ts timestamp").parquet(f"{tmp_path}/s/x.parquet")
    for name, out in (("n", E.numbered(stream(), "who", "id")), ("l", E.limited(stream(), "who", "ts", "id", 2))):
        out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c{name}").trigger(availableNow=True).start().awaitTermination()
    assert {(r["who"], r["seq"]) for r in spark.table("n").collect()} == {(w, s) for w in (0, 1) for s in range(1, 6)}
    assert sum(r["admitted"] for r in spark.table("l").collect()) == 4
