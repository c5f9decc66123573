import pytest

from folio import queries as Q

QUERIES = Q.queries()


def keys(spark, data, name, column):
    return {r[0] for r in spark.read.parquet(f"{data}/{name}.parquet").select(column).distinct().collect()}


@pytest.mark.parametrize(
    ("name", "table", "column", "key", "told"),
    [
        ("table_grids", "lineitem", "l_orderkey", "l_orderkey", lambda k: True),
        ("contents_entries", "orders", "o_orderkey", "o_orderkey", lambda k: True),
        ("numbered_risks", "orders", "o_orderkey", "k", lambda k: True),
        ("listing_rows", "orders", "o_orderkey", "k", lambda k: k % 3 != 0),  # the others have no date
        ("positive_passages", "orders", "o_orderkey", "k", lambda k: True),
    ],
)
def test_every_key_of_the_table_has_rows(spark, data, name, table, column, key, told):
    found = {r[0] for r in QUERIES[name](spark, data).select(key).distinct().collect()}
    assert found == {k for k in keys(spark, data, table, column) if told(k)}


def test_seeds_of_every_order_get_negatives(spark, data):
    positive = QUERIES["positive_passages"](spark, data).groupBy("k").count().collect()
    negative = {r[0]: r[1] for r in QUERIES["negative_passages"](spark, data).groupBy("k").count().collect()}
    assert {r[0]: r[1] for r in positive}.keys() == negative.keys() == keys(spark, data, "orders", "o_orderkey")
    assert all(negative[r[0]] <= r[1] for r in positive)


@pytest.mark.parametrize("name", ["bm25_top_passages", "fused_search_with_cues", "answered_or_abstained"])
def test_every_benchmark_item_is_asked(spark, data, name):
    found = {r[0] for r in QUERIES[name](spark, data).select("item_id").distinct().collect()}
    assert found == keys(spark, data, "benchmark", "item_id")
