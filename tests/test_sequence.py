"""Global running numbers."""

from pyspark.sql import functions as F

from millrace.operators.sequence import numbered


def test_numbers_follow_the_order_for_any_partitioning(spark):
    rows = spark.range(0, 3000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("k"))
    want = [(r.k, r.id) for r in rows.orderBy("k", "id").collect()]
    for parts in (1, 50):
        got = numbered(rows.repartition(parts), ["k", "id"], "at", 1).orderBy("at").collect()
        assert [(r.k, r.id) for r in got] == want
        assert [r["at"] for r in got] == list(range(1, 3001))


def test_descending_order_nulls_a_hot_key_and_an_empty_table(spark):
    rows = spark.createDataFrame([(k, 5) for k in range(500)] + [(None, 5), (900, 9), (901, None)], "id long, score long")
    got = numbered(rows, [F.desc("score"), F.asc_nulls_last("id")]).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(503))
    assert [r.id for r in got] == [900, *range(500), None, 901]
    assert numbered(rows.filter("false"), ["id"]).count() == 0
