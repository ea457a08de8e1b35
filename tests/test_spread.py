import pytest
from pyspark.sql import functions as F

from lanternqa.operators import datasets as ds
from lanternqa.operators.spread import grid_join, spread_join, with_position


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [1, 50, 10**6])
def test_spread_join_equals_join(spark, how, hot_rows):
    left = spark.range(3000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k")
    )
    right = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    right = right.unionByName(right.filter("k = 7"))
    want = sorted(map(str, left.join(right, "k", how).select("row", "k", "v").collect()))
    got = spread_join(left, right, ["k"], how, ["row"], hot_rows).select("row", "k", "v").collect()
    assert sorted(map(str, got)) == want


@pytest.mark.parametrize("hot_rows", [7, 100, 10**6])
def test_grid_join_equals_join(spark, hot_rows):
    left = spark.range(600).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    right = spark.range(500).select(F.col("id").alias("b"), F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"))
    left = left.unionByName(spark.range(5).select(F.col("id").alias("a"), F.lit(None).cast("bigint").alias("k")))
    want = sorted(map(tuple, left.join(right, "k").select("a", "b", "k").collect()))
    got = grid_join(left, right, ["k"], ["a"], ["b"], hot_rows).select("a", "b", "k").collect()
    assert sorted(map(tuple, got)) == want


def test_hot_key_is_split(spark):
    left = spark.range(4000).select(F.col("id").alias("row"), F.lit(1).alias("k"))
    from lanternqa.operators.spread import hot_keys, split_keys

    subs = split_keys(left, hot_keys(left, ["k"], 500), ["k"], ["row"]).groupBy("_sub").count().collect()
    assert len(subs) == 8 and max(r["count"] for r in subs) < 1000


def test_with_position(spark):
    df = spark.range(10000).select((F.col("id") * 7919 % 10007).alias("k")).repartition(7)
    got = with_position(df, ["k"]).orderBy("k").collect()
    assert [r.position for r in got] == list(range(10000))


def test_splits(spark):
    df = spark.range(20000).select(F.col("id").alias("k"))
    first = ds.random_split(df, "k", 65, 3).filter("split = 'train'")
    again = ds.random_split(df.repartition(5), "k", 65, 3).filter("split = 'train'")
    assert 12700 < first.count() < 13300 and first.exceptAll(again).isEmpty()
    tail = ds.tail_split(df, "k", 19990).orderBy("index").collect()
    assert [(r["index"], r.k) for r in tail] == [(i, 19990 + i) for i in range(10)]
    assert ds.tail_split(df, "k", 30000).isEmpty()


def test_length_buckets_with_a_hot_bucket(spark):
    df = spark.range(1000).select(
        F.col("id").alias("k"), F.repeat(F.lit("w "), F.when(F.col("id") % 3 > 0, 10).otherwise(F.col("id")).cast("int")).alias("t")
    )
    got = ds.length_buckets(df, "t", "k", batch=4, max_len=300, width=64).collect()
    assert len(got) == 1000 and max(r.n_tokens for r in got) == 300
    sizes = {}
    for r in got:
        assert r.bucket == r.n_tokens // 64
        sizes.setdefault(r.bucket, {}).setdefault(r.batch_no, []).append(r.k)
    for batches in sizes.values():
        counts = [len(batches[b]) for b in sorted(batches)]
        assert sorted(batches) == list(range(len(batches))) and all(c == 4 for c in counts[:-1]) and counts[-1] <= 4


def test_wide_values_make_a_key_hot_sooner():
    from lanternqa.operators.spread import HOT_BYTES, HOT_ROWS, LEAST_HOT_ROWS, rows_of_bytes

    assert rows_of_bytes(None) == rows_of_bytes(10) == HOT_ROWS
    assert rows_of_bytes(1 << 16) == HOT_BYTES >> 16
    assert rows_of_bytes(1 << 30) == LEAST_HOT_ROWS
