"""Top keys by bucket bounds: equal to the full group-by, small keys left out of the shuffle."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablework.operators import charts as CH
from tablework.operators import stats as S

SF = "/root/testdata/sf0.01"


def bag(df):
    return sorted(map(str, df.collect()))


def test_equals_the_full_group_by_at_any_number_of_buckets(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    for key in ("l_partkey", "l_suppkey", "l_returnflag", "l_discount"):
        for k, buckets in ((1, 1), (3, 7), (25, 1 << 12)):
            assert S.top_groups_bounded(items, key, k, buckets).collect() == S.top_groups(items, key, k).collect()


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 9), st.integers(0, 300)), max_size=400),
       st.integers(1, 6), st.integers(1, 40))
def test_ties_missing_keys_and_few_keys(spark, keys, k, buckets):
    df = spark.createDataFrame([(x,) for x in keys], "k int")
    assert S.top_groups_bounded(df, "k", k, buckets).collect() == S.top_groups(df, "k", k).collect()


def test_signed_zeros_nan_and_clashing_names(spark):
    values = [0.0, -0.0, float("nan"), None, 1.5, 1.5, 1.5, -0.0]
    df = spark.createDataFrame([(v, 1) for v in values], "n double, bucket int")
    for buckets in (1, 2, 3, 1000):
        assert [tuple(r) for r in S.leading_counts(df, "n", 2, buckets).orderBy("key").collect()] == [(0.0, 3), (1.5, 3)]
    assert [r["n"] for r in S.top_groups_bounded(df, "bucket", 1).collect()] == [len(values)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string")
    assert S.top_groups_bounded(df, "k", 3).collect() == []
    assert CH.bar_series_bounded(df, "k", 3).collect() == []


@pytest.mark.parametrize("order", ["key", "count"])
def test_bars_equal_the_plain_series(spark, order):
    rng = random.Random(3)
    words = [rng.choice(["other", "a", "b"]) if rng.random() < 0.5 else f"w{rng.randrange(200)}" for _ in range(900)]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "k string")
    for bars in (1, 2, 5, 1000):
        assert bag(CH.bar_series_bounded(df, "k", bars, order, buckets=64)) == bag(CH.bar_series(df, "k", order, bars))


def test_small_keys_are_not_counted_one_by_one(spark):
    # a third of the rows on one key, 20 middling keys, 40,000 keys of one row
    df = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, -2 - F.col("id") % 20)
                                     .otherwise(F.col("id")).alias("k"))
    counted = S.leading_counts(df, "k", 10).count()
    assert counted < 200 and df.distinct().count() > 40_000
    assert S.top_groups_bounded(df, "k", 10).collect() == S.top_groups(df, "k", 10).collect()


def test_plan_counts_buckets_once(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    df = S.top_groups_bounded(items, "l_partkey", 10)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange [bucket" in plan and "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "ReadSchema: struct<l_partkey:bigint>" in plan
