"""Bucketed layouts: joins equal plain joins, without a shuffle; heavy keys apart; pruned partitions."""

import pytest
from pyspark.sql import functions as F

from tablework.operators import layout as LY
from tablework.plans.queries import QUERIES, _skewed_lineitem, table

SF = "/root/testdata/sf0.01"
# k = 1 is heavy on the left, k = 7 on the right, the rest even; missing keys on both sides
LEFT = [(1, f"a{i}") for i in range(500)] + [(k, "b") for k in range(2, 120)] + [(None, f"c{i}") for i in range(90)] + [(5, "b")] * 2
RIGHT = [(7, i) for i in range(400)] + [(k, 0) for k in range(1, 200, 2)] + [(None, 1), (9, 3), (9, 3)]


@pytest.fixture()
def no_broadcast(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def two(spark):
    left = spark.createDataFrame(LEFT, "k int, v string").repartition(4)
    right = spark.createDataFrame(RIGHT, "k int, w int").repartition(3)
    LY.save_bucketed(left, "lay_l", "k", 8)
    LY.save_bucketed(right, "lay_r", "k", 8)
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_a_plain_join(spark, two, no_broadcast, how):
    left, right = two
    got, want = LY.join_bucketed(spark, "lay_l", "lay_r", how), left.join(right, "k", how)
    assert got.columns == want.columns and bag(got) == bag(want)


def test_rows_are_kept_and_heavy_or_missing_keys_lie_apart(spark, two):
    for name, df, hot in (("lay_l", two[0], 1), ("lay_r", two[1], 7)):
        assert bag(LY.load_layout(spark, name)) == bag(df)
        assert {r.k for r in spark.table(f"{name}_apart").select("k").distinct().collect()} == {hot, None}
        assert LY.bucket_keys(spark, name) == (["k"], 8)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_even_keys_join_without_a_shuffle(spark, no_broadcast):
    LY.save_bucketed(table(spark, SF, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), "lay_o", "k", 8)
    LY.save_bucketed(table(spark, SF, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey"), "lay_i", "k", 8)
    assert spark.table("lay_o_apart").count() == spark.table("lay_i_apart").count() == 0
    got = LY.join_bucketed(spark, "lay_i", "lay_o")
    plan = got._jdf.queryExecution().executedPlan().toString()
    even = plan[:plan.rindex("SortMergeJoin")]             # the branch before the one of heavy keys
    assert "SortMergeJoin" in even and "Exchange hashpartitioning" not in even
    assert got.count() == table(spark, SF, "lineitem").count()


def test_a_bucket_is_one_file_and_the_heavy_key_is_in_none(spark):
    LY.save_bucketed(_skewed_lineitem(spark, SF), "lay_s", "p_partkey", 8)
    even, apart = spark.table("lay_s"), spark.table("lay_s_apart")
    assert len(even.inputFiles()) == 8
    assert even.where("p_partkey = 1").count() == 0 and apart.where("p_partkey <> 1").count() == 0
    sizes = [r["count"] for r in even.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / 8


def test_several_keys_empty_tables_and_other_types(spark, no_broadcast):
    a = spark.createDataFrame([("x", 1, 0.5)] * 3 + [("y", None, 1.0), ("z", 2, None)], "s string, j int, v double")
    b = spark.createDataFrame([("x", 1, "p"), ("z", 3, "q"), ("y", None, "r")], "s string, j int, w string")
    LY.save_bucketed(a, "lay_a", ["s", "j"], 4)
    LY.save_bucketed(b, "lay_b", ["s", "j"], 4)
    LY.save_bucketed(b.limit(0), "lay_none", ["s", "j"], 4)
    LY.save_bucketed(b.withColumn("j", F.col("j").cast("long")), "lay_long", ["s", "j"], 4)
    for how in ("inner", "left", "left_anti"):
        assert bag(LY.join_bucketed(spark, "lay_a", "lay_b", how)) == bag(a.join(b, ["s", "j"], how))
    assert LY.join_bucketed(spark, "lay_a", "lay_none", "left").count() == 5
    assert LY.join_bucketed(spark, "lay_none", "lay_a").count() == 0
    with pytest.raises(ValueError):
        LY.join_bucketed(spark, "lay_a", "lay_long")
    with pytest.raises(ValueError):
        LY.bucket_keys(spark, "lay_a_apart")


def test_partitions_are_pruned_from_the_filtered_side(spark):
    plan = QUERIES["join_pruned"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
