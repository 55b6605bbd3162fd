"""``skew_join``: equal to a plain join, even tasks with a third of the rows on one key."""

import pytest
from pyspark.sql import functions as F

from tablework.operators import relational as RL
from tablework.plans.queries import _skewed_lineitem, table

SF = "/root/testdata/sf0.01"


@pytest.fixture()
def plain_shuffle(spark):
    """No adaptive splitting and no broadcast: what the operator does alone."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.shuffle.partitions": "16"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def bag(df):
    return sorted(map(str, df.collect()))


LEFT = [(1, "a", k % 3) for k in range(600)] + [(k, "b", 0) for k in range(2, 100)] + [(None, "c", k) for k in range(200)]
RIGHT = [(1, "p"), (1, "q"), (2, "r"), (200, "s"), (None, "t")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti", "right"])
def test_equals_a_plain_join(spark, plain_shuffle, how):
    left = spark.createDataFrame(LEFT, "k long, a string, N int").repartition(5)
    right = spark.createDataFrame(RIGHT, "k long, z string")
    got, want = RL.skew_join(left, right, "k", how), left.join(right, "k", how)
    assert got.columns == want.columns and bag(got) == bag(want)


def test_several_keys_and_repeats(spark, plain_shuffle):
    left = spark.createDataFrame([("x", 1)] * 500 + [("y", None)] * 300 + [("z", 2)], "k string, j int")
    right = spark.createDataFrame([("x", 1, 0.5), ("z", 2, None), ("y", None, 1.0)], "k string, j int, v double")
    for how in ("inner", "left", "left_anti"):
        assert bag(RL.skew_join(left, right, ["k", "j"], how)) == bag(left.join(right, ["k", "j"], how))


def test_empty_sides(spark, plain_shuffle):
    left = spark.createDataFrame(LEFT, "k long, a string, n int")
    right = spark.createDataFrame(RIGHT, "k long, z string")
    assert RL.skew_join(left.limit(0), right, "k").count() == 0
    assert RL.skew_join(left, right.limit(0), "k", "left").count() == len(LEFT)
    with pytest.raises(ValueError):
        RL.skew_join(left, right, "k", "full")


def test_heavy_keys_are_the_ones_above_an_even_share(spark):
    found = RL.heavy_keys(_skewed_lineitem(spark, SF), "p_partkey", 16).collect()
    hot = spark.sql("SELECT xxhash64(1L) h").first()["h"]
    assert {r.key_hash for r in found} == {hot}
    assert [r.parts for r in found] == [6]                 # a third of 16 shares


def test_no_task_holds_more_than_four_medians(spark, plain_shuffle):
    left = _skewed_lineitem(spark, SF)
    right = table(spark, SF, "part").select("p_partkey", "p_name")

    def task_rows(df):
        return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())

    plain, even = task_rows(left.join(right, "p_partkey")), task_rows(RL.skew_join(left, right, "p_partkey"))
    assert plain[-1] > 6 * plain[len(plain) // 2]
    assert sum(even) == sum(plain) and even[-1] <= 4 * even[len(even) // 2]


def test_one_shuffle_of_either_side(spark, plain_shuffle):
    left, right = _skewed_lineitem(spark, SF), table(spark, SF, "part").select("p_partkey", "p_name")
    plan = RL.skew_join(left, right, "p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(p_partkey") == 2 and "ENSURE_REQUIREMENTS" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
