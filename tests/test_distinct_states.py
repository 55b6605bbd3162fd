"""Exact distinct states: counts, merging, types, plan."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablework.operators import distinct_states as DS

SF = "/root/testdata/sf0.01"
LONG = st.integers(-2**63, 2**63 - 1)


def counts(states, **kw):
    return {(r.part, r["column"]): r.n_distinct for r in DS.distinct_counts(states, **kw).collect()}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), LONG, st.integers(-70, 70)),
                          st.one_of(st.none(), st.integers(-130, 5))), max_size=120))
def test_counts_and_merged_counts(spark, rows):
    df = spark.createDataFrame(rows, "p string, x long, word int")
    states = DS.distinct_states(df, ["x", "word"], "p")
    of = lambda i, p: {r[i] for r in rows if r[0] in p and r[i] is not None}
    want = {(p, c): len(of(i, p)) for p in "ab" for i, c in ((1, "x"), (2, "word")) if of(i, p)}
    assert counts(states) == want
    assert counts(DS.merge_distinct(states)) == {("all", c): len(of(i, "ab")) for i, c in ((1, "x"), (2, "word")) if of(i, "ab")}


def test_every_supported_type(spark):
    day, at = dt.date(1969, 12, 31), dt.datetime(2020, 1, 1, 0, 0, 0, 1)
    rows = [(True, day, at, at, Decimal("-1.25"), 1), (False, day, at + dt.timedelta(microseconds=1), at, Decimal("1.25"), -1),
            (None, dt.date(9999, 12, 31), dt.datetime(1900, 1, 1), dt.datetime(1, 1, 1), Decimal("9999999999999999.99"), 1),
            (True, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "b boolean, d date, t timestamp, n timestamp_ntz, m decimal(18,2), s byte")
    got = counts(DS.distinct_states(df, df.columns))
    assert got == {("all", "b"): 2, ("all", "d"): 2, ("all", "t"): 3, ("all", "n"): 2, ("all", "m"): 3, ("all", "s"): 2}
    small = spark.sql("SELECT explode(array(CAST('0.999999999999999999' AS DECIMAL(18,18)), CAST('0.999999999999999998' AS "
                      "DECIMAL(18,18)), CAST('-0.999999999999999999' AS DECIMAL(18,18)))) AS m")
    whole = spark.sql("SELECT explode(array(CAST('999999999999999999' AS DECIMAL(18,0)), CAST('999999999999999998' AS "
                      "DECIMAL(18,0)))) AS m")
    assert (counts(DS.distinct_states(small, ["m"])), counts(DS.distinct_states(whole, ["m"]))) == (
        {("all", "m"): 3}, {("all", "m"): 2})
    for kind in ("string", "double", "decimal(30,2)"):
        with pytest.raises(TypeError):
            DS.distinct_states(df.select(F.lit(None).cast(kind).alias("x")), ["x"])


def test_clock_changes_do_not_join_local_times(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.sql("SELECT explode(array(TIMESTAMP_NTZ '2024-03-31 01:30:00', TIMESTAMP_NTZ '2024-03-31 02:30:00', "
                       "TIMESTAMP_NTZ '2024-03-31 03:30:00')) AS n")
        assert counts(DS.distinct_states(df, ["n"])) == {("all", "n"): 3}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_empty_tables_and_parts_without_values(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "p string, x int")
    states = DS.distinct_states(df, ["x"], "p")
    assert counts(states) == {("a", "x"): 1}
    asked = df.select(F.col("p").alias("part"), F.lit("x").alias("column"))
    assert counts(states, parts=asked) == {("a", "x"): 1, ("b", "x"): 0}
    assert counts(DS.distinct_states(df.limit(0), ["x"], "p")) == {}


def test_dense_keys_make_few_words_in_one_hash_aggregate(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    states = DS.distinct_states(items, ["l_orderkey", "l_partkey", "l_suppkey"])
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    assert "Expand" not in plan and "SortAggregate" not in plan and "ObjectHash" not in plan
    keys = items.select("l_orderkey").distinct().count()
    assert states.where("column = 'l_partkey'").count() < items.select("l_partkey").distinct().count() / 40
    assert counts(states)["all", "l_orderkey"] == keys
