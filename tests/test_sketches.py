"""Mergeable profile states: merged parts against one pass and against exact figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablework.operators import sketches as SK

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


@pytest.fixture(scope="module")
def by_year(spark, items, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("states") / "lineitem")
    SK.profile_states(items, F.year("l_shipdate")).write.parquet(path)
    return spark.read.parquet(path)


def rows(states, **kw):
    return {r["column"]: r for r in SK.profile_of(states, **kw).collect()}


def test_merged_parts_equal_one_pass(items, by_year):
    assert by_year.count() == items.select(F.year("l_shipdate")).distinct().count() > 5
    merged, once = rows(SK.merge_states(by_year)), rows(SK.merge_states(SK.profile_states(items)))
    for c, m in merged.items():
        for f in ("dtype", "n_rows", "n_null", "n_distinct", "min_value", "max_value"):
            assert m[f] == once[c][f], (c, f)


def test_estimates_are_within_their_bounds(items, by_year):
    merged = rows(SK.merge_states(by_year), top_k=3)
    n = items.count()
    for c in items.columns:
        d = items.select(c).distinct().count()
        assert abs(merged[c]["n_distinct"] - d) <= max(1, 0.08 * d), c
    for c in ("l_quantity", "l_extendedprice", "l_partkey"):
        values = np.sort(np.array([r[0] for r in items.select(F.col(c).cast("double")).collect()]))
        for q, v in zip((0.25, 0.5, 0.75), merged[c]["quantiles"]):
            lo, hi = np.searchsorted(values, v, "left") / n, np.searchsorted(values, v, "right") / n
            assert lo - 0.03 <= q <= hi + 0.03, c
    for c in ("l_returnflag", "l_linestatus", "l_linenumber"):
        want = [str(r[0]) for r in items.groupBy(c).count().orderBy(F.desc("count")).limit(3).collect()]
        assert sorted(merged[c]["frequent"]) == sorted(want)


def test_merging_is_associative(by_year):
    first = SK.merge_states(by_year, F.col("part").cast("int") % 2)
    assert first.count() == 2
    one, two = rows(SK.merge_states(first)), rows(SK.merge_states(by_year))
    for c in one:
        assert all(one[c][f] == two[c][f] for f in ("n_rows", "n_null", "n_distinct", "min_value", "max_value"))


def test_missing_values_empty_parts_and_nested_columns(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None, [1]), ("a", float("nan"), None, None), ("b", None, None, [2])],
        "p string, x double, s string, arr array<int>")
    got = {(r["part"], r["column"]): r for r in SK.profile_of(SK.profile_states(df, "p")).collect()}
    assert (got["a", "x"]["n_rows"], got["a", "x"]["n_null"], got["a", "x"]["min_value"]) == (2, 1, "1.0")
    b = got["b", "x"]
    assert (b["n_null"], b["n_distinct"], b["min_value"], b["quantiles"], b["frequent"]) == (1, 0, None, None, None)
    assert got["a", "s"]["n_null"] == 2 and got["a", "arr"]["n_null"] == 1 and got["a", "arr"]["n_distinct"] is None
    merged = rows(SK.merge_states(SK.profile_states(df, "p")))
    assert (merged["x"]["n_null"], merged["x"]["quantiles"]) == (2, [1.0, 1.0, 1.0])
    assert SK.profile_of(SK.profile_states(df.limit(0), "p")).count() == 0


def test_one_scan_and_one_shuffle(items):
    plan = SK.profile_states(items, F.year("l_shipdate"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
