"""Aggregations and chart series on tiny frames (empty, NULL, NaN, ties)."""

import math

import pandas as pd
from pyspark.sql import functions as F

from tablework.operators import charts as CH
from tablework.operators import stats as S
from tablework.operators.special import chi2_survival


def test_empty_table_percentage_is_zero(spark):
    df = spark.createDataFrame([], "k string")
    assert S.percentage(df, F.col("k") == "a").first()[0] == 0.0
    assert S.row_count(df).first()[0] == 0


def test_ties_take_smaller_key(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "k string")
    assert tuple(S.top_groups(df, "k").first()) == ("a", 2)


def test_constant_x_regression_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    r = S.regression(df, "x", "y").first()
    assert r["slope"] is None and r["n"] == 2


def test_nan_is_missing_for_corr_and_regression(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, float("nan")), (4.0, 8.0)], "x double, y double")
    r = S.correlation(df, "x", "y").first()[0]
    ref = pd.DataFrame({"x": [1.0, 2, 3, 4], "y": [2.0, 4.1, float("nan"), 8.0]}).corr().loc["x", "y"]
    assert math.isclose(r, ref, rel_tol=1e-12)


def test_describe_matches_pandas(spark):
    keys = list("aaabbcddddeeeeeeeeeffffffffffffff")
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    d = S.describe_group_sizes(df, "k").first().asDict()
    ref = pd.Series(keys).value_counts().describe()
    for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert math.isclose(d[ours], ref[theirs], rel_tol=1e-12)


def test_pattern_discovery(spark):
    df = spark.createDataFrame([("6D",), ("6D",), ("10E",), ("8E",)], "k string")
    got = {(r["kind"], r["pattern"]): (r["n_rows"], r["n_keys"]) for r in S.discover_patterns(df, "k").collect()}
    assert got[("last_char", "E")] == (2, 2) and got[("shape", "9A")] == (3, 2) and got[("first_char", "6")] == (2, 1)


def test_chi_square_against_known_values(spark):
    # 2x2 table [[10, 20], [30, 40]]: statistic 0.7936507936..., dof 1
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40
    df = spark.createDataFrame(rows, "a string, b string")
    r = S.chi_square(df, "a", "b").first()
    assert math.isclose(r["statistic"], 0.7936507936507936, rel_tol=1e-12) and r["dof"] == 1
    assert math.isclose(r["p_value"], 0.3729984, rel_tol=1e-6)
    assert math.isclose(chi2_survival(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(chi2_survival(18.307038053275146, 10), 0.05, rel_tol=1e-9)


def test_delay_trend_two_readings(spark):
    rows = [("2019-01-01", "2019-01-11"), ("2019-06-01", "2019-06-21"), ("2020-01-01", "2020-01-31"),
            ("2021-01-01", "2021-02-10")]
    df = spark.createDataFrame(rows, "s string, e string").select(F.to_date("s").alias("s"), F.to_date("e").alias("e"))
    summary, by_year = S.delay_trend(df, "s", "e")
    got = {r["method"]: (round(r["slope"], 6), round(r["intercept"], 3)) for r in summary.collect()}
    assert got["of_year_means"][0] == 12.5
    assert sorted(tuple(r) for r in by_year.collect()) == [(2019, 2, 15.0), (2020, 1, 30.0), (2021, 1, 40.0)]


def test_fit_linear_one_feature_equals_regression(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i + 1 + (i % 3) * 0.1) for i in range(20)], "x double, y double")
    _, scored, summary = S.fit_linear(df, ["x"], "y")
    terms = dict(tuple(r) for r in summary.collect())
    r = S.regression(df, "x", "y").first()
    assert math.isclose(terms["x"], r["slope"], rel_tol=1e-9)
    assert math.isclose(terms["intercept"], r["intercept"], rel_tol=1e-9)
    assert scored.count() == 20


def test_bar_series_other_bucket(spark):
    df = spark.createDataFrame([(k,) for k in "aaaabbbccd"], "k string")
    got = [tuple(r) for r in CH.bar_series(df, "k", order="count", max_bars=2).collect()]
    assert got == [(0, "a", 4), (1, "b", 3), (2, "other", 3)]
    by_key = [tuple(r) for r in CH.bar_series(df, "k").collect()]
    assert by_key == [("a", 4), ("b", 3), ("c", 2), ("d", 1)]


def test_scatter_series_bounded(spark):
    df = spark.range(10_000).select((F.col("id") % 97).cast("double").alias("x"),
                                    ((F.col("id") * 7) % 101).cast("double").alias("y"))
    s = CH.scatter_series(df, "x", "y", max_points=100)
    out = s.collect()
    assert len(out) <= 100 and sum(r["n"] for r in out) == 10_000
    full = CH.scatter_series(df, "x", "y")
    assert full.count() == 10_000


def test_nan_skipped_in_mean_and_range(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 3.0)], "k string, v double")
    assert S.global_mean(df, "v").first()[0] == 2.0
    assert tuple(S.min_max(df, "v").first()) == (1.0, 3.0)
    assert dict(tuple(r) for r in S.group_mean(df, "k", "v").collect()) == {"a": 1.0, "b": 3.0}


def test_missing_keys_form_no_group(spark):
    rows = [(None, 1.0)] * 3 + [("a", 2.0)] * 2 + [("b", float("nan")), ("other", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert S.top_groups(df, "k").first()["k"] == "a"
    assert {r["k"]: r["n"] for r in S.group_counts(df, "k").collect()} == {"a": 2, "b": 1, "other": 1}
    assert S.group_counts(df, "k", keep_missing=True).count() == 4
    assert S.describe_group_sizes(df, "k").first()["count"] == 3
    assert S.count_distinct(df, "v").first()[0] == 2
    assert {r["category"] for r in CH.bar_series(df, "k").collect()} == {"a", "b", "other"}
    bars = CH.bar_series(df.unionByName(df.where("k = 'other'")), "k", max_bars=2)
    assert [r["category"] for r in bars.collect()] == ["a", "other", "other (rest)"]
    assert S.pattern_counts(df, "k", {"a": ("a", None), "any": (None, None)}, per="key").first()["a"] == 1


def test_delay_trend_leaves_out_missing_dates(spark):
    from tablework.operators.cleaning import parse_dates
    rows = [("2019-01-01", "2019-01-11"), ("2020-01-01", "2020-01-31"), ("2020-06-01", None), (None, "2020-02-01"),
            ("2021-01-01", "2021-03-02"), ("2021-02-01", "bad"), ("2022-01-01", "2022-01-06"), (None, None)]
    df = parse_dates(spark.createDataFrame(rows, "a string, b string"), {"a": "yyyy-MM-dd", "b": "yyyy-MM-dd"})
    summary, by_year = S.delay_trend(df, "a", "b")
    want = df.select(F.regr_slope(F.datediff("b", "a").cast("double"), F.year("a").cast("double")),
                     F.regr_intercept(F.datediff("b", "a").cast("double"), F.year("a").cast("double"))).first()
    got = {r["method"]: r for r in summary.collect()}["row_level"]
    assert math.isclose(got["slope"], want[0], rel_tol=1e-9)
    assert math.isclose(got["intercept"], want[1], rel_tol=1e-6)
    assert sum(r["n"] for r in by_year.collect()) == 4


def test_profile_takes_nan_as_missing(spark):
    from tablework.operators.quality import profile
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "y"), (2.0, None), (None, "x")], "v double, s string")
    for exact in (True, False):
        got = {r["column"]: r for r in profile(df, exact_distinct=exact).collect()}
        assert (got["v"]["n_null"], got["v"]["n_distinct"], got["v"]["max_value"]) == (2, 2, "2.0")
        assert (got["s"]["n_null"], got["s"]["n_distinct"]) == (1, 2)


def test_exact_profile_reads_whole_numbers_in_one_scan(spark):
    from tablework.operators.quality import profile
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    cols = ["l_orderkey", "l_shipdate", "l_returnflag", "l_linenumber"]
    got = profile(items, cols, exact_distinct=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("FileScan") == 3      # the ranges, the words, the text column
    assert {r["column"]: r["n_distinct"] for r in got.collect()} == {c: items.select(c).distinct().count() for c in cols}
    assert {r["n_distinct"] for r in profile(items.limit(0), cols, exact_distinct=True).collect()} == {0}
