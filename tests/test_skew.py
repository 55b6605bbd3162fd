"""A key holding a third of all rows: results stay whole and exact, the
salted join equals the plain one, and grouped work is pre-aggregated."""

import pytest
from pyspark.sql import functions as F

from tablework.operators import charts as CH
from tablework.operators import relational as RL
from tablework.operators import stats as S
from tablework.sources import html as H


@pytest.fixture(scope="module")
def skewed(spark):
    # 30,000 rows; key 0 holds 12,000 (40 %), the rest spread over 1,000 keys
    return spark.range(30_000).select(
        F.when(F.col("id") < 12_000, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("k"),
        (F.col("id") % 97).cast("double").alias("v"))


def test_group_results_whole(skewed):
    top = S.top_groups(skewed, "k").first()
    assert (top["k"], top["n"]) == (0, 12_000)
    assert S.group_counts(skewed, "k").agg(F.sum("n")).first()[0] == 30_000
    assert S.describe_group_sizes(skewed, "k").first()["max"] == 12_000.0


def test_salted_join_equals_plain(skewed, spark):
    dim = spark.range(0, 1001).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    plain = RL.join_tables(skewed, dim, "k")
    salted = RL.join_tables(skewed, dim, "k", salt_buckets=8)
    assert salted.count() == plain.count() == 30_000
    assert sorted(salted.groupBy("k").agg(F.sum("w")).collect()) == sorted(plain.groupBy("k").agg(F.sum("w")).collect())
    semi = RL.join_tables(skewed, dim.where("k < 1"), "k", "left_semi", salt_buckets=8)
    assert semi.count() == 12_000


def test_bar_series_keeps_every_row(skewed):
    bars = CH.bar_series(skewed, "k", order="count", max_bars=5).collect()
    assert bars[0]["category"] == "0" and sum(b["n"] for b in bars) == 30_000


def test_element_id_selector(spark):
    pages = spark.createDataFrame([(1, '<div id="a">x</div><div id="b">y</div>')], "page_id long, html string")
    got = H.extract_html_elements(pages, "div", elem_id="b").collect()
    assert [r["text"] for r in got] == ["y"]


def test_profile_default_approx(spark):
    from tablework.operators import quality as Q
    df = spark.range(5000).select((F.col("id") % 100).alias("a"), F.lit(None).cast("string").alias("b"))
    prof = {r["column"]: r for r in Q.profile(df, top_k=2).collect()}
    assert abs(prof["a"]["n_distinct"] - 100) <= 3 and prof["b"]["n_null"] == 5000
    assert prof["a"]["min_value"] == "0" and prof["a"]["max_value"] == "99" and len(prof["a"]["frequent"]) == 2
