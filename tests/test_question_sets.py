"""The question sets of the build plan on small fixtures of their shape:
partitioned court decisions, the four-row sales file, the films table."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from tablework.operators import charts as CH
from tablework.operators import cleaning as C
from tablework.operators import stats as S
from tablework.sources import files as FS


@pytest.fixture(scope="module")
def decisions(spark, tmp_path_factory):
    """year=/court=/bench= Parquet tree; registration date as dd-MM-yyyy text."""
    root = str(tmp_path_factory.mktemp("judgments") / "decisions")
    rows = []
    for i in range(400):
        year = 2018 + i % 6
        court = ["33_10", "27_1", "9_13"][(i // 6) % 3]
        decision = dt.date(year, 1 + i % 12, 1 + i % 27)
        delay = 30 + (year - 2018) * 10 + (i % 5) if court == "33_10" else 50 + i % 7
        reg = decision - dt.timedelta(days=delay)
        rows.append((f"cnr{i}", reg.strftime("%d-%m-%Y"), decision, year, court, f"b{i % 2}",
                     "Dismissed" if i % 4 else "Allowed"))
    df = spark.createDataFrame(rows, "cnr string, date_of_registration string, decision_date date, "
                                     "year long, court string, bench string, disposal_nature string")
    FS.save_table(df, root, "parquet", partition_by=["year", "court", "bench"])
    return root


def test_top_court_in_year_range_uses_partition_pruning(spark, decisions):
    df = FS.load_table(spark, decisions, "parquet", where="year BETWEEN 2019 AND 2022")
    assert "PartitionFilters: [isnotnull(year" in df._jdf.queryExecution().executedPlan().toString()
    top = S.top_groups(df, "court").first()
    counts = {r["court"]: r["n"] for r in S.group_counts(df, "court").collect()}
    assert top["n"] == max(counts.values()) and top["court"] == min(k for k, v in counts.items() if v == top["n"])


def test_delay_slope_in_one_court(spark, decisions):
    df = C.parse_dates(FS.load_table(spark, decisions, "parquet"), {"date_of_registration": "dd-MM-yyyy"})
    summary, by_year = S.delay_trend(df, "date_of_registration", "decision_date", year="year",
                                     where=F.col("court") == "33_10")
    fits = {r["method"]: r for r in summary.collect()}
    # delays grow by 10 days a year in this court (plus a 0-4 day wobble)
    assert math.isclose(fits["of_year_means"]["slope"], 10.0, abs_tol=0.5)
    assert math.isclose(fits["row_level"]["slope"], 10.0, abs_tol=0.5)
    assert sorted(r["year"] for r in by_year.collect()) == [2018, 2019, 2020, 2021, 2022, 2023]


def test_sales_average(spark, tmp_dir):
    path = os.path.join(tmp_dir, "sales.csv")
    with open(path, "w") as fh:
        fh.write("product_id,sales\nA,100\nB,150\nC,80\nD,220\n")
    df = FS.load_table(spark, path, schema="product_id STRING, sales BIGINT")
    assert S.global_mean(df, "sales").first()[0] == 137.5


def test_films_correlation_and_scatter(spark):
    films = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (8, 3)],
                                  "Rank long, Peak long")
    r = S.correlation(films, "Rank", "Peak").first()[0]
    import pandas as pd
    ref = pd.DataFrame({"a": [1, 2, 3, 4, 5, 6, 7, 8], "b": [1, 1, 3, 4, 4, 6, 7, 3]}).corr().iloc[0, 1]
    assert math.isclose(r, ref, rel_tol=1e-12)
    pts = CH.scatter_series(films, "Rank", "Peak").collect()
    reg = S.regression(films, "Rank", "Peak").first()
    assert all(math.isclose(p["fit"], reg["slope"] * p["x"] + reg["intercept"], rel_tol=1e-12) for p in pts)
