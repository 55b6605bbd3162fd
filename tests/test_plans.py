"""Plan shape of every registered query: the properties that decide how
it behaves at scale, checked on the physical plan."""

import contextlib
import io

import pytest

from core import core_queries

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {k: plan_text(fn(spark, SF)) for k, fn in core_queries().items()}


def test_no_cross_products_anywhere(plans):
    bad = [k for k, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_no_row_at_a_time_python(plans):
    assert [k for k, p in plans.items() if "BatchEvalPython" in p] == []


def test_python_only_in_parsers(plans):
    py = sorted(k for k, p in plans.items() if "MapInPandas" in p or "ArrowEvalPython" in p)
    parsers = ["html_select", "html_tables", "scan_archives", "scan_workbooks"]
    of_aggregates = ["fit_groups", "induce_date_formats", "parse_induced_dates"]   # a row per group or template
    assert py == sorted(parsers + of_aggregates)


def test_filters_and_columns_reach_the_scan(plans):
    p = plans["scan_parquet"]
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,25.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_extendedprice:double>" in p
    assert "PartitionFilters: [isnotnull(year" in plans["scan_partitioned"]
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,400000.0)]" in plans["filtered_view"]


def test_top_k_without_global_sort(plans):
    for k in ("top_group", "top_group_in_range", "first_by", "sample_rows"):
        assert "TakeOrderedAndProject" in plans[k], k


def test_aggregates_are_partial_before_shuffle(plans):
    # the plan tree prints top-down: a partial aggregate (hash, or sort for
    # max_by over a struct with strings) must sit below the first exchange
    for k in ("group_count", "top_group", "run_rollup", "count_distinct", "drop_duplicates"):
        tree = plans[k].split("\n\n")[0].splitlines()
        ex = max(i for i, ln in enumerate(tree) if "Exchange" in ln)
        assert any("Aggregate" in ln for ln in tree[ex + 1:]), k
