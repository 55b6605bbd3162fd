"""Declared report jobs and the driver entry point."""

import json

import pytest

import __spark_entry__ as E
from core import core_queries, core_sql
from tablework.plans import report
from tablework.plans.queries import flagship_spec
from tablework.plans.report import final_answer, run_report_job

SF = "/root/testdata/sf0.001"


def test_missing_top_level_key(spark):
    spec = flagship_spec(SF)
    del spec["final_output_format"]
    with pytest.raises(ValueError, match="final_output_format"):
        run_report_job(spark, spec)


def test_failed_source_fails_job(spark):
    spec = flagship_spec(SF)
    spec["sourcing_plan"][0]["validate"]["required"].append("no_such_column")
    with pytest.raises(ValueError, match="lacks required columns"):
        run_report_job(spark, spec)


def test_failed_task_is_an_error_entry(spark):
    spec = flagship_spec(SF)
    answers = {r["qid"]: r for r in run_report_job(spark, spec).collect()}
    assert answers["broken"]["answer"] is None and "no_such_column" in answers["broken"]["error"]
    assert answers["rows"]["error"] is None and int(answers["rows"]["answer"]) > 0
    top = json.loads(answers["top_customer"]["answer"])          # two columns → {key: value}
    assert len(top) == 1 and list(top.values())[0] >= 1
    desc = json.loads(answers["orders_per_customer"]["answer"])
    assert set(desc) == {"count", "mean", "std", "min", "p25", "p50", "p75", "max"}


def test_final_answer_array(spark):
    spec = flagship_spec(SF)
    final = final_answer(spec, run_report_job(spark, spec)).first()["result"]
    items = json.loads(final)
    assert len(items) == 10 and items[7].startswith("ERROR: ")


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["task_id", "qid", "output_format", "position", "answer", "error"]
    assert df.count() == 10


def test_registered_keys_have_sql():
    qs, sql = core_queries(), core_sql()
    assert set(sql) <= set(qs)
    assert set(qs) == set(sql)


def test_chart_and_trend_ops(spark):
    spec = flagship_spec(SF)
    spec["analysis_plan"] = [
        {"task_id": 1, "qid": "bars", "source": "orders", "op": "bar_series",
         "params": {"key": "o_orderpriority", "order": "count", "max_bars": 2}, "output_format": "records"},
        {"task_id": 2, "qid": "scatter", "source": "orders", "op": "scatter_series",
         "params": {"x": "o_orderkey", "y": "o_totalprice", "max_points": 16}, "output_format": "records",
         "round": 3},
        {"task_id": 3, "qid": "trend", "source": "orders", "op": "delay_trend",
         "params": {"start": "o_orderdate", "end": "o_orderdate"}, "output_format": "records"},
    ]
    got = {r["qid"]: json.loads(r["answer"]) for r in run_report_job(spark, spec).collect()}
    assert [b["category"] for b in got["bars"]][-1] == "other" and sum(b["n"] for b in got["bars"]) == 1500
    assert len(got["scatter"]) <= 16 and sum(p["n"] for p in got["scatter"]) == 1500
    assert {t["method"] for t in got["trend"]} == {"row_level", "of_year_means"}
    assert all(t["slope"] == 0.0 for t in got["trend"])


def test_sql_tasks_over_two_sources(spark):
    spec = flagship_spec(SF)
    spec["sourcing_plan"].append({"name": "parts", "path": f"{SF}/part.parquet", "kind": "parquet"})
    spec["analysis_plan"] = [
        {"task_id": 1, "qid": "big_orders", "source": "orders", "op": "sql",
         "params": {"query": "SELECT count(*) AS n FROM source WHERE o_totalprice > :lo", "args": {"lo": 100000}},
         "output_format": "number"},
        {"task_id": 2, "qid": "parts", "source": "parts", "op": "sql",
         "params": {"query": "SELECT count(*) AS n FROM source"}, "output_format": "number"},
    ]
    got = {r["qid"]: r["answer"] for r in run_report_job(spark, spec).collect()}
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert int(got["big_orders"]) == orders.where("o_totalprice > 100000").count()
    assert int(got["parts"]) == spark.read.parquet(f"{SF}/part.parquet").count()


def test_sample_rows_op(spark):
    spec = flagship_spec(SF)
    spec["analysis_plan"] = [{"task_id": 1, "qid": "first3", "source": "orders", "op": "sample_rows",
                              "params": {"n": 3, "order_by": ["o_orderkey"]}, "output_format": "records"}]
    rows = json.loads(run_report_job(spark, spec).first()["answer"])
    keys = [r["o_orderkey"] for r in spark.read.parquet(f"{SF}/orders.parquet").orderBy("o_orderkey").limit(3).collect()]
    assert [r["o_orderkey"] for r in rows] == keys


def test_join_task_across_sources(spark):
    spec = flagship_spec(SF)
    spec["sourcing_plan"].append({"name": "customers", "path": f"{SF}/customer.parquet", "kind": "parquet",
                                  "columns": ["c_custkey", "c_mktsegment"]})
    spec["analysis_plan"] = [
        {"task_id": 1, "qid": "orders_by_segment", "source": "orders", "op": "group_count",
         "params": {"key": "c_mktsegment"}, "output_format": "json_object",
         "join": {"with": "customers", "on": {"o_custkey": "c_custkey"}}},
    ]
    got = json.loads(run_report_job(spark, spec).first()["answer"])
    o = spark.read.parquet(f"{SF}/orders.parquet")
    c = spark.read.parquet(f"{SF}/customer.parquet")
    want = {r["c_mktsegment"]: r["count"]
            for r in o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").count().collect()}
    assert got == want


def test_failing_task_and_long_list_leave_the_others(spark):
    spec = flagship_spec(SF)
    spec["analysis_plan"] = [
        {"task_id": 1, "qid": "n", "source": "orders", "op": "row_count", "output_format": "number"},
        {"task_id": 2, "qid": "bad", "source": "orders", "op": "sql",
         "params": {"query": "SELECT raise_error('late') AS x FROM source"}, "output_format": "number"},
        {"task_id": 3, "qid": "per_order", "source": "orders", "op": "group_count",
         "params": {"key": "o_orderkey"}, "output_format": "json"},
    ]
    got = run_report_job(spark, spec).collect()
    by = {r["qid"]: r for r in got if r["position"] is None}
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert int(by["n"]["answer"]) == n and "late" in by["bad"]["error"] and by["bad"]["answer"] is None
    rows = [r for r in got if r["qid"] == "per_order"]
    keys = [json.loads(r["answer"])["o_orderkey"] for r in sorted(rows, key=lambda r: r["position"])]
    assert len(rows) == n and keys == sorted(keys)


def test_sql_task_is_one_select_over_a_private_view(spark):
    spark.range(3).createOrReplaceTempView("source")
    spec = flagship_spec(SF)
    spec["analysis_plan"] = [
        {"task_id": 1, "qid": "a", "source": "orders", "op": "sql", "output_format": "number",
         "params": {"query": "WITH t AS (SELECT 1 AS one FROM source) SELECT sum(one) AS n FROM t"}},
        {"task_id": 2, "qid": "b", "source": "orders", "op": "sql", "output_format": "number",
         "params": {"query": "DROP VIEW source"}},
    ]
    got = {r["qid"]: r for r in run_report_job(spark, spec).collect()}
    assert int(got["a"]["answer"]) == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert "single SELECT" in got["b"]["error"] and spark.table("source").count() == 3


def test_validation_rules_act_and_sources_are_read_afresh(spark, tmp_dir):
    path = f"{tmp_dir}/src"
    spark.createDataFrame([(1, "a"), (1, None)], "k int, v string").write.parquet(path)
    spec = {"sourcing_plan": [{"name": "s", "path": path, "kind": "parquet", "clean": {"dedupe": True}}],
            "analysis_plan": [{"task_id": 1, "qid": "n", "source": "s", "op": "row_count", "output_format": "number"},
                              {"task_id": 2, "qid": "m", "source": "s", "op": "count_distinct",
                               "params": {"column": "k"}, "output_format": "number"}],
            "final_output_format": {"format": "json_array"}}
    assert int(run_report_job(spark, spec).where("qid = 'n'").first()["answer"]) == 2
    spark.createDataFrame([(2, "c")], "k int, v string").write.mode("append").parquet(path)
    assert int(run_report_job(spark, spec).where("qid = 'n'").first()["answer"]) == 3
    for rules, text in (({"not_null": ["v"]}, "not_null v: 1"), ({"unique": ["k"]}, "unique k: 1"),
                        ({"types": {"v": "int64"}}, "type v: 2"), ({"not_null": ["z"]}, "lacks validated")):
        spec["sourcing_plan"][0]["validate"] = rules
        with pytest.raises(ValueError, match=text):
            run_report_job(spark, spec)


GROUPED = [
    ("group_count", {"key": "k"}, "records"), ("group_count", {"key": "v"}, "records"),
    ("group_mean", {"key": "k", "column": "x"}, "records"), ("group_mean", {"key": "k", "column": "k"}, "records"),
    ("group_mean", {"key": "v", "column": "x"}, "records"), ("top_group", {"key": "k", "k": 2}, "records"),
    ("top_group", {"key": "x"}, "records"), ("having_count", {"key": "k", "n": 1}, "json_array"),
    ("size_histogram", {"key": "v"}, "records"), ("size_describe", {"key": "k"}, "records"),
    ("pattern_discovery", {"column": "v"}, "records"), ("bar_series", {"key": "k", "max_bars": 1}, "records"),
    ("bar_series", {"key": "v", "order": "count"}, "records")]


def _grouped_spec(path):
    return {"sourcing_plan": [{"name": "s", "path": path, "kind": "parquet", "nan_as_null": False}],
            "analysis_plan": [{"task_id": i, "source": "s", "op": op, "params": p, "output_format": f}
                              for i, (op, p, f) in enumerate(GROUPED)],
            "final_output_format": {"format": "json_array"}}


@pytest.mark.parametrize("rows", [
    [(1, "a1", 0.5), (1, "b2", None), (2, "a1", float("nan")), (None, None, 1.0), (3, "", 2.0), (3, "a1", 2.0)], []])
def test_grouped_tasks_share_one_pass_and_answer_as_alone(spark, tmp_dir, monkeypatch, rows):
    path = f"{tmp_dir}/src"
    spark.createDataFrame(rows, "k long, v string, x double").write.parquet(path)
    made = []
    states = report.stats.group_states
    monkeypatch.setattr(report.stats, "group_states", lambda *a: made.append(states(*a)) or made[-1])
    shared = {r.task_id: (r.answer, r.error) for r in run_report_job(spark, _grouped_spec(path)).collect()}
    assert len(made) == 1
    spec, alone = _grouped_spec(path), {}
    for task in spec["analysis_plan"]:
        one = run_report_job(spark, {**spec, "analysis_plan": [task]}).collect()
        alone[task["task_id"]] = (one[0].answer, one[0].error)
    assert len(made) == 1 and shared == alone and all(e is None for _, e in shared.values())


def test_group_states_plan_one_scan_and_no_raw_row_shuffle(spark):
    src = spark.read.parquet(f"{SF}/orders.parquet")
    plan = report.stats.group_states(src, {"o_custkey": [], "o_orderstatus": [], "o_orderpriority": ["o_totalprice"]})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert text.index("Exchange") < text.index("partial_count") < text.index("Expand")


def test_scratch_of_a_report_is_removed(spark, monkeypatch):
    made, gone = [], []
    path, remove = report.scratch_path, report.remove_scratch
    monkeypatch.setattr(report, "scratch_path", lambda s, n: made.append(path(s, n)) or made[-1])
    monkeypatch.setattr(report, "remove_scratch", lambda s, p: gone.append(p) or remove(s, p))
    spec = flagship_spec(SF)
    spec["analysis_plan"].append({"task_id": 11, "qid": "late", "source": "orders", "op": "sql",
                                  "params": {"query": "SELECT raise_error('late') AS x FROM source"}})
    answers = run_report_job(spark, spec)
    assert [p for p in made if "group_states" in p] == gone[:1] and len(gone) == 2
    assert answers.count() == 11 and answers.where("error IS NOT NULL").count() == 2
    with pytest.raises(ValueError):
        remove(spark, "/tmp/elsewhere/x")


def _distinct_spec(sf, columns, **more):
    tasks = [{"task_id": i, "qid": c, "op": "count_distinct", "source": "li", "output_format": "number",
              "params": {"column": c, **more}} for i, c in enumerate(columns, 1)]
    tasks.append({"task_id": 99, "qid": "rows", "op": "row_count", "source": "li", "output_format": "number"})
    tasks.append({"task_id": 100, "qid": "discount", "op": "global_mean", "source": "li", "output_format": "number",
                  "params": {"column": "l_discount"}, "round": 6})
    return {"sourcing_plan": [{"name": "li", "path": f"{sf}/lineitem.parquet", "kind": "parquet"}],
            "analysis_plan": tasks, "final_output_format": {"format": "json_array"}}


def test_several_exact_distincts_share_a_pass_without_expand(spark):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_partkey"]
    spec = _distinct_spec(SF, columns)
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    branches, done = report._fused_answers({"li": items}, spec["analysis_plan"])
    plans = [b._jdf.queryExecution().executedPlan().toString() for b in branches]
    assert len(plans) == 2 and done == set(range(7)) and not any("Expand" in p for p in plans)
    got = {r["task_id"]: r["answer"] for r in run_report_job(spark, spec).collect()}
    want = {i: str(items.select(c).distinct().count()) for i, c in enumerate(columns, 1)}
    assert {k: v for k, v in got.items() if k < 99} == want and got[99] == str(items.count())


def test_distincts_of_other_types_and_of_empty_sources(spark, tmp_dir):
    path = f"{tmp_dir}/lineitem.parquet"
    spark.createDataFrame([], "l_orderkey long, l_shipdate date, l_comment string, l_discount double").write.parquet(path)
    for columns in (["l_orderkey", "l_shipdate", "l_comment"], ["l_comment", "l_orderkey"]):
        got = {r["qid"]: (r["answer"], r["error"]) for r in run_report_job(spark, _distinct_spec(tmp_dir, columns)).collect()}
        assert all(got[c] == ("0", None) for c in columns) and got["rows"] == ("0", None)
    approx = _distinct_spec(SF, ["l_orderkey", "l_partkey"], approx=True)
    assert all(r["error"] is None for r in run_report_job(spark, approx).collect())
