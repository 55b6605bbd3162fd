"""Declared report jobs (#80).

A report spec is plain data (never code that is executed):

.. code-block:: python

    {
      "sourcing_plan": [{"name": "orders", "path": ".../orders.parquet",
                         "kind": "parquet", "schema": {...}, "columns": [...],
                         "where": "...", "clean": {...}, "validate": {...},
                         "persist": "auto" | "cache" | "checkpoint" | "none"}],
      "analysis_plan": [{"task_id": 1, "qid": "q1", "source": "orders",
                         "op": "count_distinct", "params": {"column": "o_custkey"},
                         "output_format": "number", "round": 6,
                         "join": {"with": "customer", "on": {"o_custkey": "c_custkey"}}}],
      "final_output_format": {"format": "json_array"},
    }

Sources are loaded lazily and cleaned; every task becomes a DataFrame over its
cleaned source, shaped into answer rows. Tasks over one source share their work:

* scalar tasks are columns of one aggregate;
* grouped tasks (``GROUPED_OPS``) are answered from one table of group states,
  made by one scan that groups by all their keys at once (``stats.group_states``)
  and removed when the answers are written.

These answers are one union, written at once; any other task is written on its
own. Answers are read from the shared folder. A source that fails to load or to
validate fails the job, as does a missing top-level key. A task that fails, when
it is planned or when it runs, becomes an error entry with the full message and
the others continue: should the shared work fail, its tasks are run one by one.

A task whose result has a row per key of an unbounded column (``LISTED_OPS``)
and whose output format is ``json`` or ``rows`` answers with one row per
element, numbered by ``position``; the formats ``json_array``, ``json_object``
and ``records`` ask for one text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.operators import charts, distinct_states, quality, relational, stats
from tablework.operators.answers import answer_expr, answer_rows, assemble, format_answer, json_scalar
from tablework.operators.cleaning import apply_schema, clean_table
from tablework.session import remove_scratch, scratch_path, shared_dir
from tablework.sources.files import load_table

REQUIRED_KEYS = ("sourcing_plan", "analysis_plan", "final_output_format")
ANSWER_SCHEMA = "task_id INT, qid STRING, output_format STRING, position LONG, answer STRING, error STRING"
ANSWER_COLUMNS = ["task_id", "qid", "output_format", "position", "answer", "error"]

# Ops whose result grows with the number of keys or rows of their source.
LISTED_OPS = {"group_count", "group_mean", "having_count", "size_histogram", "pattern_discovery",
              "sort_by_key", "bar_series", "scatter_series", "sql"}

# Grouped ops by what they need: the parameter that names the key, and the
# result from the key's states (``stats.states_of``).
GROUPED_OPS: dict[str, tuple[str, Callable[..., DataFrame]]] = {
    "group_count": ("key", lambda one, means, key: one.select(F.col(f"`{key}`"), "n")),
    "group_mean": ("key", lambda one, means, key, column: stats.mean_of(one, means, key, column)),
    "top_group": ("key", lambda one, means, key, k=1: stats.top_of(one.select(F.col(f"`{key}`"), "n"), key, k)),
    "having_count": ("key", lambda one, means, key, n=1: stats.having_of(one, key, n)),
    "size_histogram": ("key", lambda one, means, key: stats.histogram_of(one)),
    "size_describe": ("key", lambda one, means, key: stats.describe_of(one)),
    "pattern_discovery": ("column", lambda one, means, column, min_rows=1: stats.patterns_of(
        one.select(F.col(f"`{column}`").alias("key"), "n"), min_rows)),
    "bar_series": ("key", lambda one, means, key, order="key", max_bars=None, other_label=charts.OTHER:
                   charts.bars_of(one.groupBy(F.col(f"`{key}`").cast("string").alias("category"))
                                  .agg(F.sum("n").alias("n")), order, max_bars, other_label)),
}

# Defaults of optional task fields.
TASK_DEFAULTS = {"output_format": "json", "params": {}, "round": None}


def _sql(df: DataFrame, query: str, view: str = "source", args: Mapping[str, Any] | None = None) -> DataFrame:
    """One SELECT over the source, which the query knows as ``view``. The source
    stands behind a private view, so no view of the session is replaced."""
    found = re.match(r"\s*(SELECT|WITH)\b(.*)", query, re.IGNORECASE | re.DOTALL)
    if not found or ";" in query.rstrip().rstrip(";"):
        raise ValueError("an sql task is a single SELECT statement")
    private = f"__tablework_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(private)
    head = f"WITH {view} AS (SELECT * FROM {private})"
    text = query.rstrip().rstrip(";")
    whole = f"{head}, {found[2].rstrip().rstrip(';')}" if found[1].upper() == "WITH" else f"{head} {text}"
    return df.sparkSession.sql(whole, args=dict(args) if args else None)


# Op name → function(df, **params) → DataFrame. Every op is a lazy plan.
OPS: dict[str, Callable[..., DataFrame]] = {
    "row_count": stats.row_count,
    "filtered_count": stats.filtered_count,
    "count_distinct": stats.count_distinct,
    "global_mean": stats.global_mean,
    "min_max": stats.min_max,
    "group_count": stats.group_counts,
    "group_mean": stats.group_mean,
    "top_group": stats.top_groups,
    "having_count": stats.groups_with_count,
    "size_histogram": stats.group_size_histogram,
    "size_describe": stats.describe_group_sizes,
    "pattern_counts": stats.pattern_counts,
    "pattern_discovery": stats.discover_patterns,
    "percentage": stats.percentage,
    "correlation": stats.correlation,
    "regression": stats.regression,
    "independence_test": lambda df, **p: stats.chi_square(df, **p),
    "first_by": relational.first_by,
    "sort_by_key": relational.sort_by_key,
    "bar_series": charts.bar_series,
    "scatter_series": charts.scatter_series,
    "delay_trend": lambda df, **p: stats.delay_trend(df, **p)[0],
    "profile": quality.profile,
    "sample_rows": quality.sample_rows,
    "validate": quality.validate,
    "sql": _sql,
}


def check_spec(spec: Mapping[str, Any]) -> None:
    missing = [k for k in REQUIRED_KEYS if k not in spec]
    if missing:
        raise ValueError(f"report spec is missing required keys: {missing}")
    if not isinstance(spec["analysis_plan"], list) or not isinstance(spec["sourcing_plan"], list):
        raise ValueError("sourcing_plan and analysis_plan must be lists")


def load_sources(spark: SparkSession, sourcing: list[Mapping[str, Any]]) -> dict[str, DataFrame]:
    """Load and clean every source; any failure fails the job.

    ``validate`` rules act: ``required`` columns are checked against the
    schema, ``non_empty`` with a one-row probe, ``types``, ``not_null`` and
    ``unique`` with the aggregates of ``quality.validate``, before cleaning; a
    violation fails the job. ``persist``: ``"none"`` (default) or
    ``"checkpoint"`` (a reliable copy of the cleaned source in the shared
    folder, lineage cut).
    """
    frames: dict[str, DataFrame] = {}
    for src in sourcing:
        s = dict(src)
        name = s.pop("name")
        path = s.pop("path")
        kind = s.pop("kind", None)
        clean = s.pop("clean", None)
        rules = s.pop("validate", None) or {}
        persist = s.pop("persist", "none")
        declared = s.pop("schema", None)
        s.setdefault("nan_as_null", True)         # pandas missing semantics for reports
        df = load_table(spark, path, kind, **s)
        missing = [c for c in rules.get("required", []) if c not in df.columns]
        if missing:
            raise ValueError(f"source {name!r} lacks required columns {missing}; found {df.columns}")
        if rules.get("non_empty") and not df.limit(1).collect():
            raise ValueError(f"source {name!r} is empty")
        acting = {k: rules[k] for k in ("types", "not_null", "unique") if rules.get(k)}
        if acting:
            named = [*acting.get("types", {}), *acting.get("not_null", [])] + [
                c for key in acting.get("unique", []) for c in ([key] if isinstance(key, str) else key)]
            absent = [c for c in named if c not in df.columns]
            if absent:
                raise ValueError(f"source {name!r} lacks validated columns {absent}; found {df.columns}")
            failed = quality.validate(df, acting).where("NOT passed").collect()     # a row per rule
            if failed:
                raise ValueError(f"source {name!r} fails validation: " + "; ".join(
                    f"{r['rule']} {r['column']}: {r['violations']} rows" for r in failed))
        if isinstance(declared, Mapping):
            df = apply_schema(df, declared)
        if clean:
            df, _ = clean_table(df, **clean)
        if persist == "checkpoint":
            shared_dir(spark)
            df = df.checkpoint(eager=True)
        elif persist != "none":
            raise ValueError(f"persist of source {name!r} must be 'none' or 'checkpoint'")
        frames[name] = df
    return frames


def _rounded(df: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return df
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


# parameters that name columns of the task's source
_COLUMN_PARAMS = ("column", "key", "x", "y", "a", "b", "by", "start", "end")


def _check_columns(src: DataFrame, task: Mapping[str, Any]) -> None:
    """Parameters that name columns must name columns of the source."""
    params = task.get("params", {}) or {}
    for p in _COLUMN_PARAMS:
        names = params.get(p)
        for n in ([names] if isinstance(names, str) else names or []):
            if isinstance(n, str) and n not in src.columns:
                raise ValueError(f"column {n!r} of parameter {p!r} not in source {task['source']!r}")


def _joined(frames: Mapping[str, DataFrame], src: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """``{"with": source, "on": keys, "how": "inner", "skew": False}``: the
    task's source joined with another declared source (AQE picks the strategy;
    ``skew``: the source's heavy keys are found and dealt out, see
    ``relational.skew_join``). ``on`` is a list of shared key
    names or a ``{left: right}`` mapping (right keys renamed before the
    equi-join)."""
    other = params["with"]
    if other not in frames:
        raise ValueError(f"unknown source {other!r}")
    right, on = frames[other], params["on"]
    if isinstance(on, Mapping):
        for left_key, right_key in on.items():
            right = right.withColumnRenamed(right_key, left_key)
        on = list(on)
    if params.get("skew"):
        return relational.skew_join(src, right, on, params.get("how", "inner"))
    return relational.join_tables(src, right, on, params.get("how", "inner"),
                                  params.get("salt_buckets", 0))


def task_frame(frames: Mapping[str, DataFrame], task: Mapping[str, Any]) -> DataFrame:
    """A task's result frame. ``join`` (optional) joins the source with
    another source first, so any op can work across two datasets."""
    t = {**TASK_DEFAULTS, **task}
    op = t["op"]
    if op not in OPS:
        raise ValueError(f"unknown op {op!r}")
    if t["source"] not in frames:
        raise ValueError(f"unknown source {t['source']!r}")
    src = frames[t["source"]]
    if t.get("join"):
        src = _joined(frames, src, t["join"])
    _check_columns(src, t)
    return _rounded(OPS[op](src, **dict(t["params"])), t["round"])


def _fusable(task: Mapping[str, Any]) -> bool:
    t = {**TASK_DEFAULTS, **task}
    return (t["op"] in stats.SCALAR_AGGS and not t.get("join")
            and not (t["op"] == "regression" and t["params"].get("by")))


def _fused_answers(frames: Mapping[str, DataFrame], tasks: list[Mapping[str, Any]]
                   ) -> tuple[list[DataFrame], set[int]]:
    """Scalar tasks over the same source → one aggregate pass over that
    source, answered in a single branch: every task's answer is a column
    expression over the one-row aggregate, unpivoted into answer rows.
    (Separate projections of a shared aggregate would not share it: each
    would prune the others' aggregates and scan again.) A task that does
    not plan is left out and keeps its own error on the per-task path."""
    by_source: dict[str, list[tuple[int, Mapping[str, Any]]]] = {}
    for pos, task in enumerate(tasks):
        if _fusable(task) and task.get("source") in frames:
            by_source.setdefault(task["source"], []).append((pos, task))
    branches, done = [], set()
    for source, group in by_source.items():
        src = frames[source]
        named: dict[int, list] = {}
        for pos, t in group:
            try:
                _check_columns(src, t)
                named[pos] = stats.SCALAR_AGGS[t["op"]](src, **dict(t.get("params", {})))
            except Exception:
                continue                  # left to the per-task path, which reports it
        for fused, answered in _one_row_passes(src, named, tasks):
            rows = _fused_rows(fused, answered, tasks)
            done.update(answered)
            branches.append(fused.select(F.explode(F.array(*rows)).alias("a")).select("a.*"))
    return branches, done


def _one_row_passes(src: DataFrame, named: dict[int, list], tasks: list[Mapping[str, Any]]
                    ) -> list[tuple[DataFrame, dict[int, list]]]:
    """The one-row aggregates that answer the tasks ``named``. Several exact
    distinct counts in one aggregate would plan as an Expand of every row; those
    of whole-number-like columns share a pass of their own (``distinct_states``)."""
    exact: dict[int, str] = {}
    for pos in named:
        params = tasks[pos].get("params", {})
        if tasks[pos]["op"] == "count_distinct" and not params.get("approx") and distinct_states.supported(
                src.schema[params["column"]].dataType):
            exact[pos] = params["column"]
    passes = []
    if len(exact) > 1:
        states = distinct_states.distinct_states(src, sorted(set(exact.values())))
        passes.append((states, {pos: [("n_distinct", distinct_states.count_of(c))] for pos, c in exact.items()}))
        named = {pos: pairs for pos, pairs in named.items() if pos not in exact}
    if len(named) > 1:
        passes.append((src, named))
    out = []
    for frame, pairs_of in passes:
        try:
            out.append((frame.agg(*[c.alias(f"__t{pos}__{n}") for pos, pairs in pairs_of.items() for n, c in pairs]),
                        pairs_of))
        except Exception:                 # e.g. a predicate that does not parse: no fusion here
            continue
    return out


def _fused_rows(fused: DataFrame, named: dict[int, list], tasks: list[Mapping[str, Any]]) -> list[Column]:
    """The answer rows of the tasks ``named`` over their one-row aggregate."""
    rows = []
    for pos, pairs in named.items():
        t = {**TASK_DEFAULTS, **tasks[pos]}
        tid = int(t.get("task_id", pos + 1))
        fmt = t["output_format"]
        cols = []
        for n, _ in pairs:
            c = F.col(f"__t{pos}__{n}")
            is_float = isinstance(fused.schema[f"__t{pos}__{n}"].dataType, (T.DoubleType, T.FloatType))
            cols.append((n, F.round(c, t["round"]) if (is_float and t["round"] is not None) else c))
        rows.append(F.struct(F.lit(tid).alias("task_id"),
                             F.lit(str(t.get("qid", t.get("question_id", f"q{tid}")))).alias("qid"),
                             F.lit(fmt).alias("output_format"),
                             F.lit(None).cast("long").alias("position"),
                             answer_expr(cols, "json_array" if fmt == "json" else fmt).alias("answer"),
                             F.lit(None).cast("string").alias("error")))
    return rows


def _shared_key(task: Mapping[str, Any]) -> str | None:
    """The key column of a task that group states can answer."""
    t = {**TASK_DEFAULTS, **task}
    if t["op"] not in GROUPED_OPS or t.get("join") or t["params"].get("keep_missing"):
        return None
    key = t["params"].get(GROUPED_OPS[t["op"]][0])
    return key if isinstance(key, str) else None


def _group_results(frames: Mapping[str, DataFrame], tasks: list[Mapping[str, Any]], taken: set[int]
                   ) -> tuple[dict[int, DataFrame], list[str]]:
    """Results of grouped tasks by position, and the paths of the written
    states. Two tasks over a source, at least, make it worth while. Tasks that do
    not plan, and all of a source whose states fail, are left to the path of
    single tasks, which reports what is wrong."""
    by_source: dict[str, dict[int, str]] = {}
    for pos, task in enumerate(tasks):
        key = _shared_key(task) if pos not in taken and task.get("source") in frames else None
        if key is not None:
            try:
                _check_columns(frames[task["source"]], task)
            except ValueError:
                continue
            by_source.setdefault(task["source"], {})[pos] = key
    results, paths = {}, []
    for source, keyed in by_source.items():
        if len(keyed) < 2:
            continue
        src = frames[source]
        means: dict[str, list[str]] = {k: [] for k in keyed.values()}
        for pos, key in keyed.items():
            if tasks[pos]["op"] == "group_mean" and "column" in tasks[pos].get("params", {}):
                means[key].append(tasks[pos]["params"]["column"])
        path = scratch_path(src.sparkSession, "group_states")
        paths.append(path)
        try:
            states = stats.group_states(src, means)
            states.write.partitionBy("grouping").parquet(path)
        except Exception:
            continue
        back = src.sparkSession.read.schema(states.schema).parquet(path)
        for pos, key in keyed.items():
            t = {**TASK_DEFAULTS, **tasks[pos]}
            try:
                results[pos] = _rounded(GROUPED_OPS[t["op"]][1](
                    stats.states_of(back, means, key), means, **dict(t["params"])), t["round"])
            except Exception:
                continue
    return results, paths


def _answer(frames: Mapping[str, DataFrame], task: Mapping[str, Any], tid: int, qid: str,
            result: DataFrame | None = None) -> DataFrame:
    fmt = task.get("output_format", TASK_DEFAULTS["output_format"])
    result = task_frame(frames, task) if result is None else result
    if fmt == "rows" or (fmt == "json" and task["op"] in LISTED_OPS):
        got = answer_rows(result).withColumnRenamed("element", "answer")
    else:
        got = format_answer(result, "json_array" if fmt == "json" else fmt) \
            .withColumn("position", F.lit(None).cast("long"))
    return got.select(F.lit(tid).alias("task_id"), F.lit(qid).alias("qid"), F.lit(fmt).alias("output_format"),
                      "position", "answer", F.lit(None).cast("string").alias("error"))


def _error(spark: SparkSession, task: Mapping[str, Any], tid: int, qid: str, exc: Exception) -> DataFrame:
    fmt = task.get("output_format", TASK_DEFAULTS["output_format"])
    return spark.createDataFrame([(tid, qid, fmt, None, None, f"{type(exc).__name__}: {exc}")], ANSWER_SCHEMA)


def _written(df: DataFrame) -> DataFrame:
    """Answers, computed once and kept in the shared folder; of a failed try
    nothing stays."""
    path = scratch_path(df.sparkSession, "answers")
    try:
        df.select(*ANSWER_COLUMNS).write.parquet(path)
    except Exception:
        remove_scratch(df.sparkSession, path)
        raise
    return df.sparkSession.read.schema(ANSWER_SCHEMA).parquet(path)


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], ANSWER_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_report_job(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    """Answers ``(task_id, qid, output_format, position, answer, error)``: one
    row per task, or one per element of a list-valued one. ``answer`` is JSON
    text. Scalar tasks over a source share one aggregate, grouped ones one table
    of group states."""
    check_spec(spec)
    tasks = spec["analysis_plan"]
    frames = load_sources(spark, spec["sourcing_plan"])
    named = []
    for pos, task in enumerate(tasks):
        tid = int(task.get("task_id", pos + 1))
        named.append((task, tid, str(task.get("qid", task.get("question_id", f"q{tid}")))))
    shared, done = _fused_answers(frames, tasks)
    results, scratch = _group_results(frames, tasks, done)
    for pos, result in results.items():
        try:
            shared.append(_answer(frames, *named[pos], result))
        except Exception:             # left to the path of single tasks
            continue
        done.add(pos)
    parts = []
    try:
        if shared:
            parts.append(_written(_union(spark, shared)))
    except Exception:                 # some shared task fails when it runs: all of them one by one
        done = set()
    for path in scratch:
        remove_scratch(spark, path)
    for pos, (task, tid, qid) in enumerate(named):
        if pos in done:
            continue
        try:
            parts.append(_written(_answer(frames, task, tid, qid)))
        except Exception as exc:      # when planned or when run: an error entry
            parts.append(_error(spark, task, tid, qid, exc))
    return _union(spark, parts)


def final_answer(spec: Mapping[str, Any], answers: DataFrame) -> DataFrame:
    """The final text in the declared format (failed tasks as ``null`` /
    ``"ERROR: ..."`` strings). Tasks that answered with rows are tables of
    their own and stay out of it."""
    fmt = spec["final_output_format"].get("format", "json_array")
    err = json_scalar(F.concat(F.lit("ERROR: "), F.col("error")))
    shaped = answers.where("position IS NULL").select("task_id", "qid",
                            F.when(F.col("error").isNull(), F.col("answer")).otherwise(err).alias("answer"))
    return assemble(shaped, fmt)
