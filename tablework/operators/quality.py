"""Validation and profiling (#32-#36).

Each report is a handful of aggregates fused into one pass over the data,
then unpivoted into long form: one row per rule or column.
Nothing holds a whole column in memory (no ``collect_set``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.numbers import parse_number, spark_type
from tablework.functions.text import strip_ws
from tablework.operators import distinct_states
from tablework.operators.stats import no_nan


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _lit_str(s: str | None) -> Column:
    return F.lit(s).cast("string")


def validate(df: DataFrame, rules: Mapping[str, Any]) -> DataFrame:
    """Check declared rules → ``(rule, column, violations, passed)``.

    Rules: ``required`` (columns that must exist; violation 1 when absent),
    ``types`` ({column: dtype}: non-NULL values that do not convert),
    ``not_null`` (columns: NULL count), ``unique`` (column lists: rows in
    duplicated key groups beyond the first), ``non_empty`` (True: 1 when
    the table has no rows). One aggregate pass for row-level rules, one
    group-by per uniqueness rule.
    """
    rows: list[tuple[str, str | None, Column]] = []
    present = set(df.columns)
    for c in rules.get("required", []):
        rows.append(("required", c, F.lit(0 if c in present else 1).cast("bigint")))
    aggs: dict[str, Column] = {}
    i = 0
    for c, dtype in rules.get("types", {}).items():
        if c not in present:
            continue
        src = df.schema[c].dataType
        t = spark_type(dtype)
        if isinstance(src, T.StringType) and t not in ("string",):
            conv = parse_number(_q(c), t, aliases=False) if t in ("bigint", "int", "double", "float") \
                else strip_ws(_q(c)).try_cast(t)
        else:
            conv = _q(c).try_cast(t)
        aggs[f"a{i}"] = F.count_if(_q(c).isNotNull() & conv.isNull())
        rows.append(("type", c, F.col(f"a{i}")))
        i += 1
    for c in rules.get("not_null", []):
        if c in present:
            aggs[f"a{i}"] = F.count_if(_q(c).isNull())
            rows.append(("not_null", c, F.col(f"a{i}")))
            i += 1
    if rules.get("non_empty"):
        aggs[f"a{i}"] = F.when(F.count("*") == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        rows.append(("non_empty", None, F.col(f"a{i}")))
        i += 1

    def long(frame: DataFrame, items: list[tuple[int, str, str | None, Column]]) -> DataFrame:
        return frame.select(F.explode(F.array(*[
            F.struct(F.lit(p).alias("position"), F.lit(r).alias("rule"),
                     _lit_str(c).alias("column"), v.cast("bigint").alias("violations"))
            for p, r, c, v in items])).alias("e")).select("e.*")

    items = [(p, r, c, v) for p, (r, c, v) in enumerate(rows)]
    base = df.agg(*[v.alias(k) for k, v in aggs.items()]) if aggs else df.sparkSession.range(1)
    out = long(base, items) if items else None
    for j, key in enumerate(rules.get("unique", [])):
        cols = [key] if isinstance(key, str) else list(key)
        dup = (df.groupBy(*[_q(c) for c in cols]).agg(F.count("*").alias("n"))
               .agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("u")))
        part = long(dup, [(len(rows) + j, "unique", ",".join(cols), F.col("u"))])
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no rules given")
    return out.withColumn("passed", F.col("violations") == 0)


def _exact_distincts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(position, n_distinct)`` of the columns. Whole-number-like ones share one
    scan and one aggregate of words; of the others each is made distinct on its own
    (map-side combine, a scan of that column alone), as several exact distincts in
    one aggregate would copy every row once per column."""
    whole = {i: f"c{i}" for i, c in enumerate(cols) if distinct_states.supported(df.schema[c].dataType)}
    if len(whole) < 2:
        whole = {}
    parts = []
    if whole:
        states = distinct_states.distinct_states(df.select(*[_q(cols[i]).alias(n) for i, n in whole.items()]),
                                                 list(whole.values()))
        counts = [F.struct(F.lit(i).alias("position"), F.col(n).alias("n_distinct")) for i, n in whole.items()]
        parts.append(states.agg(*[distinct_states.count_of(n).alias(n) for n in whole.values()])
                     .select(F.explode(F.array(*counts)).alias("d")).select("d.*"))
    for i, c in enumerate(cols):
        if i not in whole:
            parts.append(df.select(no_nan(df, c).alias("v")).where("v IS NOT NULL").distinct()
                         .agg(F.count(F.lit(1)).alias("n_distinct")).select(F.lit(i).alias("position"), "n_distinct"))
    return reduce(DataFrame.unionByName, parts)


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact_distinct: bool = False,
            top_k: int = 0) -> DataFrame:
    """One row per column: ``(position, column, dtype, n_rows, n_null,
    n_distinct, min_value, max_value[, frequent])``.

    NULL and NaN are missing. Distinct counts are HyperLogLog++ sketches unless
    ``exact_distinct``;
    ``min``/``max`` are rendered as text. ``top_k > 0`` adds the most
    frequent values (one grouped count per column, top-k per column by
    ``TakeOrderedAndProject``), never the whole column.
    """
    cols = list(columns) if columns else df.columns
    aggs = [F.count("*").alias("__n")]
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        present = no_nan(df, c)
        aggs.append(F.count_if(present.isNull()).alias(f"nul{i}"))
        if not exact_distinct:
            aggs.append(F.approx_count_distinct(present).alias(f"dis{i}"))
        if isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            aggs += [F.lit(None).cast("string").alias(f"min{i}"), F.lit(None).cast("string").alias(f"max{i}")]
        else:
            aggs += [F.min(present).cast("string").alias(f"min{i}"), F.max(present).cast("string").alias(f"max{i}")]
    wide = df.agg(*aggs)
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                        F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                        F.col("__n").alias("n_rows"), F.col(f"nul{i}").alias("n_null"),
                        *([] if exact_distinct else [F.col(f"dis{i}").cast("bigint").alias("n_distinct")]),
                        F.col(f"min{i}").alias("min_value"), F.col(f"max{i}").alias("max_value"))
               for i, c in enumerate(cols)]
    out = wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    if exact_distinct:
        out = out.join(_exact_distincts(df, cols), "position").select(
            "position", "column", "dtype", "n_rows", "n_null", "n_distinct", "min_value", "max_value")
    if top_k > 0:
        freq = None
        for c in cols:
            top = (df.groupBy(_q(c).cast("string").alias("value")).agg(F.count("*").alias("n"))
                   .orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(top_k)
                   .agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "value")))
                        .alias("frequent"))
                   .select(F.lit(c).alias("column"),
                           F.transform("frequent", lambda s: s["value"]).alias("frequent")))
            freq = top if freq is None else freq.unionByName(top)
        out = out.join(freq, "column", "left")            # both sides: one row per column
    return out


def infer_date_format(df: DataFrame, column: str, candidates: Sequence[str]) -> DataFrame:
    """Share of non-empty values each candidate format parses, in one
    aggregate → ``(position, format, n_parsed, n_values, share)``; the best
    format is the one with the largest share (first candidate on ties)."""
    c = strip_ws(_q(column))
    aggs = [F.count_if(c.isNotNull() & (c != "")).alias("__n")]
    aggs += [F.count_if(F.try_to_timestamp(c, F.lit(fmt)).isNotNull()).alias(f"f{i}")
             for i, fmt in enumerate(candidates)]
    wide = df.agg(*aggs)
    entries = [F.struct(F.lit(i).alias("position"), F.lit(fmt).alias("format"),
                        F.col(f"f{i}").alias("n_parsed"), F.col("__n").alias("n_values"))
               for i, fmt in enumerate(candidates)]
    return (wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
            .withColumn("share", F.coalesce(F.try_divide(F.col("n_parsed"), F.col("n_values")), F.lit(0.0))))


def best_date_format(df: DataFrame, column: str, candidates: Sequence[str]) -> DataFrame:
    """The single best candidate: ``(format, share)``."""
    return (infer_date_format(df, column, candidates)
            .orderBy(F.col("share").desc(), F.col("position")).limit(1)
            .select("format", "share"))


def schema_of(df: DataFrame) -> DataFrame:
    """``(position, column, dtype)`` from the DataFrame schema (no data read)."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position INT, column STRING, dtype STRING")


def sample_rows(df: DataFrame, n: int, order_by: Sequence[str | Column],
                tie_break: bool = True) -> DataFrame:
    """First ``n`` rows by an explicit order key (no row order exists
    otherwise). With ``tie_break`` every other column is appended to the
    key, so equal keys cannot make the cut nondeterministic. Plans as
    TakeOrderedAndProject (per-partition top-n, no global sort)."""
    if not order_by:
        raise ValueError("sample_rows needs an order key")
    keys = list(order_by)
    if tie_break:
        named = {k for k in keys if isinstance(k, str)}
        keys += [_q(c) for c in df.columns if c not in named]
    return df.orderBy(*keys).limit(n)
