"""Cleaning, projection and filter (#19-#31).

Every function maps DataFrame → DataFrame with built-in expressions, so
the steps fuse into one whole-stage-codegen projection/filter over the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.numbers import parse_currency as _currency
from tablework.functions.numbers import cast_number, parse_number, spark_type
from tablework.functions.text import MISSING_WORDS, null_if_missing, strip_ws


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise naming expected and found columns when any is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"column(s) {missing} not in the table, which has {df.columns}; "
                         f"needed are {list(columns)}")
    return df


def coerce_numeric(df: DataFrame, column: str, to: str = "bigint",
                   on_error: str = "drop") -> DataFrame:
    """Parse a text column as a number. Unparsable → NULL; with
    ``on_error="drop"`` the row is dropped (pandas ``to_numeric(errors=
    'coerce')`` + ``dropna`` + ``astype``)."""
    out = df.withColumn(column, parse_number(_q(column), to))
    if on_error == "drop":
        out = out.where(_q(column).isNotNull())
    elif on_error != "null":
        raise ValueError("on_error must be 'drop' or 'null'")
    return out


def parse_currency(df: DataFrame, column: str, to: str = "bigint") -> DataFrame:
    """``$1,234`` → 1234 in place; bad text → NULL."""
    return df.withColumn(column, _currency(_q(column), to))


def _cast_expr(c: Column, source: T.DataType, t: str) -> Column:
    if isinstance(source, T.StringType):
        if t in ("bigint", "int", "smallint", "tinyint", "double", "float") or t.startswith("decimal"):
            return cast_number(c, t)
        if t == "boolean":
            low = F.lower(strip_ws(c))
            return (F.when(low.isin("true", "t", "yes", "y", "1"), F.lit(True))
                    .when(low.isin("false", "f", "no", "n", "0"), F.lit(False)))
        return strip_ws(c).try_cast(t) if t != "string" else c
    return c.try_cast(t)


def apply_schema(df: DataFrame, schema: Mapping[str, str] | T.StructType,
                 on_mismatch: str = "null") -> DataFrame:
    """Cast columns to declared dtypes (pandas or Spark names).

    ``on_mismatch``: ``"null"`` leaves NULL where a value does not convert,
    ``"drop"`` drops such rows, ``"raise"`` fails the job on the first one
    (``raise_error`` inside the cast value itself, so the check runs
    wherever the value is computed and cannot be pruned away).
    """
    # a StructType is taken literally; names in a mapping may be pandas
    # style ("int64", "object", "int" = 64-bit) and are translated
    if isinstance(schema, T.StructType):
        schema = {f.name: f.dataType.simpleString() for f in schema.fields}
    else:
        schema = {k: spark_type(v) for k, v in schema.items()}
    if on_mismatch not in ("null", "drop", "raise"):
        raise ValueError("on_mismatch must be 'null', 'drop' or 'raise'")
    src = {f.name: f.dataType for f in df.schema.fields}
    require_columns(df, list(schema))
    cols, bad = [], []
    for name in df.columns:
        if name in schema:
            cast = _cast_expr(_q(name), src[name], schema[name])
            mismatch = _q(name).isNotNull() & cast.isNull()
            bad.append(mismatch)
            if on_mismatch == "raise":
                msg = F.concat(F.lit(f"value does not match declared type {schema[name]} of {name}: "),
                               _q(name).cast("string"))
                cast = F.when(mismatch, F.raise_error(msg)).otherwise(cast)
            cols.append(cast.alias(name))
        else:
            cols.append(_q(name))
    if on_mismatch == "drop" and bad:
        any_bad = F.greatest(*bad) if len(bad) > 1 else bad[0]
        return df.where(~any_bad).select(*cols)
    return df.select(*cols)


def strip_whitespace(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Strip all kinds of edge whitespace from string columns."""
    names = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[strip_ws(_q(c)).alias(c) if c in names else _q(c) for c in df.columns])


def null_literals(df: DataFrame, columns: Iterable[str] | None = None,
                  tokens: Iterable[str] = MISSING_WORDS) -> DataFrame:
    """Missing-value words (``nan``, ``NA``, ...) → NULL in string columns."""
    toks = list(tokens)
    names = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[null_if_missing(_q(c), toks).alias(c) if c in names else _q(c)
                       for c in df.columns])


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with NULL (or NaN) in the given columns."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop fully equal rows (hash aggregate with map-side partial dedup)."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[_q(c) for c in columns])


def filter_and(df: DataFrame, *conditions: Column | str) -> DataFrame:
    """Conjunction of predicates (Column or SQL text)."""
    cond = None
    for c in conditions:
        c = F.expr(c) if isinstance(c, str) else c
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)


def parse_dates(df: DataFrame, formats: Mapping[str, str], to: str = "date") -> DataFrame:
    """Parse text columns with declared formats (``dd-MM-yyyy``...); bad → NULL."""
    out = df
    for col, fmt in formats.items():
        c = strip_ws(_q(col))
        parsed = F.try_to_date(c, fmt) if to == "date" else F.try_to_timestamp(c, F.lit(fmt))
        out = out.withColumn(col, parsed)
    return out


# What a schema of VARIANT values says, and the column type it becomes: names
# (before a colon or in back quotes) stay, mixed or empty values are kept as text.
_VARIANT_WORD = re.compile(r"(`(?:[^`]|``)*`|[^\s<>,:`]+(?=:))|OBJECT<>|OBJECT(?=<)|VOID|VARIANT|DECIMAL\(\d+,\s*[1-9]\d*\)")
_VARIANT_TYPE = {"OBJECT<>": "STRING", "OBJECT": "STRUCT", "VOID": "STRING", "VARIANT": "STRING"}


def json_schemas(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The type of each JSON text column, told from all its values: keys of all
    records united, types widened (whole numbers and fractions to double, values of
    several kinds to text). One aggregate over all columns whose states merge; one
    row comes back. Text that is no JSON and missing values say nothing; a column
    without a value, or of plain values, is a STRING."""
    row = df.agg(*[F.schema_of_variant_agg(F.try_parse_json(_q(c))).alias(f"c{i}")
                   for i, c in enumerate(columns)]).first()

    def typed(m: re.Match) -> str:
        return m[1] or _VARIANT_TYPE.get(m[0], "DOUBLE")

    found = {c: _VARIANT_WORD.sub(typed, row[i] or "VOID") for i, c in enumerate(columns)}
    return {c: t if t.startswith(("STRUCT<", "ARRAY<")) else "STRING" for c, t in found.items()}


def flatten(df: DataFrame, sep: str = "_", explode_arrays: bool = True,
            json_columns: Mapping[str, T.StructType | str] | Sequence[str] | None = None) -> DataFrame:
    """Flatten nested records to top-level columns.

    JSON text columns listed in ``json_columns`` are parsed first: a mapping
    declares their schemas; of columns that are only named, the schemas are told
    from the data (``json_schemas``: one pass more, while the plan is built). A
    value that does not fit is NULL. Structs become ``parent_child``
    columns; arrays are exploded (``explode_outer``, one at a time, so rows
    with empty arrays survive) when ``explode_arrays``.
    """
    if json_columns and not isinstance(json_columns, Mapping):
        named = [json_columns] if isinstance(json_columns, str) else list(json_columns)
        json_columns = {c: t for c, t in json_schemas(df, named).items() if t != "STRING"}
    for col, schema in (json_columns or {}).items():
        df = df.withColumn(col, F.from_json(_q(col), schema))
    while True:
        fields = df.schema.fields
        struct = next((f for f in fields if isinstance(f.dataType, T.StructType)), None)
        array = next((f for f in fields if isinstance(f.dataType, T.ArrayType)), None)
        if struct is not None:
            cols = []
            for f in fields:
                if f.name == struct.name:
                    cols += [_q(f.name)[g.name].alias(f"{f.name}{sep}{g.name}")
                             for g in f.dataType.fields]
                else:
                    cols.append(_q(f.name))
            df = df.select(*cols)
        elif array is not None and explode_arrays:
            df = df.withColumn(array.name, F.explode_outer(_q(array.name)))
        else:
            return df


def rows_to_table(rows: DataFrame, keys: Sequence[str], *, schema: T.StructType | str | Mapping[str, str] | None = None,
                  header: bool = True, on_mismatch: str = "null",
                  cells_col: str = "cells", row_col: str = "row_idx") -> DataFrame:
    """Cell-array rows (from HTML tables or workbooks) → typed table.

    Row 0 of each table is the header when ``header`` (no shuffle needed);
    cells are matched to ``schema`` by position.
    Without a schema the column names come from one header row (a one-row
    action) and every column stays a string.
    """
    data = rows.where(F.col(row_col) != 0) if header else rows
    if schema is None:
        head = rows.orderBy(*keys, row_col).select(cells_col).first()
        names = [str(c) for c in (head[0] if head else [])]
        decl = {n: "string" for n in names}
    elif isinstance(schema, str):
        decl = T.StructType.fromDDL(schema)
    else:
        decl = schema
    names = decl.fieldNames() if isinstance(decl, T.StructType) else list(decl)
    typed = data.select(*keys, *[F.try_element_at(F.col(cells_col), F.lit(i + 1)).alias(n)
                                 for i, n in enumerate(names)])
    return apply_schema(typed, decl, on_mismatch)


def clean_table(df: DataFrame, *, required: Sequence[str] = (), strip: Sequence[str] = (),
                null_tokens: Mapping[str, Iterable[str]] | None = None,
                numeric: Mapping[str, str] | None = None, dates: Mapping[str, str] | None = None,
                drop_missing_in: Sequence[str] = (), dedupe: bool = False
                ) -> tuple[DataFrame, DataFrame]:
    """Apply a declared cleaning and report what each rule dropped.

    Order: strip → missing words → numeric parse → date parse → drop rows
    whose parsed numeric / listed columns are missing → drop duplicates.
    Returns ``(clean, report)``; the report ``(step, rows)`` has rows
    loaded, rows dropped per rule (each row charged to the first rule it
    fails) and the final count. Without ``dedupe`` it is one aggregate over
    the scan; with it, one grouped pass (rows by all columns, map-side
    combined) gives every figure. Nothing is collected.
    """
    require_columns(df, list(required) + list(strip) + list((numeric or {}).keys())
                    + list(drop_missing_in))
    out = strip_whitespace(df, strip) if strip else df
    for col, toks in (null_tokens or {}).items():
        out = null_literals(out, [col], toks)
    for col, to in (numeric or {}).items():
        out = out.withColumn(col, parse_number(_q(col), to))
    if dates:
        out = parse_dates(out, dates)
    rules: list[tuple[str, Column]] = []
    for col in (numeric or {}):
        rules.append((f"invalid {col}", _q(col).isNull()))
    for col in drop_missing_in:
        if col not in (numeric or {}):
            value = _q(col)
            if isinstance(out.schema[col].dataType, (T.DoubleType, T.FloatType)):
                value = F.nullif(value, F.lit(float("nan")))      # NaN is missing too
            rules.append((f"missing {col}", value.isNull()))
    kept = out
    if rules:
        keep = ~F.greatest(*[r for _, r in rules]) if len(rules) > 1 else ~rules[0][1]
        kept = out.where(keep)
    final = drop_duplicates(kept) if dedupe else kept
    # first-failing-rule attribution in one pass
    failed = F.lit(None).cast("string")
    for name, cond in reversed(rules):
        failed = F.when(cond, F.lit(name)).otherwise(failed)

    def long(frame: DataFrame, items: list[tuple[int, str, Column]]) -> DataFrame:
        return frame.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("position"), F.lit(n).alias("step"), c.cast("bigint").alias("rows"))
            for i, n, c in items])).alias("r")).select("r.*")

    head = [(0, "loaded", F.col("loaded"))]
    head += [(i + 1, f"dropped: {name}", F.col(f"r{i}")) for i, (name, _) in enumerate(rules)]
    end_pos = len(rules) + 1
    if not dedupe:
        aggs = [F.count("*").alias("loaded")]
        aggs += [F.count_if(failed == F.lit(name)).alias(f"r{i}") for i, (name, _) in enumerate(rules)]
        counts = out.agg(*aggs).withColumn(
            "kept", F.col("loaded") - sum((F.col(f"r{i}") for i in range(len(rules))), F.lit(0)))
        report = long(counts, head + [(end_pos, "final", F.col("kept"))])
        return final, report
    # With dedupe every figure comes from one pass: the parsed rows grouped
    # by all columns (map-side combined, the same shuffle a dedupe needs);
    # each group is one distinct row with its multiplicity.
    n = F.col("__tw_n")
    grouped = out.groupBy(*[_q(c) for c in out.columns]).agg(F.count("*").alias("__tw_n"))
    keep_row = ~F.greatest(*[r for _, r in rules]) if len(rules) > 1 else (~rules[0][1] if rules else F.lit(True))
    aggs = [F.sum(n).alias("loaded")]
    aggs += [F.coalesce(F.sum(F.when(failed == F.lit(name), n)), F.lit(0)).alias(f"r{i}")
             for i, (name, _) in enumerate(rules)]
    aggs += [F.coalesce(F.sum(F.when(keep_row, n)), F.lit(0)).alias("kept"),
             F.count_if(keep_row).alias("final")]
    counts = grouped.agg(*aggs).withColumn("dup", F.col("kept") - F.col("final"))
    report = long(counts, head + [(end_pos, "dropped: duplicate", F.col("dup")),
                                  (end_pos + 1, "final", F.col("final"))])
    return final, report
