"""Typed JSON answers (#71-#72).

``format_answer`` makes one JSON text of a result. There is no cap: every row
of the result is in the text. Elements are ordered and written by many tasks,
in chunks; only the chunks' texts meet, in the one row that is asked for. A
result whose text is too long for one value (2 GB) is written as rows instead
(``answer_rows``): one element per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 12             # elements written together: 4,096 at most

FORMATS = ("number", "string", "json_array", "json_object", "records")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def json_scalar(c: Column) -> Column:
    """JSON text of one scalar value (number, string, boolean, null)."""
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)


def _listed(df: DataFrame, item: Column, order: Sequence[Column]) -> DataFrame:
    keyed = df.select(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], item.alias("v")).alias("e"))
    return keyed.agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["v"]).alias("items"))


def _inner(c: Column) -> Column:
    """A JSON text without its outer brackets."""
    return F.substring(c, F.lit(2), F.length(c) - 2)


def _joined(rows: DataFrame, text: Column, order: Sequence[Column]) -> DataFrame:
    """One row, ``text``: ``text`` of all rows in order, commas between."""
    join = lambda at: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(at, "t"))), lambda e: e["t"]), ",")
    chunks = rows.orderBy(*order).select(F.monotonically_increasing_id().alias("at"), text.alias("t")) \
        .groupBy(F.shiftright("at", CHUNK_BITS).alias("chunk")).agg(join("at").alias("t"))
    return chunks.agg(join("chunk").alias("text"))


def _first(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(1)


def _key(c: Column) -> Column:
    """A key of a JSON object; a missing one is called null."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def answer_rows(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """A list-valued result as rows ``(position, element)``: JSON text of every
    row (of a single column: the value), with positions that grow in the order
    of ``order_by`` (default: all columns) and may leave gaps. The order is a
    range partitioning; nothing meets in one task."""
    cols = df.columns
    one = F.struct(*[_q(c) for c in cols])
    element = json_scalar(_q(cols[0])) if len(cols) == 1 else F.to_json(one)
    return df.orderBy(*[_q(c) for c in (order_by or cols)]).select(
        F.monotonically_increasing_id().alias("position"), element.alias("element"))


def format_answer(df: DataFrame, fmt: str, *, order_by: Sequence[str] | None = None) -> DataFrame:
    """One result frame → one row ``(output_format, answer)``.

    ``number`` / ``string``: first column of the first row (NULL answer
    when the frame is empty). ``json_array``: a one-column frame becomes a
    list of values, a wider frame a list of records. ``json_object``: a
    two-column frame becomes ``{key: value}``; a one-row frame becomes the
    record itself. ``records``: always a list of records. Element order
    follows ``order_by`` (default: all columns), so the text is
    deterministic. Equal keys of a ``json_object`` are an error.
    """
    cols = df.columns
    order = [_q(c) for c in (order_by or cols)]
    if fmt in ("number", "string"):
        v = _q(cols[0])
        val = v.cast("string") if fmt == "number" else json_scalar(v.cast("string"))
        one = _listed(_first(df, order), val, order)
        ans = F.try_element_at(F.col("items"), F.lit(1))
    elif fmt in ("json_array", "records"):
        item = _q(cols[0]) if (len(cols) == 1 and fmt == "json_array") else F.struct(*[_q(c) for c in cols])
        one = _joined(df, _inner(F.to_json(F.array(item))), [*order, item])
        ans = F.concat(F.lit("["), F.col("text"), F.lit("]"))
    elif fmt == "json_object":
        if len(cols) == 2:
            key = _key(_q(cols[0]))
            rows = df.select(*[o.alias(f"o{i}") for i, o in enumerate(order)],
                             F.struct(key.alias("k"), _q(cols[1]).alias("v")).alias("e"),
                             F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
            # A key found more than once stands twice in its own map, which raises.
            entry = F.when(F.col("n") > 1, F.array("e", "e")).otherwise(F.array("e"))
            one = _joined(rows, _inner(F.to_json(F.map_from_entries(entry))),
                          [*[F.col(f"o{i}") for i in range(len(order))], F.col("e")])
            ans = F.concat(F.lit("{"), F.col("text"), F.lit("}"))
        else:
            one = _listed(_first(df, order), F.struct(*[_q(c) for c in cols]), order)
            ans = F.to_json(F.try_element_at(F.col("items"), F.lit(1)))
    else:
        raise ValueError(f"unknown output format {fmt!r}; use one of {FORMATS}")
    return one.select(F.lit(fmt).alias("output_format"), ans.alias("answer"))


def answer_expr(cols: Sequence[tuple[str, Column]], fmt: str) -> Column:
    """The answer text ``format_answer`` gives for a one-row frame whose
    columns are ``cols``, as a column expression (used where several
    one-row results come out of one shared aggregate)."""
    named = [c.alias(n) for n, c in cols]
    if fmt == "number":
        return cols[0][1].cast("string")
    if fmt == "string":
        return json_scalar(cols[0][1].cast("string"))
    if fmt == "json_array":
        return F.to_json(F.array(cols[0][1] if len(cols) == 1 else F.struct(*named)))
    if fmt == "records":
        return F.to_json(F.array(F.struct(*named)))
    if fmt == "json_object":
        if len(cols) == 2:
            return F.to_json(F.create_map(_key(cols[0][1]), cols[1][1]))
        return F.to_json(F.struct(*named))
    raise ValueError(f"unknown output format {fmt!r}; use one of {FORMATS}")


def assemble(answers: DataFrame, fmt: str = "json_array", *, order: str = "task_id",
             key: str = "qid", value: str = "answer") -> DataFrame:
    """All answers (JSON text per task) → one final text.

    ``json_array``: ``[a1, a2, ...]``; ``array_of_strings``: every answer
    as a JSON string; ``json_object``: ``{qid: answer}``; ``string``:
    answers joined by newlines. Ordered by ``order``.
    """
    o = [_q(order)]
    if fmt == "json_array":
        lst = _listed(answers, F.coalesce(_q(value), F.lit("null")), o)
        out = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    elif fmt == "array_of_strings":
        lst = _listed(answers, _q(value), o)
        out = F.to_json(F.transform("items", lambda s: F.coalesce(s, F.lit("null"))))
    elif fmt == "json_object":
        lst = _listed(answers, F.concat(json_scalar(_q(key).cast("string")), F.lit(":"),
                                              F.coalesce(_q(value), F.lit("null"))), o)
        out = F.concat(F.lit("{"), F.array_join("items", ","), F.lit("}"))
    elif fmt == "string":
        lst = _listed(answers, F.coalesce(_q(value), F.lit("")), o)
        out = F.array_join("items", "\n")
    else:
        raise ValueError(f"unknown final format {fmt!r}")
    return lst.select(F.lit(fmt).alias("format"), out.alias("result"))
