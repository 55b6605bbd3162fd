"""Model responses, answers, runs and grading as tables (#73-#79).

Large tables of responses and run records are processed with built-in
string, array and aggregate functions; per-task roll-ups are grouped
aggregates with map-side partial state (``max_by`` keeps one candidate per
key per task), so a task id with a third of all attempts is still combined
before the shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions.text import block_text, last_line, strip_fences, strip_ws

# Log-line prefixes passed over when taking the result line.
LOG_PREFIXES = ("DEBUG:", "INFO:")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def strip_code_fences(df: DataFrame, column: str, code_only: bool = True,
                      out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, strip_fences(_q(column), code_only))


def response_text(df: DataFrame, content: str = "content", out: str = "text",
                  nested: bool = False) -> DataFrame:
    return df.withColumn(out, block_text(_q(content), nested))


def result_line(df: DataFrame, column: str, skip_prefixes: Iterable[str] = (),
                out: str = "last_line") -> DataFrame:
    return df.withColumn(out, last_line(_q(column), skip_prefixes))


# Python int() / float() accept these shapes (underscores between digits too).
_INT_TEXT = r"^[+-]?[0-9]+(_[0-9]+)*$"
_FLOAT_TEXT = (r"^[+-]?(([0-9]+(_[0-9]+)*)?\.?[0-9]+(_[0-9]+)*|[0-9]+(_[0-9]+)*\.)"
               r"([eE][+-]?[0-9]+(_[0-9]+)*)?$")


def parse_number_text(s: Column) -> Column:
    """Number of a result line as ``int(s)`` else ``float(s)`` would give."""
    t = strip_ws(s)
    plain = F.regexp_replace(t, "_", "")
    low = F.lower(t)
    special = (F.when(low.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
               .when(low.rlike(r"^-(inf|infinity)$"), F.lit(float("-inf")))
               .when(low.rlike(r"^\+?(inf|infinity)$"), F.lit(float("inf"))))
    return (F.when(t.rlike(_INT_TEXT), plain.try_cast("double"))
            .when(t.rlike(_FLOAT_TEXT), plain.try_cast("double"))
            .otherwise(special))


def parse_answer(df: DataFrame, text: str, fmt: str | Column) -> DataFrame:
    """Typed parse of a result line by output format.

    Adds ``num`` (number formats: int, else float), ``is_int``, ``int_value``
    (an integer's exact value, up to 38 digits), ``str``
    (string format: one pair of matching outer quotes removed; other
    formats: the text) and ``json`` (json / json_object / json_array:
    parsed as VARIANT; failure → NULL).
    """
    f = F.lit(fmt) if isinstance(fmt, str) else fmt
    t = _q(text)
    # as the Python check: a text that starts and ends with the same quote
    # (a lone quote too) loses its first and last character
    quoted = (t.startswith('"') & t.endswith('"')) | (t.startswith("'") & t.endswith("'"))
    unq = F.when(quoted, F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(t)
    is_json = f.isin("json", "json_object", "json_array")
    return df.select(
        "*",
        F.when(f == "number", parse_number_text(t)).alias("num"),
        F.when(f == "number", strip_ws(t).rlike(_INT_TEXT)).alias("is_int"),
        F.when((f == "number") & strip_ws(t).rlike(_INT_TEXT),
               F.regexp_replace(strip_ws(t), "_", "").try_cast("decimal(38,0)")).alias("int_value"),
        F.when(f == "string", unq).when(~is_json & (f != "number"), t).alias("str"),
        F.when(is_json, F.try_parse_json(t)).alias("json"))


def answer_rollup(answers: DataFrame, error: str = "error") -> DataFrame:
    """Succeeded / failed totals of an answers table."""
    return answers.agg(F.count("*").alias("total"),
                       F.count_if(_q(error).isNull()).alias("succeeded"),
                       F.count_if(_q(error).isNotNull()).alias("failed"))


def run_report(history: DataFrame, task: str = "task_id", attempt: str | Column = "attempt",
               success: str = "success", error: str = "error", error_chars: int = 200) -> DataFrame:
    """Per task: attempts, final status, final error cut to ``error_chars``.

    ``attempt`` orders a task's records (a column or a struct of columns,
    e.g. ``struct(ts, event_id)``); the last one decides the final status.
    """
    order = _q(attempt) if isinstance(attempt, str) else attempt
    last = F.max_by(F.struct(_q(success).alias("success"),
                             F.substring(_q(error), 1, error_chars).alias("error")), order)
    return (history.groupBy(_q(task))
            .agg(F.count("*").alias("attempts"),
                 F.count_if(~_q(success)).alias("failures"),
                 last.alias("last"))
            .select(_q(task), "attempts", "failures",
                    F.col("last.success").alias("final_success"),
                    F.col("last.error").alias("final_error")))


KEY_FIELDS = ("item", "kind", "expected", "tolerance", "n_items", "weight")


def _rubric_array(rows: Sequence[Mapping[str, Any]]) -> Column:
    """A literal rubric. Expected values are JSON text or else plain text, as in
    a key table: 10 and "10" mean the number, '"10"' the text."""
    return F.array(*[F.struct(
        F.lit(r.get("item", 0)).cast("int").alias("item"),
        F.lit(r["kind"]).cast("string").alias("kind"),
        F.lit(_expected(r)).cast("string").alias("expected"),
        F.lit(r.get("tolerance", 0.0)).cast("double").alias("tolerance"),
        F.lit(r.get("n_items")).cast("int").alias("n_items"),
        F.lit(r.get("weight", 1.0)).cast("double").alias("weight")) for r in rows])


def _expected(r: Mapping[str, Any]) -> str | None:
    value = r.get("expected")
    if value is None:
        return None
    return value if isinstance(value, str) else json.dumps(value)


# Names of the number types of a VARIANT.
_VARIANT_NUMBER = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _is_number(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(_VARIANT_NUMBER), F.lit(False))


def _same(item: Column, expected: Column) -> Column:
    """Equal values of one JSON type: numbers by value, texts without edge
    white space. An expected text that is not JSON is a text."""
    want = F.try_parse_json(expected)
    want_text = F.when(want.isNull(), expected).when(F.schema_of_variant(want) == "STRING", _text(want))
    number = lambda v: F.try_variant_get(v, "$", "double")
    exact = lambda v: F.try_variant_get(v, "$", "decimal(38,0)")
    as_number = number(item) == number(want)
    whole = (F.schema_of_variant(item) == "BIGINT") & (F.schema_of_variant(want) == "BIGINT")
    same = (F.when(want_text.isNotNull(),
                   (F.schema_of_variant(item) == "STRING") & (strip_ws(_text(item)) == strip_ws(want_text)))
            .when(_is_number(want), _is_number(item) & F.when(whole, exact(item) == exact(want)).otherwise(as_number))
            .otherwise((F.schema_of_variant(item) == F.schema_of_variant(want)) & (_text(item) == _text(want))))
    return F.coalesce(same, F.lit(False))


def _check(k: Column, items: Column, n: Column) -> Column:
    """Whether one line of a key holds for a parsed answer."""
    item = F.try_element_at(items, k["item"] + 1)
    value = F.when(_is_number(item), F.try_variant_get(item, "$", "double")) \
        .when(F.schema_of_variant(item) == "STRING", parse_number_text(_text(item)))
    want = parse_number_text(F.regexp_replace(k["expected"], '^"|"$', ""))
    ok = (F.when(k["kind"] == "is_json", n == k["n_items"])
          .when(k["kind"] == "equals", _same(item, k["expected"]))
          .when(k["kind"] == "regex", F.regexp(_text(item), F.concat(F.lit("(?i)"), k["expected"])))
          .when(k["kind"] == "within", F.abs(value - want) <= k["tolerance"]))
    return F.coalesce(ok, F.lit(False))


def grade(submissions: DataFrame, key: DataFrame | Sequence[Mapping[str, Any]], *,
          submission: str = "submission_id", answer: str = "answer",
          rubric: str = "rubric") -> DataFrame:
    """Score JSON-array submissions against an answer key, row by row.

    Key rows: ``(item INT (0-based), kind, expected STRING, tolerance
    DOUBLE, n_items INT, weight DOUBLE)`` with kinds ``is_json`` (gate: the
    answer is a JSON array of ``n_items`` items), ``equals`` (item equals
    expected, type and value: the text "1" is not the number 1, and 1.0 is),
    ``regex`` (case-insensitive search in the item's text), ``within``
    (|item - expected| <= tolerance, of a number or a text that is one). A
    failed gate zeroes the submission.

    ``key`` is either a literal rubric (list of dicts) or a key table with a
    ``rubric`` column that submissions share: its lines are gathered per rubric
    and equi-joined. Either way the lines meet a submission inside its row, so
    nothing is multiplied or grouped back, and submissions of one id stay
    apart. ``expected`` is JSON text or else plain text.
    Output ``(submission, score, max_score, gate_ok, passed, checks)``.
    """
    ans = _q(answer)
    # NULL for invalid JSON and for values that are no array
    parsed = [_q(submission).alias("__sid"), F.json_array_length(ans).alias("__n"),
              F.try_variant_get(F.try_parse_json(ans), "$", "array<variant>").alias("__items")]
    if isinstance(key, DataFrame):
        lines = key.groupBy(_q(rubric).alias("__rubric")).agg(
            F.collect_list(F.struct(*KEY_FIELDS)).alias("__key"))
        rows = submissions.select(*parsed, _q(rubric).alias("__rubric")).join(lines, "__rubric")
    else:
        rows = submissions.select(*parsed).withColumn("__key", _rubric_array(key))
    checked = rows.select("__sid", F.transform("__key", lambda k: F.struct(
        (k["kind"] == "is_json").alias("gate"), k["weight"].alias("weight"),
        _check(k, F.col("__items"), F.col("__n")).alias("ok"))).alias("__c"))
    gates, scored = (F.filter("__c", lambda c: c["gate"]), F.filter("__c", lambda c: ~c["gate"]))
    gate_ok = F.forall(gates, lambda c: c["ok"])
    total = lambda rows: F.aggregate(rows, F.lit(0.0), lambda s, c: s + c["weight"])
    passed = F.filter(scored, lambda c: c["ok"])
    return checked.select(
        F.col("__sid").alias(submission),
        F.when(gate_ok, total(passed)).otherwise(0.0).alias("score"), total(scored).alias("max_score"),
        gate_ok.alias("gate_ok"), F.size(passed).cast("bigint").alias("passed"),
        F.size(scored).cast("bigint").alias("checks"))
