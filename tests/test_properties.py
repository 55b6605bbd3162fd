"""Property checks of the text-to-number parse against a plain Python
model of the same rules, on generated strings (one Spark job per batch)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tablework.functions.numbers import parse_bigint, parse_double

_NUM = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
_LO, _HI = -2 ** 63, 2 ** 63 - 1


def model_bigint(s):
    if s is None:
        return None
    t = s.strip()
    if not _NUM.fullmatch(t):
        return None
    if not any(ch in t for ch in ".eE"):
        v = int(t)
    else:
        f = float(t)
        if f in (float("inf"), float("-inf")):
            return None
        if not (-(2.0 ** 63) <= f < 2.0 ** 63):
            return None
        v = int(f)
    return v if _LO <= v <= _HI else None


def model_double(s):
    if s is None:
        return None
    t = s.strip()
    if not _NUM.fullmatch(t):
        return None
    f = float(t)
    return None if f in (float("inf"), float("-inf")) else f


pieces = st.sampled_from(["", "+", "-", "0", "7", "12", "999999999999999999999", ".", "5", "e", "E",
                          "e+3", "E-2", "e400", "D", "F", " ", "\t", " ", "x", "1_0", "9007199254740993"])
texts = st.one_of(st.none(), st.lists(pieces, min_size=0, max_size=6).map("".join))


@settings(max_examples=8, deadline=None)
@given(st.lists(texts, min_size=20, max_size=120))
def test_parse_bigint_matches_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(parse_bigint("s")).collect()]
    assert got == [model_bigint(v) for v in values]


@settings(max_examples=8, deadline=None)
@given(st.lists(texts, min_size=20, max_size=120))
def test_parse_double_matches_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(parse_double("s")).collect()]
    assert got == [model_double(v) for v in values]


def model_answer_number(s):
    """The number a result line gives: int(s), else float(s), else None."""
    if s is None:
        return None
    try:
        return float(int(s))
    except (ValueError, OverflowError):
        pass
    try:
        return float(s)
    except ValueError:
        return None


answer_pieces = st.sampled_from(["", "+", "-", "0", "42", "3", ".", "14", "_", "e", "E+2", "e-1", "inf",
                                 "Infinity", "nan", "NaN", " ", "\t", "x", "1_000"])
answer_texts = st.one_of(st.none(), st.lists(answer_pieces, min_size=0, max_size=5).map("".join))


@settings(max_examples=8, deadline=None)
@given(st.lists(answer_texts, min_size=20, max_size=120))
def test_answer_number_matches_python(spark, values):
    import math

    from pyspark.sql import functions as F

    from tablework.operators.responses import parse_number_text
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(parse_number_text(F.col("s"))).collect()]
    want = [model_answer_number(v) for v in values]
    for g, w, v in zip(got, want, values):
        if w is not None and math.isnan(w):
            assert g is not None and math.isnan(g), v
        else:
            assert g == w, (v, g, w)


def test_cast_number_equals_parse_number(spark):
    import random

    from tablework.functions.numbers import cast_number, parse_number
    rng = random.Random(11)
    bits = ["1", "9", "0", "-", "+", ".", "e", "E", " ", "\t", "\xa0", "D", "F", "x", "inf", "nan", "5" * 25, ""]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 7))) for _ in range(4000)]
    texts += ["9223372036854775807", "9223372036854775808", "-9223372036854775808", "1e999", "1" * 400, "1.9", "-0", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t in ("bigint", "int", "double", "decimal(10,2)"):
        rows = df.select("t", cast_number("t", t).alias("a"), parse_number("t", t, aliases=False).alias("b")).collect()
        assert all(r.a == r.b for r in rows), [r for r in rows if r.a != r.b][:3]
