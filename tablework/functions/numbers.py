"""Numeric parsing of text columns.

Spark's cast of text to double accepts Java literal suffixes (``'6D'`` and
``'6F'`` are 6.0), which class codes look exactly like, and NaN/Infinity
words. The guards below keep only plain decimal / scientific notation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablework.functions.text import col_of, strip_ws

NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER_TEXT = r"^[+-]?[0-9]+$"

_INF = float("inf")


def finite(c: Column) -> Column:
    """NULL for NaN and ±infinity, value otherwise."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(_INF)), F.lit(None)).otherwise(c)


def parse_double(c: Column | str) -> Column:
    """Text → double; anything but plain decimal/scientific text → NULL."""
    s = strip_ws(col_of(c))
    return F.when(s.rlike(NUMERIC_TEXT), finite(s.try_cast("double")))


def parse_bigint(c: Column | str) -> Column:
    """Text → bigint, fraction truncated toward zero.

    Plain integers go straight to bigint so values above 2**53 stay exact;
    other numeric text goes through double. Overflow and bad text → NULL.
    """
    s = strip_ws(col_of(c))
    # one regex; the integer shape by cheap scans. Text the regex accepts is
    # never NaN, and try_cast to bigint turns an overflowed ±inf into NULL,
    # so each value is cast at most twice and the guard runs once.
    plain = ~(s.contains(".") | s.contains("e") | s.contains("E"))
    return F.when(s.rlike(NUMERIC_TEXT),
                  F.when(plain, s.try_cast("bigint"))
                  .otherwise(s.try_cast("double").try_cast("bigint")))


# Declared dtype names (pandas style and Spark style) → Spark type.
DTYPE_ALIASES = {
    "int": "bigint", "int64": "bigint", "long": "bigint", "bigint": "bigint",
    "int32": "int", "integer": "int",
    "float": "double", "float64": "double", "double": "double", "number": "double",
    "float32": "float",
    "object": "string", "str": "string", "string": "string",
    "bool": "boolean", "boolean": "boolean",
    "datetime64": "timestamp", "datetime64[ns]": "timestamp", "datetime": "timestamp",
    "timestamp": "timestamp", "date": "date",
}

_INTEGRAL = ("bigint", "int", "smallint", "tinyint")


def spark_type(dtype: str) -> str:
    """Declared dtype name → Spark SQL type name (unknown names pass through)."""
    return DTYPE_ALIASES.get(dtype.strip().lower(), dtype.strip().lower())


def parse_number(c: Column | str, to: str = "double", aliases: bool = True) -> Column:
    """Parse numeric text into ``to``; integral targets truncate the fraction.
    ``to`` may be a pandas-style name (``int`` = 64-bit) unless ``aliases``
    is False, when it is a Spark type name as is."""
    t = spark_type(to) if aliases else to.strip().lower()
    if t == "bigint":
        return parse_bigint(c)
    if t in _INTEGRAL:
        return parse_bigint(c).try_cast(t)
    if t == "double":
        return parse_double(c)
    return parse_double(c).try_cast(t)


def _made_of(c: Column, signs: str) -> Column:
    return F.translate(c, signs, "") == ""


def cast_number(c: Column | str, t: str) -> Column:
    """``parse_number`` for columns that mostly are numbers, as a declared schema
    says: where a text holds digits, signs and points only, the cast alone decides
    and no pattern is run. Few expressions, so that many columns of a table fit one
    compiled loop. ``t``: a Spark type name."""
    c = col_of(c)
    s = strip_ws(c)
    if t in _INTEGRAL:
        whole = F.when(_made_of(c, "0123456789+-"), c.try_cast("bigint")).when(
            s.rlike(INTEGER_TEXT), s.try_cast("bigint")).when(
            s.rlike(NUMERIC_TEXT), s.try_cast("double").try_cast("bigint"))
        return whole if t == "bigint" else whole.try_cast(t)
    # digits and a point are never infinite below 309 of them
    short = _made_of(c, "0123456789+-.") & (F.length(c) < 300)
    real = F.when(short, c.try_cast("double")).when(s.rlike(NUMERIC_TEXT), finite(s.try_cast("double")))
    return real if t == "double" else real.try_cast(t)


def parse_currency(c: Column | str, to: str = "bigint") -> Column:
    """Money text such as ``$2,923,706,026`` → number (``$`` and ``,`` removed)."""
    return parse_number(F.translate(col_of(c), "$,", ""), to)


def nan_to_null(c: Column | str) -> Column:
    """NaN → NULL so that count / avg / corr skip it as pandas does."""
    c = col_of(c)
    return F.when(~F.isnan(c), c)
