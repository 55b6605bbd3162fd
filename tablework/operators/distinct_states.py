"""Stored, mergeable exact distincts (#39).

The distinct values of whole-number-like columns (whole numbers, dates, timestamps,
booleans, decimals of up to 18 digits) are kept as bits: a value is a place on the
number line, 64 neighbouring places make a word, and a state row is one word of
one column of one part: ``(part, column, word, bits)``. Words of any parts merge by
OR, so the distincts of a year come from the states of its days without their data,
which plain counts cannot do.

All columns of a table are taken in one aggregate of fixed-width keys and values: a
hash aggregate that combines before the shuffle, so a value held by a third of the
rows is one bit there. Dense values (keys, dates) shuffle up to 64 times fewer rows
than a distinct per value, sparse ones as many. The words of a column are spread
over tasks by hash; none of them is gathered.

Defined cases: NULL is missing; negative values have words of their own; an empty
table, or a part without present values, has no states, and its count is 0 only
where ``distinct_counts`` is told its name; other types raise ``TypeError`` (use
``stats.count_distinct``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def place(c: Column, kind: T.DataType) -> Column:
    """The value as a whole number of 64 bits; different values, different numbers."""
    if isinstance(kind, _WHOLE):
        return c.cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        # by its fields, so that no time zone has a say
        seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c)
        return (F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000
                + (seconds * 1_000_000).cast("bigint"))
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (c.cast("decimal(38,18)") * F.lit(10 ** kind.scale)).cast("bigint")
    raise TypeError(f"no exact distinct states for {kind.simpleString()}")


def supported(kind: T.DataType) -> bool:
    """Whether ``place`` knows the type."""
    return isinstance(kind, (*_WHOLE, T.DateType, T.TimestampType, T.TimestampNTZType)) or (
        isinstance(kind, T.DecimalType) and kind.precision <= 18)


def distinct_states(df: DataFrame, columns: Sequence[str], by: Column | str | None = None) -> DataFrame:
    """``(part, column, word, bits)`` of the columns; ``part`` is the text of ``by``
    (one part, "all", without it). One scan, one shuffle of words."""
    part = (F.lit("all") if by is None else _q(by) if isinstance(by, str) else by).cast("string").alias("part")
    places = F.array(*[F.struct(F.lit(i).alias("nth"), place(_q(c), df.schema[c].dataType).alias("at"))
                       for i, c in enumerate(columns)])
    each = df.select(part, F.explode(places).alias("p")).select("part", "p.nth", "p.at").where("at IS NOT NULL")
    words = (each.select("part", "nth", F.shiftright("at", 6).alias("word"),
                         F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"))
             .groupBy("part", "nth", "word").agg(F.bit_or("bit").alias("bits")))
    return words.select("part", F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("nth") + 1).alias("column"),
                        "word", "bits")


def merge_distinct(states: DataFrame, part: Column | None = None) -> DataFrame:
    """States of unions of parts: of all of them, or of those with equal ``part`` (a
    column over the states, e.g. the year of a day)."""
    to = (F.lit("all") if part is None else part).cast("string").alias("part")
    return states.select(to, "column", "word", "bits").groupBy("part", "column", "word").agg(
        F.bit_or("bits").alias("bits"))


def distinct_counts(states: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``(part, column, n_distinct)``, exact, of states in which a word of a part
    stands once (``distinct_states``, ``merge_distinct``). ``parts``: rows
    ``(part, column)`` that are to have a count, 0 included."""
    found = states.groupBy("part", "column").agg(F.sum(F.bit_count("bits")).alias("n_distinct"))
    if parts is None:
        return found
    # a row per asked-for part and column beside the found ones; the larger count is the part's
    asked = parts.select("part", "column", F.lit(0).cast("bigint").alias("n_distinct"))
    return (found.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
            .groupBy("part", "column").agg(F.max("n_distinct").alias("n_distinct"), F.max("asked").alias("asked"))
            .where("asked").drop("asked"))


def count_of(column: str) -> Column:
    """The distinct values of one column as an aggregate over the states of one
    part; 0 where it has none."""
    return F.coalesce(F.sum(F.when(F.col("column") == column, F.bit_count("bits"))), F.lit(0)).cast("bigint")
