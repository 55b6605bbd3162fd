"""The date formats of a text column, told from the data (#34).

Every value is read as a *template*: its digits, letters and separators by
position ("99/99/9999", "9999-99-99T99:99"). One aggregate per template keeps the
rows and, for each run of digits, its least and greatest number; that is all a
format needs. What a field can be is then settled by elimination, template by
template:

* four digits are a year, eight in front are ``yyyyMMdd`` if month and day can be;
* fields joined by ``:`` are the time, from hours down, a fraction behind them;
* a month's name is the month;
* of the fields left, one with a number above 31 is the year of two digits (or no
  date at all), one above 12 is no month, and a day is at most 31.

Where several orders of day and month survive, the format is *ambiguous* and all
are reported, the usual one first: behind a year of four digits month before day,
else day before month before year.

Defined cases: missing and blank values count nowhere; a template that no date
fits has a NULL format; upper and lower case of names are told apart by the
format only where Spark's parser does; whether a day exists in its month is not
looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions.text import strip_ws

# English month names, as date formats know them (fixed values).
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]
FIELDS = 8                       # runs of digits that are looked at; a date and time has 7
LONGEST = 40                     # characters of a value that can be a date

_NAMES = "|".join(MONTHS)
_SHORT = "|".join(m[:3] for m in MONTHS)
_TOKEN = re.compile(r"\{Month\}|\{Mon\}|\{AM\}|9+|[^9{]|\{")


def template_of(value: Column) -> Column:
    """Digits as 9, a month's name as {Month} or {Mon}, AM and PM as {AM}."""
    t = F.regexp_replace(value, "[0-9]", "9")
    t = F.regexp_replace(t, f"(?i)\\b({_NAMES})\\b", "{Month}")
    t = F.regexp_replace(t, f"(?i)\\b({_SHORT})\\b", "{Mon}")
    return F.regexp_replace(t, r"(?i)(?<![A-Za-z])(AM|PM)\b", "{AM}")


def templates(df: DataFrame, column: str) -> DataFrame:
    """``(template, n_rows, lows, highs, inner)``: least and greatest number of each
    field up to ``FIELDS``, and of the month and the day (``inner``: four numbers) in
    a first field of eight digits. Values too long for a date count under the
    template NULL."""
    c = strip_ws(F.col(f"`{column}`"))
    runs = F.regexp_extract_all(F.col("v"), F.lit("([0-9]+)"), F.lit(1))
    rows = df.select(c.alias("v")).where("v <> ''").select(
        F.when(F.length("v") <= LONGEST, template_of(F.col("v"))).alias("template"),
        F.when(F.length("v") <= LONGEST, runs).alias("runs"))
    number = [F.get("runs", F.lit(i)).try_cast("decimal(20,0)") for i in range(FIELDS)]
    month, day = F.floor(number[0] / 100) % 100, number[0] % 100
    return rows.groupBy("template").agg(
        F.count("*").alias("n_rows"),
        F.array(*[F.min(x).cast("double") for x in number]).alias("lows"),
        F.array(*[F.max(x).cast("double") for x in number]).alias("highs"),
        F.array(*[f(x).cast("double") for x in (month, day) for f in (F.min, F.max)]).alias("inner"))


def formats_of(template: str | None, lows: list, highs: list, inner: list) -> list[str]:
    """The formats that fit all values of a template, the usual one first."""
    if template is None:
        return []
    tokens = _TOKEN.findall(template)
    fields = [i for i, t in enumerate(tokens) if t[0] == "9"]
    if len(fields) > FIELDS or any(re.fullmatch(r"[A-Za-z{]", t) and t != "T" and t != "Z" for t in tokens):
        return []
    range_of = {f: (lows[k], highs[k]) for k, f in enumerate(fields)}
    out = [t if t in "TZ" or not t.isalpha() else "" for t in tokens]
    for i, t in enumerate(tokens):
        out[i] = {"{Month}": "MMMM", "{Mon}": "MMM", "{AM}": "a", "T": "'T'", "Z": "'Z'"}.get(t, t)
    half_days = "{AM}" in tokens

    def within(f: int, low: int, high: int) -> bool:
        return low <= range_of[f][0] and range_of[f][1] <= high

    # the time: fields joined by ":" and a fraction behind seconds
    clock = [f for k, f in enumerate(fields) if (k and tokens[f - 1] == ":" and tokens[f - 2][0] == "9")
             or (f + 2 < len(tokens) and tokens[f + 1] == ":" and tokens[f + 2][0] == "9")]
    if len(clock) > 3:
        return []
    hours = ((1, 12), "h") if half_days else ((0, 23), "H")
    for f, ((low, high), letter) in zip(clock, [hours, ((0, 59), "m"), ((0, 59), "s")]):
        if len(tokens[f]) > 2 or not within(f, low, high):
            return []
        out[f] = letter * len(tokens[f])
    if half_days and not clock:
        return []
    if len(clock) == 3:
        after = clock[-1] + 2
        if after < len(tokens) and tokens[after - 1] in ".," and tokens[after][0] == "9":
            out[after] = "S" * len(tokens[after])
            clock.append(after)
    rest = [f for f in fields if f not in clock]
    named = "{Month}" in tokens or "{Mon}" in tokens
    if tokens.count("{Month}") + tokens.count("{Mon}") > 1:
        return []
    if len(rest) == 1 and len(tokens[rest[0]]) == 8 and not named:
        dated = rest[0] == fields[0] and lows[0] >= 1_00_00 and 1 <= inner[0] and inner[1] <= 12 \
            and 1 <= inner[2] and inner[3] <= 31
        out[rest[0]] = "yyyyMMdd"
        return ["".join(out)] if dated else []
    if len(rest) != (2 if named else 3):
        return []

    def fits(f: int, part: str) -> str | None:
        n = len(tokens[f])
        if part == "y":
            return "y" * n if n in (2, 4) and (n == 2 or within(f, 1, 9999)) else None
        high = 12 if part == "M" else 31
        return ("d" if part == "d" else "M") * n if n <= 2 and within(f, 1, high) else None

    # year first or last; the usual order of each comes first
    orders = ["yd", "dy"] if named else ["yMd", "ydM", "dMy", "Mdy"]
    if all(len(tokens[f]) <= 2 for f in rest):
        orders = ["dy", "yd"] if named else ["dMy", "Mdy", "yMd", "ydM"]
    found = []
    for order in orders:
        letters = [fits(f, p) for f, p in zip(rest, order)]
        if None not in letters:
            text = list(out)
            for f, letter in zip(rest, letters):
                text[f] = letter
            found.append("".join(text))
    four = [f for f in found if "yyyy" in f]
    return four or found


def induce_date_formats(df: DataFrame, column: str) -> DataFrame:
    """``(template, format, n_rows, ambiguous, formats)``: a row per template, with
    the format to read it by and, if ambiguous, all that fit."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fits = [formats_of(t, list(a), list(b), list(c)) for t, a, b, c in zip(
                pdf["template"], pdf["lows"], pdf["highs"], pdf["inner"])]
            yield pd.DataFrame({"template": pdf["template"], "format": [f[0] if f else None for f in fits],
                                "n_rows": pdf["n_rows"], "ambiguous": [len(f) > 1 for f in fits], "formats": fits})

    return templates(df, column).mapInPandas(
        run, "template string, format string, n_rows long, ambiguous boolean, formats array<string>")


def parse_induced(df: DataFrame, column: str, induced: DataFrame, target: str = "timestamp_ntz") -> DataFrame:
    """``df`` with the column parsed, each value by its template's format (NULL
    where there is none). The formats come as a small table, a row per template
    that is a date; a template of 40 characters at most."""
    known = induced.where("format IS NOT NULL").select(F.col("template").alias("__t"), F.col("format").alias("__f"))
    c = strip_ws(F.col(f"`{column}`"))
    rows = df.withColumn("__t", template_of(c)).join(known, "__t", "left")
    parsed = F.expr(f"try_to_timestamp(`__v`, `__f`)").cast(target)
    return rows.withColumn("__v", c).withColumn(column, parsed).select(*df.columns)
