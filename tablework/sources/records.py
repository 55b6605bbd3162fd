"""Splittable reading of records that go over several lines (#1, #3).

A quoted CSV field may hold line breaks, and a JSON document may hold all its
records on one line or spread each over many. Whether a byte range begins
inside a record can only be told from all that stands before it. Here that is
worked out in parallel: ranges are read as *pieces* (CSV: lines; JSON: text up to
each ``}``), and a piece is a step of a small automaton, whatever state it is
entered in:

* CSV: outside or inside quotes at the beginning of a line, to outside or inside
  at its end (quotes open a field only at its beginning; doubled ones inside are
  text; a quote in the middle of an unquoted field is text, too);
* JSON: outside or inside a string, and by how much brackets change the depth.

Steps compose, and composing is associative. So every range is summed up on its
own (both entries, change of depth, least depth), a row a range; those rows are
combined file by file, in order, to the state that each range is entered in;
and a second pass over the ranges knows the record starts without reading from
the front. Records inside a range are put together there; of a record that
crosses ranges each one gives its fragment, joined afterwards by the range in
which the record began. Records are parsed by Spark's ``from_csv`` and
``from_json``.

All is lazy, and the input is read twice (the first time for the states). The
table of range states is broadcast: a row of about 100 bytes for a range of
``spark.sql.files.maxPartitionBytes`` (128 MB), a millionth of the input.

Defined cases: an empty file has no records; blank CSV lines are skipped, as
Spark's reader does; a file that ends inside quotes ends its last record there;
line ends may be ``\\n`` or ``\\r\\n``; a JSON document is an array of objects, one
object, or objects one after another; elements of an array that are no objects
belong to the record behind them and make it malformed (NULL fields); ``]`` and
white space behind the last record are dropped. Compressed files are one range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# States of a piece's entry and end.
OUTSIDE, INSIDE = 0, 1

_STEP = ["to0", "to1", "d0", "d1"]       # end state and change of depth, by entry state
_RANGE = ["__file", "__start"]
_NEVER = np.iinfo(np.int32).max


def _pieces(spark: SparkSession, path: str | Sequence[str], separator: str, **options) -> DataFrame:
    df = spark.read.option("lineSep", separator).options(**options).text(path)
    return df.select("value", F.col("_metadata.file_path").alias("__file"),
                     F.col("_metadata.file_block_start").alias("__start"))


# -- steps -----------------------------------------------------------------------------

def csv_steps(value: Column, sep: str = ",") -> list[Column]:
    """to0, to1, d0, d1 of a line.

    Walks the texts between quotes. 1: inside quotes; 2: a quote has just closed
    a field, or the line begins outside (a quote right here opens, or reopens a
    doubled one); 0: elsewhere in an unquoted field, where a quote is text unless
    a separator stands before it.
    """
    parts = F.split(value, '"', -1)
    before_quotes = F.slice(parts, 1, F.size(parts) - 1)

    def walk(entry: int) -> Column:
        end = F.aggregate(before_quotes, F.lit(entry), lambda s, t: F.when(s == 1, 2)
                          .when((s == 2) & (t == ""), 1).when(F.endswith(t, F.lit(sep)), 1).otherwise(0))
        return (end == 1).cast("tinyint")

    quoted = F.contains(value, F.lit('"'))
    flat = F.lit(0)
    return [F.when(quoted, walk(2)).otherwise(F.lit(0).cast("tinyint")).alias("to0"),
            F.when(quoted, walk(1)).otherwise(F.lit(1).cast("tinyint")).alias("to1"),
            flat.alias("d0"), flat.alias("d1")]


def json_steps(value: Column) -> list[Column]:
    """to0, to1, d0, d1 of a text and the ``}`` behind it. Escaped characters are
    taken out, then quotes part what is outside strings from what is inside."""
    parts = F.split(F.regexp_replace(value, r"(?s)\\.", ""), '"', -1)
    swaps = F.size(parts) % 2 == 0

    def depth(entry: int) -> Column:
        text = F.array_join(F.filter(parts, lambda x, i: i % 2 == F.lit(entry)), "")
        count = lambda signs: F.length(text) - F.length(F.translate(text, signs, ""))
        outside_at_end = swaps if entry == INSIDE else ~swaps
        return (count("{[") - count("]") - outside_at_end.cast("int")).cast("int")

    return [swaps.cast("tinyint").alias("to0"), (~swaps).cast("tinyint").alias("to1"),
            depth(OUTSIDE).alias("d0"), depth(INSIDE).alias("d1")]


def walk(to0: np.ndarray, to1: np.ndarray, d0: np.ndarray, d1: np.ndarray, state: int, depth: int
         ) -> tuple[np.ndarray, np.ndarray]:
    """State and depth behind each of a run of pieces. A piece keeps the state,
    swaps it, or ends in the same one from either: behind the last of the third
    kind only swaps count."""
    fixed, swaps = to0 == to1, np.cumsum((to0 == INSIDE) & (to1 == OUTSIDE))
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(to0)), -1))
    known = np.maximum(last, 0)
    after = np.where(last >= 0, to0[known] ^ ((swaps - swaps[known]) & 1), state ^ (swaps & 1))
    entry = np.concatenate(([state], after[:-1]))
    return after, depth + np.cumsum(np.where(entry == OUTSIDE, d0, d1))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Batches cut where the range changes, with the range."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start = batch.column("__start").to_numpy()
        file = batch.column("__file").dictionary_encode()
        code = file.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(start) != 0) | (np.diff(code) != 0)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
            yield (file.dictionary[int(code[a])].as_py(), int(start[a])), batch.slice(a, b - a)


def _steps(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _STEP]


# -- ranges ------------------------------------------------------------------------------

_SUMMARY = "__file string, __start long, to0 int, to1 int, d0 long, d1 long, low0 long, low1 long, opens string"


def range_steps(pieces: DataFrame) -> DataFrame:
    """A row a range: its step, the least depth (from 0) at a piece's end outside
    strings, for either entry, and the first sign of a range that begins a file."""
    first = F.when(F.col("__start") == 0, F.substring(F.ltrim(F.col("value"), F.lit("﻿ \t\r\n")), 1, 1))
    narrow = pieces.select(*_RANGE, *_STEP, first.alias("opens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, opens = None, None, None

        def row() -> pa.RecordBatch:
            (s0, e0, l0), (s1, e1, l1) = sums
            return pa.RecordBatch.from_pydict(dict(zip(
                ["__file", "__start", "to0", "to1", "d0", "d1", "low0", "low1", "opens"],
                [[now[0]], [now[1]], pa.array([s0], pa.int32()), pa.array([s1], pa.int32()), [e0], [e1], [l0], [l1],
                 pa.array([opens], pa.string())])))

        for key, part in _runs(batches):
            if key != now:
                if now is not None:
                    yield row()
                now, sums, opens = key, [(OUTSIDE, 0, _NEVER), (INSIDE, 0, _NEVER)], None
            signs = [] if opens or key[1] else [s for s in part.column("opens").to_pylist() if s]
            opens = opens or (signs[0] if signs else None)
            steps = _steps(part)
            for k, (state, depth, low) in enumerate(sums):
                after, depths = walk(*steps, state, depth)
                ends = depths[after == OUTSIDE]
                sums[k] = (int(after[-1]), int(depths[-1]), min(low, int(ends.min()) if len(ends) else _NEVER))
        if now is not None:
            yield row()

    return narrow.mapInArrow(run, _SUMMARY)


_STATES = "__file string, __start long, state int, depth long, base long, owner long"


def range_states(summaries: DataFrame) -> DataFrame:
    """How each range is entered: state, depth, the depth between records
    (``base``) and the range in which the record that is open began (NULL: none)."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__start", ignore_index=True)
        base = 1 if len(pdf) and pdf["opens"].iloc[0] == "[" else 0
        state, depth, owner, out = OUTSIDE, 0, None, []
        for r in pdf.itertuples(index=False):
            file, start, to, change, low, _ = r[0], r[1], r[2:4], r[4:6], r[6:8], r[8]
            out.append((file, start, state, depth, base, owner))
            ended = low[state] != _NEVER and depth + low[state] <= base
            state, depth = int(to[state]), depth + int(change[state])
            between = state == OUTSIDE and depth == base
            owner = None if between else start if ended or owner is None else owner
        return pd.DataFrame(out, columns=["__file", "__start", "state", "depth", "base", "owner"]) \
            .astype({"owner": "Int64"})

    return summaries.groupBy("__file").applyInPandas(combine, _STATES)


# -- records -----------------------------------------------------------------------------

_FRAGMENT = "__file string, __owner long, __start long, __first boolean, record string"


def _assemble(pieces: DataFrame, separator: str) -> DataFrame:
    """Records of single ranges (``__owner`` NULL) and fragments of others.
    ``__first``: the record begins its file."""
    tail = "" if separator == "\n" else separator            # a line end is no part of its record

    def join(texts: list) -> str:
        return separator.join(texts) + tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = depth = base = owner = None
        open_: list[str] = []                                # pieces of the record that is open
        first = False

        def rows(file: str, start: int, records: list) -> pa.RecordBatch:
            own, firsts, texts = zip(*records)
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * len(texts), pa.string()), pa.array(own, pa.int64()),
                 pa.array([start] * len(texts), pa.int64()), pa.array(firsts, pa.bool_()),
                 pa.array(texts, pa.string())], names=["__file", "__owner", "__start", "__first", "record"])

        def rest() -> Iterator[pa.RecordBatch]:
            if open_:
                yield rows(*now, [(now[1] if owner is None else owner, first, join(open_))])

        for key, part in _runs(batches):
            if key != now:
                yield from rest()
                now, open_ = key, []
                state, depth, base = (part.column(c)[0].as_py() for c in ("state", "depth", "base"))
                owner, first = part.column("owner")[0].as_py(), key[1] == 0
            after, depths = walk(*_steps(part), state, depth)
            state, depth = int(after[-1]), int(depths[-1])
            ends = np.flatnonzero((after == OUTSIDE) & (depths == base))
            texts, out, at = part.column("value").to_pylist(), [], 0
            for e in ends.tolist():
                text = join(open_ + texts[at:e + 1]) if open_ or e > at else texts[e] + tail
                out.append((owner, first, text))
                open_, at, owner, first = [], e + 1, None, False
            open_ += texts[at:]
            if out:
                yield rows(*now, out)
        yield from rest()

    return pieces.mapInArrow(run, _FRAGMENT)


def whole_records(spark: SparkSession, path: str | Sequence[str], kind: str, sep: str = ",",
                  **options) -> DataFrame:
    """(file, first, record): the records of CSV or JSON files as text, in no
    order; ``first`` marks the first of its file."""
    separator = "\n" if kind == "csv" else "}"
    raw = _pieces(spark, path, separator, **options)
    steps = csv_steps(F.col("value"), sep) if kind == "csv" else json_steps(F.col("value"))
    pieces = raw.select("*", *steps)
    states = range_states(range_steps(pieces))
    known = pieces.join(F.broadcast(states), _RANGE)          # the order of a scan's rows stays
    parts = _assemble(known, separator)
    crossing = parts.where("__owner IS NOT NULL").groupBy("__file", "__owner").agg(
        F.array_sort(F.collect_list(F.struct("__start", "record"))).alias("__p"), F.max("__first").alias("first"))
    glue = "\n" if kind == "csv" else ""
    crossing = crossing.select(F.col("__file").alias("file"), "first",
                               F.array_join(F.transform("__p", lambda p: p["record"]), glue).alias("record"))
    inside = parts.where("__owner IS NULL").select(F.col("__file").alias("file"),
                                                   F.col("__first").alias("first"), "record")
    return inside.unionByName(crossing)


def read_csv_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, sep: str,
                     header: bool, options: dict) -> DataFrame:
    """CSV files with line breaks inside quoted fields, split freely."""
    rows = whole_records(spark, path, "csv", sep)
    if header:
        rows = rows.where("NOT first")
    record = F.regexp_replace("record", r"\r\z", "")
    record = F.when(F.col("first"), F.ltrim(record, F.lit("﻿"))).otherwise(record)
    rows = rows.select(record.alias("record")).where(F.trim("record") != "")
    parsed = F.from_csv("record", _ddl(schema), {**options, "sep": sep, "multiLine": "true"})
    return rows.select(parsed.alias("r")).select("r.*")


def read_json_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                      options: dict) -> DataFrame:
    """JSON documents (an array of objects, or objects one after another), split
    freely."""
    record = F.ltrim(F.col("record"), F.lit("﻿ \t\r\n[],"))
    rows = whole_records(spark, path, "json").select(record.alias("record")).where(F.contains("record", F.lit("{")))
    return rows.select(F.from_json("record", schema, options).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    """A schema as text; names in back quotes."""
    return ", ".join(f"`{re.sub('`', '``', f.name)}` {f.dataType.simpleString()}" for f in schema.fields)
