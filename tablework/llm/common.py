"""Shared helpers: reading inputs, written intermediate tables, Arrow text.

Text helpers work on one Arrow batch at a time and cut it into slices of a
bounded number of bytes, so the numpy work space of a task does not grow
with the number of rows in a batch. A single document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.session import scratch_path, ship_package

SLICE_BYTES = 1 << 20

# Words of the licence, decontamination and near-duplicate operators: what
# lies between these separators, after A-Z are lowered (fixed values).
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage: what was computed survives the loss of an executor and
    is not computed twice by the branches that use it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_words(text) -> F.Column:
    """Array of the words of a text column (NULL and empty: no words).

    Only A-Z are lowered. ``lower`` is right for pure ASCII, which is told
    by equal character and byte counts; other texts are translated.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, WORD_SEPARATORS), "")


def add_fields(schema: T.StructType, fields: list[T.StructField]) -> T.StructType:
    """``schema`` with ``fields`` at the end; a field of an equal name (in
    any letter case) is replaced."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + fields)


def add_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The Arrow side of ``add_fields``."""
    new = {c.lower() for c in columns}
    old = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n.lower() not in new]
    names, arrays = zip(*(old + list(columns.items())))
    return pa.RecordBatch.from_arrays(list(arrays), names=list(names))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A batch column by name, in any letter case."""
    for i, n in enumerate(batch.schema.names):
        if n.lower() == name.lower():
            return batch.column(i)
    raise KeyError(name)


def text_slices(batch: pa.RecordBatch, text_col: str,
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``max_bytes`` of text, one row at least."""
    if not batch.num_rows:
        return
    col = column(batch, text_col)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, rows one after another, and the
    ``len + 1`` row offsets. NULL is an empty row."""
    col = pa.compute.fill_null(col, "").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def with_row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 name: str = "__row_key") -> DataFrame:
    """Adds a 128-bit key of id and text; equal keys are exact repeats. NULLs are
    told apart from empty fields, and the id's length says where the text begins."""
    empty = F.lit("")
    ident, text = (F.coalesce(F.col(c).cast("string"), empty) for c in (id_col, text_col))
    null = F.concat(F.col(id_col).isNull().cast("string"), F.col(text_col).isNull().cast("string"))
    return docs.withColumn(name, F.unhex(F.md5(F.concat_ws(
        "/", null, F.length(ident).cast("string"), ident, text))))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]
                 ) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """From a partition sorted by ``keys`` (integer columns): batches of whole
    groups, each with the starts of its groups and its number of rows."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        one = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return one, np.append(np.flatnonzero(changes(one)), one.num_rows)

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return new

    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(np.flatnonzero(changes(batch))[-1])
        fresh = bool(held) and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys)
        if held and (fresh or last):
            yield joined(held if fresh and not last else held + [batch.slice(0, last)])
            held = []
        elif last:
            yield joined([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield joined(held)
