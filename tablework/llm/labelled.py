"""Bounded, balanced samples of labelled documents for training on the driver.

The bound is on rows: ``per_class`` documents of either label, those with the
smallest hash of their id, so a sample does not depend on partitioning. What
is drawn from a document (features of it, or its text) is the caller's
``extract``; it reads whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def id_remainder(mod: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod`` (NULL ids: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(mod))


def sample_ids(labels: DataFrame, label: str, per_class: int, keep: Column | None = None,
               id_col: str = "doc_id") -> DataFrame:
    """Ids and 0/1 labels of the sample, two ``per_class`` rows at most.

    Rows without an id or with a label other than 0 and 1 are left out, and so
    are ids that are marked both ways.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
    if keep is not None:
        rows = rows.where(keep)
    one = rows.groupBy(id_col).agg(F.min(label).cast("int").alias("__y"), F.max(label).alias("__z"))
    one = one.where(F.col("__y") == F.col("__z")).select(id_col, "__y")
    parts = [one.where(F.col("__y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
             for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def collect_sample(docs: DataFrame, ids: DataFrame, extract: Callable, fields: list[T.StructField],
                   id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """Runs ``extract`` (a ``mapInArrow`` function over id, text and ``__y``) on
    the sampled documents and brings its rows to the driver, in the order of
    id, label and checksum: (label, one buffer for each binary field).

    ``ids`` has a proven bound (``sample_ids``), so it is broadcast and the
    texts are not shuffled. Rows arrive as Arrow batches and the buffers are
    views into them, so the sample is held once.
    """
    drawn = docs.select(id_col, text_col).join(F.broadcast(ids), id_col)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("__y", T.IntegerType()), *fields])
    rows = []
    for batch in drawn.select(id_col, "__y", text_col).mapInArrow(extract, schema).toArrow().to_batches():
        cells = [[v.as_buffer() for v in batch.column(k)] for k in range(2, batch.num_columns)]
        rows += [((i, y, zlib.crc32(b[0])), y, *b) for i, y, *b in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), *cells)]
    rows.sort(key=lambda r: r[0])
    return [r[1:] for r in rows]
