"""Fill-in-middle transformation (operator 13).

A text of n tokens (``[A-Za-z]+|[^A-Za-z]``, left to right over code points) is
cut after two token numbers drawn from the hash of its id, and written as
prefix, suffix and middle (``psm``), as suffix, prefix and middle (``spm``), or
left as it is (``plain``).

The places where tokens end are held in a boundary set of the Roaring kind:
code-point offsets are split by their upper bits into chunks of 65,536; the
lower 16 bits of a chunk lie in an array (few boundaries), a bitmap (many) or a
list of runs (neighbours), whichever is smallest, and cumulative cardinalities
say how many boundaries lie before each chunk. ``select(k)`` finds the k-th
boundary: a binary search over the cardinalities, then a select inside one
container. Both cut offsets come from it. A long text costs 8 KiB a chunk at
most besides its own code points.

Row by row, no shuffle. Defined cases: a NULL or empty text has no tokens and
is plain, with an empty output; a NULL id is hashed as empty text; repeated
rows are transformed alike; a text that holds one of the marks is plain, so
that every other output can be read back; an empty table gives no rows;
further columns are kept, and replaced where their name is an output's.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, add_fields, column, text_slices

# Marks, and shares of the forms in percent (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT = 90, 20
SALT = "1:"

CHUNK_BITS = 16
ARRAY, BITMAP, RUN = "array", "bitmap", "run"


class Container:
    """The boundaries of one chunk (sorted 16-bit numbers), in its smallest form."""

    def __init__(self, low: np.ndarray):
        breaks = np.flatnonzero(np.diff(low) != 1) + 1
        firsts = np.concatenate(([0], breaks))
        sizes = {RUN: 4 * len(firsts), ARRAY: 2 * len(low), BITMAP: 1 << (CHUNK_BITS - 3)}
        self.kind = min(sizes, key=sizes.get)
        if self.kind == RUN:
            self.starts = low[firsts].astype(np.uint16)
            self.before = firsts.astype(np.int32)           # members before each run
        elif self.kind == ARRAY:
            self.values = low.astype(np.uint16)
        else:
            bits = np.zeros(1 << CHUNK_BITS, np.uint8)
            bits[low] = 1
            self.words = np.packbits(bits, bitorder="little").view("<u8")
            counts = np.bitwise_count(self.words).astype(np.int32)
            self.before = np.cumsum(counts) - counts        # members before each word

    def select(self, j: int) -> int:
        """The j-th member (from 0)."""
        if self.kind == ARRAY:
            return int(self.values[j])
        i = int(np.searchsorted(self.before, j, side="right")) - 1
        left = j - int(self.before[i])
        if self.kind == RUN:
            return int(self.starts[i]) + left
        word = int(self.words[i])
        for _ in range(left):
            word &= word - 1                                # drops the lowest member
        return 64 * i + (word & -word).bit_length() - 1


class BoundarySet:
    """Sorted offsets in chunks, with cumulative cardinalities."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> CHUNK_BITS
        cuts = np.flatnonzero(np.diff(high)) + 1
        parts = np.split(offsets, cuts) if len(offsets) else []
        self.high = [int(p[0]) >> CHUNK_BITS for p in parts]
        self.containers = [Container(p & ((1 << CHUNK_BITS) - 1)) for p in parts]
        self.cumulative = np.cumsum([len(p) for p in parts])

    def __len__(self) -> int:
        return int(self.cumulative[-1]) if self.containers else 0

    def select(self, k: int) -> int:
        """The k-th offset (from 0)."""
        c = int(np.searchsorted(self.cumulative, k, side="right"))
        j = k - (int(self.cumulative[c - 1]) if c else 0)
        return (self.high[c] << CHUNK_BITS) | self.containers[c].select(j)


def token_ends(text: str) -> np.ndarray:
    """Code-point offsets behind each token of ``text``."""
    if text.isascii():
        points = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((points | 32) - 97) < 26 if points.dtype == np.uint8 else \
        (points < 123) & (((points | 32) - np.uint32(97)) < 26)
    ends = np.ones(len(points), bool)
    ends[:-1] = ~(letter[:-1] & letter[1:])
    return np.flatnonzero(ends) + 1


def cut_offsets(text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """(number of tokens, code points of the prefix, of prefix and middle)."""
    tokens = BoundarySet(token_ends(text))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, tokens.select(a - 1) if a else 0, tokens.select(b - 1) if b else 0


def form_of(text: str, h3: int, h4: int) -> str:
    if not text or h3 % 100 >= FIM_PERCENT or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain"
    return "spm" if h4 % 100 < SPM_PERCENT else "psm"


def write_form(text: str, form: str, a: int, b: int) -> str:
    if form == "psm":
        return f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
    if form == "spm":
        return f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return text


OUTPUT = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
          T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
          T.StructField("output", T.StringType())]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              salt: str = SALT) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and the written ``output``.
    ``salt`` goes before the id in the hash that draws cuts and form."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    drawn = docs.withColumn("__draw", F.unhex(F.substring(F.sha2(F.concat(F.lit(salt), ident), 256), 1, 32)))
    schema = add_fields(docs.schema, OUTPUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                rows = []
                for text, draw in zip(column(part, text_col).to_pylist(),
                                      column(part, "__draw").to_pylist()):
                    text = text or ""
                    h1, h2, h3, h4 = struct.unpack(">4I", draw)
                    n, a, b = cut_offsets(text, h1, h2)
                    form = form_of(text, h3, h4)
                    fim = form != "plain"
                    rows.append((n, form, a if fim else None, b - a if fim else None,
                                 write_form(text, form, a, b)))
                cols = list(zip(*rows))
                part = part.drop_columns(["__draw"])
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
                got = {f.name: pa.array(list(c), k) for f, c, k in zip(OUTPUT, cols, kinds)}
                yield add_columns(part, got).select(schema.names)

    return drawn.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The exact text, from a written output and its form.

    The text holds no mark, and no mark can begin inside another, so the first
    place of each mark is the written one.
    """
    body = F.split(F.substring(output, 4, 2147483647),
                   f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(body, F.lit(i)) for i in range(3))
    return F.when(form == "psm", F.concat(first, middle, second)) \
        .when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digest(transformed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Checksums of the outputs and of the texts restored from them."""
    return transformed.select(
        id_col, "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('{SALT}' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), t AS (
  SELECT *, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') AS tok,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), c AS (
  SELECT *, len(tok) AS n, least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS a,
    greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS b,
    CASE WHEN x = '' OR contains(x, '{PREFIX}') OR contains(x, '{SUFFIX}') OR contains(x, '{MIDDLE}')
              OR h3 % 100 >= {FIM_PERCENT} THEN 'plain'
         WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM t
), p AS (
  SELECT doc_id, x, n, form, array_to_string(tok[1:a], '') AS pre, array_to_string(tok[a+1:b], '') AS mid,
    array_to_string(tok[b+1:n], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
    WHEN 'spm' THEN '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid ELSE x END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM p
"""
