"""Token ids in Parquet files (operator 11).

A corpus as token ids, one row a document, in ascending order of its id, in
Parquet list columns laid out for reading parts of them:

* ``ids`` (the tokens and the end id) is dictionary-encoded: a row group's
  dictionary holds each id once, places are bit-packed (16 bits or fewer) and
  compressed;
* ``doc_id``, ``n_tokens``, ``local_start`` and ``local_end`` (ids of its file
  part before the document, and with it) are delta-encoded;
* row groups have a size in bytes and pages a bound on their rows, and every
  column has a page index, so a reader with a range of documents or of token
  places decodes only the pages that hold it, and one of metadata reads no id.

Documents are dealt out by ranges of their id, so one task writes one part of
the order and a ``part`` number, part after part, orders the files. Where a
part begins in the whole sequence is read from the metadata columns alone
(``part_starts``: a row a file), so nothing is counted before it is written and
texts are shuffled once, as text.

Tokenising: ids are those of the ``tokenizers`` library. Text of characters
whose classes are settled (``_PLAIN``) is cut by the pre-tokenizer's pattern and
merged by the vocabulary's own merges in ``tiktoken``'s loop, which gives equal
ids in a third of the time (a property test holds the two together); any other
run of text goes through the library itself. A long text is tokenised in runs
that end where a piece ends.

Defined cases: a NULL or empty text is the end id alone; NULL ids come first,
as one document each; equal ids are ordered by the md5 of their text, repeated
rows stay; an empty table gives no rows; other columns of the input are not
read, so their names cannot clash.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.session import scratch_path

from .common import column, text_slices

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
RUN_CHARS = 1 << 16         # a longer text is tokenised in runs of about this length

# File layout: bytes of a row group, rows and bytes of a page.
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 500
PAGE_BYTES = 256 << 10

_STATE: dict = {}

# Printable ASCII, line ends and tabs, Latin letters and marks, general punctuation.
_PLAIN = re.compile(r"[\t\n\r -~\xa1-\xac\xae-ɏ‐-‧‰-⁞]*")
_RUN_END = re.compile(r"(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")
# The byte-level pre-tokenizer's pattern (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def _merge_loop(path: str):
    """``tiktoken``'s merge loop over the vocabulary of a byte-level BPE file, or
    None where the file is of another kind or its ids are not in merge order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    usual = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) \
        and not split.get("add_prefix_space") and spec["normalizer"] is None \
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                           "byte_fallback", "ignore_merges"))
    if not usual or made != sorted(set(made)) or made[:1] < [256]:
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]   # bytes shown as themselves
    shown = {chr(b): b for b in plain}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(shown[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    from tiktoken._tiktoken import CoreBPE
    return CoreBPE(ranks, {}, PIECES)


class TextIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.core = _merge_loop(path)

    def exact(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def run(self, text: str) -> bytes:
        if self.core is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.exact(text)
        return np.asarray(self.core.encode_ordinary(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if len(text) <= RUN_CHARS:
            return self.run(text)
        out, start = [], 0
        while start < len(text):
            end = _RUN_END.search(text, start + RUN_CHARS) if self.core is not None else None
            stop = end.start() if end else len(text)
            out.append(self.run(text[start:stop]))
            start = stop
        return b"".join(out)


def _text_ids(path: str) -> TextIds:
    if path not in _STATE:
        _STATE[path] = TextIds(path)
    return _STATE[path]


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in the order of the files: part, doc_id, n_tokens, local_start,
    local_end, ids."""
    md5 = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), md5.alias("__tie"))
    rows = rows.repartitionByRange(F.asc_nulls_first("doc_id"), "__tie") \
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "__tie") \
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = T.StructType([T.StructField("part", T.IntegerType()),
                           T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("n_tokens", T.LongType()), T.StructField("local_start", T.LongType()),
                           T.StructField("local_end", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _text_ids(tokenizer_path(tokenizer))
        end, at = struct.pack("<I", end_id), 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                raw = [tok.ids(t or "") + end for t in column(part, "text").to_pylist()]
                n = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
                ends = np.cumsum(n)
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [column(part, "part"), column(part, "doc_id"), pa.array(n), pa.array(at + ends - n),
                     pa.array(at + ends), ids],
                    names=schema.names)
                at += int(ends[-1])

    return rows.mapInArrow(run, schema)


def write_files(encoded: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES,
                page_rows: int = PAGE_ROWS, page_bytes: int = PAGE_BYTES) -> str:
    """Writes ``encode``'s rows in the layout above; returns ``path``."""
    options = {
        "parquet.writer.version": "PARQUET_2_0",                  # delta for what has no dictionary
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.enable.dictionary#part": "true",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "compression": "zstd",
    }
    encoded.write.options(**options).parquet(path)
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files. Select columns and filter: only those pages are read."""
    return spark.read.parquet(path)


def part_starts(files: DataFrame) -> DataFrame:
    """part, part_start: the ids before each part. From metadata columns; the
    window goes over one row a file."""
    sizes = files.groupBy("part").agg(F.max("local_end").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("part_start"))


def with_start(files: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Adds ``start``, the place of a document in the whole sequence. The parts
    number as many as the tasks that wrote, so they are broadcast."""
    starts = part_starts(files) if starts is None else starts
    return files.join(F.broadcast(starts), "part") \
        .withColumn("start", F.col("part_start") + F.col("local_start")).drop("part_start")


def read_tokens(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Documents that hold places ``first`` to ``last - 1`` of the sequence, with
    ``start`` and ``ids`` cut to the range. The parts are found from the
    metadata; inside them, the pages by the indexes of the local places."""
    files = read_files(spark, path)
    starts = part_starts(files).collect()                      # a row a file
    hit = [(r.part, r.part_start) for r, after in zip(
        sorted(starts, key=lambda r: r.part),
        [*sorted(s.part_start for s in starts)[1:], None])
        if r.part_start < last and (after is None or after > first)]
    if not hit:
        return with_start(files, part_starts(files)).where(F.lit(False))
    wanted = None
    for part, base in hit:
        here = (F.col("part") == part) & (F.col("local_start") < last - base) \
            & (F.col("local_end") > first - base)
        wanted = here if wanted is None else wanted | here
    rows = with_start(files.where(wanted),
                      spark.createDataFrame(hit, "part int, part_start long"))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0)).cast("int")
    keep = F.least(F.col("start") + F.col("n_tokens"), F.lit(last)) - F.col("start") - skip
    return rows.withColumn("ids", F.slice("ids", skip + 1, keep.cast("int"))) \
        .withColumn("start", F.col("start") + skip)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the files."""
    rows = with_start(read_files(spark, path)).select("doc_id", "start", "ids")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            off = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(off).astype(np.int64)),
                 pa.array(crc, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER,
                end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Documents to token files: the whole operator. Returns the folder, a new
    one in the shared folder if ``path`` is not given."""
    path = path or scratch_path(docs.sparkSession, "token_files")
    return write_files(encode(docs, tokenizer, end_id, id_col, text_col), path)
