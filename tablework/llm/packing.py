"""Best-fit packing of tokenised documents (operator 8).

Large-item matching: pieces above a third of the capacity are paired, two a
bin at most, by greedy matching (the largest with the largest partner that
still fits beside it); smaller pieces then best-fit the gaps, longest first,
and open new bins only where no gap is wide enough.

The plan needs only how many pieces there are of each length. That histogram
has at most ``capacity`` rows whatever the corpus holds, so the driver packs
length classes in runs ("these 9,000 pieces of 700 tokens go behind those
bins of 1,300") and never sees a document. Pieces find their place by their
rank within their length, which is counted in salted groups: a length that a
third of all pieces share is ranked by many tasks.

Defined cases: a NULL or empty text is the end id alone (one piece of length
1); repeated rows are packed as often as they occur; an empty table gives no
rows; further columns of the input are not read, so their names cannot clash.
Ties between equal pieces are broken by doc_id, piece and checksum.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, text_slices, written

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
CACHE_WORDS = 100_000       # words a worker remembers: about 15 MB, kept while it lives
SEGMENT_CHARS = 1 << 20     # a longer text is tokenised in runs of whole words

_STATE: dict = {}

# Text that takes the short way: ASCII without quotes and "<" (contractions
# and special tokens begin there), and the Latin letters of one code unit.
_ODD = re.compile(r"[^\t-\r !-&(-;=-~\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_CHUNKS = re.compile(r"[\t-\r ]*[^\t-\r ]+")
_MARKS = re.compile(r"[!-&(-/:;=-@\[-`{-~]+|[0-9]")
_NOT_ONLY_STOPS = re.compile(r"[!-&(-+\-/-;=-@\[-`{-~]|[.,]{2}")
WORD_END = b"\xff"         # stands for the end-of-word mark; never a byte of UTF-8


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def _merge_table(path: str):
    """The vocabulary's merges as byte ranks for the merge loop of ``tiktoken``,
    or None where ids are not in merge order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], model["merges"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>":
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    order = [vocab[a + b] for a, b in pairs]
    if order != sorted(set(order)) or order[0] < 512:
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]   # bytes shown as themselves
    shown = {chr(b): b for b in plain}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    made, ranks = {a + b for a, b in pairs}, {}
    for piece, i in vocab.items():
        body = piece.removesuffix("</w>")
        if piece in made or len(body) == 1:
            ranks[bytes(shown[c] for c in body) + WORD_END * (body != piece)] = i
    from tiktoken._tiktoken import CoreBPE
    return CoreBPE(ranks, {}, r"\S+")


class KnownWords(dict):
    """Ids of words, worked out when first asked for. Holds ``CACHE_WORDS``
    words at most; rarer ones that come later are worked out each time."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, word: str) -> bytes:
        ids = self.merge.encode_single_piece(word.encode() + WORD_END)
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids


class TextIds:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    White space ends every token of this tokenizer, so a text's ids are those
    of its runs of words, one after another. Runs of plain text (see ``_ODD``)
    are split the tokenizer's way (letters, single digits, runs of marks) and
    each word merged on its bytes with an end mark; a chunk with any other
    character goes through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        merge = _merge_table(path)
        self.known = KnownWords(merge) if merge else None

    def exact(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        text = text.lower()
        if _NOT_ONLY_STOPS.search(text):
            text = _MARKS.sub(r" \g<0> ", text)
        else:
            text = text.replace(".", " . ").replace(",", " , ")
        return b"".join(map(self.known.__getitem__, text.split()))

    def runs(self, text: str) -> Iterator[bytes]:
        start = 0
        while start < len(text):
            stop = min(len(text), start + SEGMENT_CHARS)
            while stop < len(text) and text[stop] not in "\t\n\x0b\x0c\r ":
                stop += 1
            run, start = text[start:stop], stop
            if self.known is None:
                yield self.exact(run)
            elif not _ODD.search(run):
                yield self.plain(run)
            else:
                for odd, chunks in groupby(_CHUNKS.findall(run), lambda c: bool(_ODD.search(c))):
                    yield self.exact("".join(chunks)) if odd else self.plain("".join(chunks))

    def ids(self, text: str) -> bytes:
        return b"".join(self.runs(text))


def _text_ids(path: str) -> TextIds:
    if path not in _STATE:
        _STATE[path] = TextIds(path)
    return _STATE[path]


PIECE_FIELDS = [
    T.StructField("piece", T.IntegerType(), False),
    T.StructField("start", T.LongType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("ids_crc32", T.LongType(), False),
]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER,
                 end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per piece: the document id, piece, start, length, ids_crc32 and,
    with ``with_ids``, the token ids themselves. Only documents longer than
    ``capacity`` are cut. ``tokenizer`` is a file path or the name of a public
    vocabulary, looked up on the executor."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *PIECE_FIELDS]
                          + ([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _text_ids(tokenizer_path(tokenizer))
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for part in text_slices(batch, text_col):
                take, out, ids = [], [], []
                for i, text in enumerate(column(part, text_col).to_pylist()):
                    raw = tok.ids(text or "") + end
                    n = len(raw) // 4
                    for p, start in enumerate(range(0, n, capacity)):
                        cut = raw[4 * start:4 * (start + capacity)]
                        take.append(i)
                        out.append((p, start, len(cut) // 4, zlib.crc32(cut)))
                        if with_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int64))
                cols = [column(part, id_col).take(pa.array(take, pa.int64()))]
                cols += [pa.array([o[k] for o in out], pa.int32() if k == 0 else pa.int64())
                         for k in range(4)]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Where the pieces of each length go, from the number of each length.

    A row says: of the pieces of ``length``, those ranked ``rank`` to ``rank +
    n - 1`` go ``per_bin`` to a bin, into the bins from ``bin`` on, at
    ``offset`` and behind one another.
    """
    left = {n: int(c) for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)   # gap -> runs (first bin, bins)
    bins = 0

    def place(length: int, n: int, first: int, offset: int, per_bin: int) -> None:
        rows.append((length, used[length], n, first, offset, per_bin))
        used[length] += n
        left[length] -= n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in large:                       # the longest partner that fits
            if not left[a]:
                break
            if b > a or a + b > capacity or not left[b]:
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if not n:
                continue
            place(a, n, bins, 0, 1)
            place(b, n, bins, a, 1)
            gaps[capacity - a - b].append((bins, n))
            bins += n
        if left[a]:
            n = left[a]
            place(a, n, bins, 0, 1)
            gaps[capacity - a].append((bins, n))
            bins += n
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            gap = min((g for g, runs in gaps.items() if g >= a and runs), default=None)
            if gap is None:                   # as many new bins as the rest needs
                n = -(-left[a] // (capacity // a))
                gap, (first, n) = capacity, (bins, n)
                bins += n
            else:
                first, n = gaps[gap].pop()
            per_bin = gap // a
            full = min(n, left[a] // per_bin)
            if full:
                place(a, full * per_bin, first, capacity - gap, per_bin)
                gaps[gap - per_bin * a].append((first, full))
                first, n = first + full, n - full
            if n and left[a]:                 # fewer left than one bin takes
                k = left[a]
                place(a, k, first, capacity - gap, per_bin)
                gaps[gap - k * a].append((first, 1))
                first, n = first + 1, n - 1
            if n:
                gaps[gap].append((first, n))
    plan = pd.DataFrame(rows, columns=["length", "rank", "n", "bin", "offset", "per_bin"])
    return plan.sort_values(["length", "rank"], ignore_index=True)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (see ``token_pieces``).

    ``pieces`` is used twice (histogram, places), so hand in a written table.
    """
    spark = pieces.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    plan = pack_plan(counts, capacity)
    key = plan["length"].to_numpy(np.int64) << 40 | plan["rank"].to_numpy(np.int64)
    cols = {c: plan[c].to_numpy(np.int64) for c in plan.columns}

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(key, n << 40 | r, side="right") - 1
        j, per_bin = r - cols["rank"][i], cols["per_bin"][i]
        return pd.DataFrame({"sequence_id": cols["bin"][i] + j // per_bin,
                             "offset": cols["offset"][i] + j % per_bin * n})

    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = before.select("length", "__salt", (F.sum("__n").over(
        Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__salt")
                               .orderBy(id_col, "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("__rank", rank).join(before, ["length", "__salt"])
    placed = ranked.withColumn("__at", place("length", F.col("__rank") + F.col("__before")))
    return placed.select(*pieces.columns, "__at.sequence_id", "__at.offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER,
         end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Documents to placed pieces: the whole operator."""
    pieces = token_pieces(docs, capacity, tokenizer, end_id, with_ids, id_col, text_col)
    return pack_pieces(written(pieces, "pieces"), capacity, id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed sequences as token ids (``pack(..., with_ids=True)``): one row per
    sequence, at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
