"""Near-duplicate join on n-gram Jaccard similarity by MinHash banding (operator 10).

A document is the set of its five-word shingles (``common.ascii_words``
reading; a text of fewer words is one shingle of all of them). Documents whose
sets are equal are one *text*; all further work is on texts, each with its
number of documents, so copies are never expanded.

1. One pass hashes shingles, takes ``BANDS * ROWS`` minima and keeps the set's
   128-bit digest and one hash per band. ``bands_for`` chooses the numbers: at
   the threshold, a pair meets in a band with probability ``RECALL`` or more.
2. Texts are shuffled on their band hashes. A bucket is dealt into parts of a
   bounded size by a hash of the text, and parts meet in pairs, so no task sees
   a whole bucket. A pair of texts counts only in the first band it shares.
3. Only texts that have such a pair are fetched again and brought to the block
   of it as full shingle sets, where every pair is verified exactly. A block
   returns, per text, the number of documents it is linked to there and the
   smallest text it hangs together with: not its pairs.
4. Links are summed per text, and classes are the connected components of the
   hanging-together edges (large-star/small-star rounds, each written to the
   shared folder).

Result: one row per document with ``class_id`` (the smallest doc_id of the
class) and ``n_links`` (other documents of similarity ``THRESHOLD`` or more,
copies included).

Defined cases: a document without words (NULL, empty) is a class of its own
without links; rows that share doc_id and text count as copies of each other;
an empty table gives no rows; a class of NULL ids only has a NULL class_id;
further columns are kept by ``keep_one`` and not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, column, text_slices, whole_groups, with_row_key, written

THRESHOLD, WORDS, RECALL = 0.8, 5, 0.9999
PART_TEXTS = 256                 # texts in one part of a bucket
PART_SHINGLES = 400_000          # shingles in one part of a bucket, about
CACHE_WORDS = 100_000            # words a worker remembers: about 15 MB, kept while it lives

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans(UPPER, LOWER)
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 4) -> tuple[int, int]:
    """(bands, rows per band) so that 1 - (1 - t^rows)^bands >= recall."""
    bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))
    return bands, rows


BANDS, ROWS = bands_for()
_KEYS = np.random.default_rng(17).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _ROLL
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = _WORD.findall((text or "").translate(_LOW) if text and not text.isascii()
                          else (text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    h = _mixed(np.fromiter(map(_word_hash, words), np.uint64, len(words)))
    n = max(1, len(h) - size + 1)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, min(size, len(h))):
            out = out * _ROLL + h[k:k + n]
    return np.unique(_mixed(out))


class _WordHashes(dict):
    """Stable 64-bit hashes of words, kept for the commonest of a worker."""

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


_word_hash = _WordHashes().__getitem__


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash per set (row) and band; no set may be empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            acc = np.zeros(len(sets), np.uint64)
            for r in range(ROWS):
                key, mul = _KEYS[b * ROWS + r]
                acc = acc * _ROLL + _mixed(np.minimum.reduceat((flat ^ key) * mul, starts))
            out[:, b] = acc
    return out


SIGNATURE = [T.StructField("n_shingles", T.LongType()), T.StructField("text_id", T.BinaryType()),
             T.StructField("bands", T.ArrayType(T.LongType()))]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text key, shingle count, digest of the shingle set and band hashes."""
    keyed = with_row_key(docs, id_col, text_col).select(id_col, "__row_key", text_col)
    schema = T.StructType([keyed.schema[id_col], keyed.schema["__row_key"], *SIGNATURE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                sets = [shingles(t) for t in column(part, text_col).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                ids: list = [None] * len(sets)
                rows: list = [None] * len(sets)
                if full:
                    for i, b in zip(full, band_hashes([sets[i] for i in full]).view(np.int64)):
                        ids[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        rows[i] = b
                yield pa.RecordBatch.from_arrays(
                    [column(part, id_col), column(part, "__row_key"),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(rows, pa.list_(pa.int64()))], names=schema.names)

    return keyed.mapInArrow(run, schema)


# -- blocks: two parts of a bucket, or one with itself --------------------------

BLOCK = ["band", "hash", "a", "b"]


def _first_band_pairs(bands: np.ndarray, size: np.ndarray, side: np.ndarray, band: int, a: int, b: int
                      ) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a block whose first shared band is this one and whose set
    sizes allow the threshold. Within a part all pairs, between parts across."""
    left = np.flatnonzero(side == a)
    right = left if a == b else np.flatnonzero(side == b)
    ok = np.ones((len(left), len(right)), bool)
    for k in range(band):
        ok &= bands[left, k][:, None] != bands[right, k][None, :]
    s, t = size[left][:, None], size[right][None, :]
    ok &= np.minimum(s, t) >= THRESHOLD * np.maximum(s, t)
    if a == b:
        ok &= np.triu(np.ones_like(ok), 1)
    i, j = np.nonzero(ok)
    return left[i], right[j]


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each block that take part in a pair of it."""
    for batch, starts in whole_groups(batches, BLOCK):
        bands, size, side = _matrix(batch), _ints(batch, "n_shingles"), _ints(batch, "part")
        band, a, b = (_ints(batch, k)[starts[:-1]] for k in ("band", "a", "b"))
        keep = []
        for g, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
            i, j = _first_band_pairs(bands[lo:hi], size[lo:hi], side[lo:hi], band[g], a[g], b[g])
            if len(i):
                keep.append(lo + np.union1d(i, j))
        if keep:
            yield batch.take(pa.array(np.concatenate(keep)))


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``i`` with the sets ``j``."""
    rows = np.unique(np.concatenate([i, j]))
    place = np.zeros(rows.max() + 1, np.int64)
    place[rows] = np.arange(len(rows))
    sizes = np.array([len(sets[r]) for r in rows])
    _, word = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    if len(i) * 40 < len(rows) * (word.max() + 1) // 64:       # few pairs: one by one
        cut = np.split(word, np.cumsum(sizes)[:-1])
        return np.array([len(np.intersect1d(cut[place[x]], cut[place[y]], assume_unique=True))
                         for x, y in zip(i, j)], np.int64)
    total = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    for lo in range(0, int(word[-1]) + 1, 4096):               # a strip of the vocabulary
        p, q = np.searchsorted(word, (lo, lo + 4096))
        strip = np.zeros((len(rows), 4096), np.float32)
        strip[owner[p:q], word[p:q] - lo] = 1
        total += strip @ strip.T
    return total[place[i], place[j]].astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text of a block: documents linked to it and its smallest companion."""
    for batch, starts in whole_groups(batches, BLOCK):
        bands, size, side = _matrix(batch), _ints(batch, "n_shingles"), _ints(batch, "part")
        docs, bytes_ = _ints(batch, "n_docs"), batch.column("shingles")
        band, a, b = (_ints(batch, k)[starts[:-1]] for k in ("band", "a", "b"))
        text, root, links = [], [], []
        for g, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
            i, j = _first_band_pairs(bands[lo:hi], size[lo:hi], side[lo:hi], band[g], a[g], b[g])
            if not len(i):
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in bytes_[lo:hi]]
            n = size[lo:hi]
            both = overlaps(sets, i, j)
            linked = both >= THRESHOLD * (n[i] + n[j] - both) - 1e-9
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            d = docs[lo:hi]
            count = np.bincount(i, d[j], hi - lo) + np.bincount(j, d[i], hi - lo)
            at = np.flatnonzero(count)
            text.append(lo + at)
            root.append(lo + _roots(hi - lo, i, j)[at])
            links.append(count[at].astype(np.int64))
        if text:
            ids = batch.column("text_id")
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.concatenate(text))), ids.take(pa.array(np.concatenate(root))),
                 pa.array(np.concatenate(links))], names=["text_id", "root", "links"])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` items hangs together with."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text_id, shingles) of the wanted texts, hashed anew from one document each."""
    keyed = with_row_key(docs, id_col, text_col).select("__row_key", F.col(text_col).alias("__text"))
    rows = keyed.join(wanted, "__row_key").dropDuplicates(["__row_key"])
    schema = T.StructType([T.StructField("text_id", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text"):
                sets = [shingles(t).tobytes() for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("text_id"), pa.array(sets, pa.binary())],
                                                 names=schema.names)

    return rows.select("text_id", "__text").mapInArrow(run, schema)


def linked_texts(docs: DataFrame, signed: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, blocks): texts with their number of documents, and what the
    blocks found: text_id, root, links. Both are written tables."""
    texts = signed.where("text_id IS NOT NULL").groupBy("text_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.any_value("n_shingles").alias("n_shingles"),
        F.min(id_col).alias("doc"), F.min("__row_key").alias("__row_key"),
        F.any_value("bands").alias("bands"))
    texts = written(texts, "texts")
    spread = texts.select("text_id", "n_shingles", F.posexplode("bands").alias("band", "hash"))
    spread = spread.withColumn("band", F.col("band").cast("tinyint"))
    buckets = spread.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n"),
                                                 F.sum("n_shingles").alias("s")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / PART_TEXTS), F.ceil(F.col("s") / PART_SHINGLES)).cast("int")
    buckets = buckets.select("band", "hash", parts.alias("parts"))
    met = spread.drop("n_shingles").join(buckets, ["band", "hash"])
    members = met.join(texts.select("text_id", "n_docs", "n_shingles", "__row_key", "bands"), "text_id")
    members = members.withColumn("part", F.pmod(F.xxhash64("text_id"), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other"))
    members = members.select(*BLOCK, "part", "text_id", "n_docs", "n_shingles", "__row_key", "bands")
    needed = written(members.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
                     .mapInArrow(_needed, members.schema), "needed")
    sets = _shingle_sets(docs, needed.select("text_id", "__row_key").distinct(), id_col, text_col)
    full = needed.drop("__row_key").join(sets, "text_id")
    blocks = full.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "text_id").mapInArrow(
        _verify, "text_id binary, root binary, links long")
    return texts, written(blocks, "blocks")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) of the connected components of ``edges`` (u, v); the root is
    the smallest node. Large-star and small-star rounds until nothing changes."""
    edges = written(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, __row_key, root (NULL without words), class_id,
    n_links."""
    signed = written(signatures(docs, id_col, text_col), "signatures")
    texts, blocks = linked_texts(docs, signed, id_col, text_col)
    links = blocks.groupBy("text_id").agg(F.sum("links").alias("links"))
    roots = components(blocks.select(F.col("text_id").alias("u"), F.col("root").alias("v")))
    classed = texts.select("text_id", "n_docs", "doc") \
        .join(roots.withColumnRenamed("node", "text_id"), "text_id", "left") \
        .join(links, "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))
    smallest = classed.groupBy("root").agg(F.min("doc").alias("class_id"))
    classed = classed.join(smallest, "root").select(
        "text_id", "root", "class_id",
        (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    rows = signed.select(id_col, "__row_key", "text_id").join(classed, "text_id", "left")
    alone = F.col("text_id").isNull()
    return rows.select(id_col, "__row_key", "root",
                       F.when(alone, F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"),
                       F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class (its smallest id, of equal ids the smallest row
    key, of repeated rows one), and every document without words."""
    found = near_duplicates(docs, id_col, text_col)
    alone = found.where("root IS NULL").select("__row_key", F.lit(True).alias("__alone")).distinct()
    first = found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(
        F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("__row_key").alias("k"))).alias("m"))
    kept = alone.unionByName(first.select(F.col("m.k").alias("__row_key"), F.lit(False).alias("__alone")))
    rows = with_row_key(docs, id_col, text_col).join(kept, "__row_key")
    rows = rows.withColumn("__n", F.row_number().over(
        Window.partitionBy("__row_key").orderBy("__row_key")))
    return rows.where("__alone OR __n = 1").select(*docs.columns)
