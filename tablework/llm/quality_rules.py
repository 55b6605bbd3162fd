"""Quality rules: hashed n-gram logistic regression over fixed thresholds (operator 1).

Base measures of a text, over words (runs of anything but ASCII white space):
``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``.
A text fails the base rules with fewer than ``MIN_WORDS`` words, or when more
than ``MAX_REPEAT`` percent of its words lie in a five-word window that the
text holds twice. Of the others the model decides: relative frequencies of
hashed word 1- and 2-grams and character 3- and 4-grams, weighted by a logistic
regression and calibrated (Platt) on rows that the weights were not fitted to.

Fitting takes ``PER_CLASS`` labelled rows of either class (a documented bound),
each as a whole text and once more as a short passage of it, so that short
texts are judged by what short texts look like; every document is scored on its whole text, in slices of Arrow
batches. Repeated windows are found by 64-bit hashes and counted on the words
themselves.

Defined cases: a NULL or empty text has no words and fails the base rules;
repeated rows get equal verdicts; with no labelled rows, or one class only, the
model says 0.5 and only the base rules act; input columns named like an output
column are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .common import add_columns, add_fields, column, text_bytes, text_slices
from .labelled import collect_sample, sample_ids

MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
KEEP_FROM = 0.5                  # calibrated probability from which a text is kept
BITS = 16                        # hashed n-grams per family: 2 ** BITS
CHAR_ORDERS = (3, 4)
FAMILIES = 2 + len(CHAR_ORDERS)
SCALE = 30.0
PER_CLASS, ROUNDS = 2000, 70
BLOCK_GRAMS = 1 << 19            # features of a training block
WORK_BYTES = 1 << 17             # text judged at once: the arrays take about 60 bytes for each of it

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Weights:
    w: np.ndarray                # (FAMILIES << BITS,) float32
    intercept: float
    a: float                     # calibration: probability = sigmoid(a * z + b)
    b: float
    trained: bool = True


def untrained() -> Weights:
    return Weights(np.zeros(FAMILIES << BITS, np.float32), 0.0, 0.0, 0.0, False)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every word of the slice, in order."""
    n = len(raw)
    solid = np.empty(n + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[raw], out=solid[1:-1])
    edge = solid[1:] != solid[:-1]                        # edge[i]: between byte i-1 and i
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    both = inner[solid[inner] & solid[inner + 1]]         # a word ends and one begins here
    starts = np.flatnonzero(edge & np.append(solid[1:-1], False))
    ends = np.flatnonzero(edge & ~np.append(solid[1:-1], False))
    if len(both):
        starts = np.union1d(starts, both)
        ends = np.union1d(ends, both)
    with np.errstate(over="ignore"):
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[:n], out=total[1:])
        length = ends - starts
        hashes = total[ends] - total[starts]
        back = np.full(n + 1, _INVERSE, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        hashes = _mix(hashes * back[starts] + length.astype(np.uint64))
    return hashes, np.searchsorted(off, starts, side="right") - 1


def _windows(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words of one row."""
    n = max(0, len(h) - size + 1)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, size):
            out = out * _BASE + h[k:k + n]
        out = _mix(out)
    whole = row[:n] == row[size - 1:size - 1 + n]
    return out[whole], row[:n][whole]


def repeated_window_words(text: str, size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words that the text holds twice or
    more, each counted once."""
    words = _WORD.findall(text)
    windows = list(zip(*(words[k:] for k in range(size))))
    seen = Counter(windows)
    total = end = 0
    for k, window in enumerate(windows):
        if seen[window] > 1:
            total += k + size - max(k, end)
            end = k + size
    return total


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def base_measures(texts: pa.Array, raw: np.ndarray, off: np.ndarray, h: np.ndarray,
                  row: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(off) - 1
    n_words = np.bincount(row, minlength=rows)

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[off[1:]] - c[off[:-1]]

    chars = total(~_SPACE[raw] & ((raw & 0xC0) != 0x80))
    symbols = total(_SYMBOL[raw])
    breaks = total(raw == 10)
    win, where = _windows(h, row, WINDOW)
    with np.errstate(over="ignore"):
        key = np.sort(win ^ (where.astype(np.uint64) * _BASE))
        again = np.unique(key[1:][key[1:] == key[:-1]])
        twice = np.isin(win ^ (where.astype(np.uint64) * _BASE), again) if len(again) else None
    repeat, lines = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in np.unique(where[twice]) if twice is not None else ():
        repeat[i] = repeated_window_words(texts[int(i)].as_py())
    for i in np.flatnonzero(breaks):
        lines[i] = duplicate_lines(texts[int(i)].as_py())
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT * n_words)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines,
            "n_repeat_words": repeat, "base_failed": failed}


def code_points(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slice as code points, and the row offsets among them."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    if len(points) == len(raw):
        return points, off
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return points, before[off]


def _grams(raw: np.ndarray, off: np.ndarray, h: np.ndarray, row: np.ndarray
           ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every n-gram, family by family."""
    shift = np.uint64(64 - BITS)
    for size in (1, 2):
        win, where = _windows(h, row, size)
        yield (win >> shift).astype(np.int32), where
    wide, off = code_points(raw, off)
    at = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for size in CHAR_ORDERS:
        n = max(0, len(wide) - size + 1)
        code = np.zeros(n, np.uint32)
        for k in range(size):
            code = code * np.uint32(0x01000193) + wide[k:k + n]
        code *= np.uint32(0x9E3779B1)
        whole = at[:n] == at[size - 1:size - 1 + n]
        yield (code[whole] >> np.uint32(32 - BITS)).astype(np.int32), at[:n][whole]


def probabilities(raw: np.ndarray, off: np.ndarray, h: np.ndarray, row: np.ndarray,
                  model: Weights) -> np.ndarray:
    rows = len(off) - 1
    if not model.trained:
        return np.full(rows, 0.5)
    z = np.full(rows, model.intercept)
    for f, (bucket, where) in enumerate(_grams(raw, off, h, row)):
        part = model.w[f << BITS:(f + 1) << BITS]
        count = np.bincount(where, minlength=rows)
        z += SCALE * np.bincount(where, part[bucket], minlength=rows) / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(model.a * z + model.b, -30, 30)))


# -- training -----------------------------------------------------------------

def pack_grams(draw: str) -> bytes:
    """A text's n-gram counts: per family the number of buckets and of n-grams,
    then all buckets (16 bits), counts (8 bits), and the counts that need more
    (place and count)."""
    raw, off = text_bytes(pa.array([draw]))
    found = [np.unique(bucket, return_counts=True) for bucket, _ in _grams(raw, off, *word_hashes(raw, off))]
    count = np.concatenate([c for _, c in found])
    over = np.flatnonzero(count > 255)
    return b"".join((
        np.array([len(over)] + [n for b, c in found for n in (len(b), c.sum())], "<u4").tobytes(),
        np.concatenate([b for b, _ in found]).astype("<u2").tobytes(),
        np.minimum(count, 255).astype("u1").tobytes(),
        over.astype("<u4").tobytes(), count[over].astype("<u4").tobytes()))


def unpack_grams(cell) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers over all families and relative frequencies of a cell."""
    over, *sizes = np.frombuffer(cell, "<u4", 1 + 2 * FAMILIES).tolist()
    buckets, totals = sizes[::2], sizes[1::2]
    n, at = sum(buckets), 4 * (1 + 2 * FAMILIES)
    idx = np.frombuffer(cell, "<u2", n, at).astype(np.int32)
    idx += np.repeat(np.arange(FAMILIES, dtype=np.int32) << BITS, buckets)
    val = np.frombuffer(cell, "u1", n, at + 2 * n).astype(np.float32)
    at += 3 * n
    val[np.frombuffer(cell, "<u4", over, at)] = np.frombuffer(cell, "<u4", over, at + 4 * over)
    return idx, val / np.repeat(np.maximum(totals, 1).astype(np.float32), buckets)


def _draw(id_col: str, text_col: str):
    """The n-gram counts of a whole text and of a passage of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, out = [], []
            texts = pa.compute.fill_null(column(batch, text_col), "")
            for i, text in enumerate(texts.to_pylist()):
                words = text.split(" ")
                size = 8 + zlib.crc32(text.encode()) % 60
                start = max(0, len(words) - size) // 2
                take.append(i)
                out.append((pack_grams(text), pack_grams(" ".join(words[start:start + size]))))
            take = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column(batch, id_col).take(take), column(batch, "__y").take(take),
                 pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())],
                names=[id_col, "__y", "whole", "passage"])
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None,
        id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Weights and calibration from the labelled rows that ``keep`` allows."""
    ids = sample_ids(labels, label, PER_CLASS, keep, id_col)
    rows = collect_sample(docs, ids, _draw(id_col, text_col),
                          [T.StructField("whole", T.BinaryType()), T.StructField("passage", T.BinaryType())],
                          id_col, text_col)
    y = np.array([r[0] for r in rows for _ in range(2)], np.float64)
    if len(set(y.tolist())) < 2:
        return untrained()
    return _train([cell for r in rows for cell in r[1:]], y)


def _train(cells: list, y: np.ndarray) -> Weights:
    fit_rows = np.arange(len(y)) // 2 % 5 != 0            # every fifth document calibrates
    if min(len(set(y[fit_rows])), len(set(y[~fit_rows]))) < 2:
        fit_rows[:] = True

    def blocks(rows: np.ndarray) -> list[tuple]:
        """Documents in runs of about ``BLOCK_GRAMS`` features: first and last
        document, buckets, values, and the document of each."""
        out, run, size = [], [], 0
        for k in rows:
            run.append(unpack_grams(cells[k]))
            size += len(run[-1][0])
            if size >= BLOCK_GRAMS or k == rows[-1]:
                at = out[-1][1] if out else 0
                out.append((at, at + len(run), np.concatenate([i for i, _ in run]),
                            np.concatenate([v for _, v in run]) * np.float32(SCALE),
                            np.repeat(np.arange(len(run), dtype=np.int32), [len(i) for i, _ in run])))
                run, size = [], 0
        return out

    def scores(parts: list[tuple]) -> np.ndarray:
        w32 = w.astype(np.float32)
        return c + np.concatenate([np.bincount(r, w32[i] * v, minlength=to - at)
                                   for at, to, i, v, r in parts])

    def weight(t: np.ndarray) -> np.ndarray:
        return np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean())) / len(t)

    a_rows = np.flatnonzero(fit_rows)
    parts = blocks(a_rows)
    t, size = y[a_rows], FAMILIES << BITS
    w, m, s = (np.zeros(size) for _ in range(3))
    c, mc, sc = 0.0, 0.0, 0.0
    wt = weight(t)
    for step in range(1, ROUNDS + 1):
        d = (1 / (1 + np.exp(-np.clip(scores(parts), -30, 30))) - t) * wt
        g = 1e-7 * w
        for at, to, i, v, r in parts:
            g += np.bincount(i, d[at:to].astype(np.float32)[r] * v, minlength=size)
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)
        mc += 0.1 * (d.sum() - mc)
        sc += 0.01 * (d.sum() ** 2 - sc)
        c -= 0.1 * (mc / (1 - 0.9 ** step)) / (np.sqrt(sc / (1 - 0.99 ** step)) + 1e-6)
    if not fit_rows.all():
        del parts
        b_rows = np.flatnonzero(~fit_rows)
        parts = blocks(b_rows)
    else:
        b_rows = a_rows
    a, b = _platt(scores(parts), y[b_rows])
    return Weights(w.astype(np.float32), float(c), a, b)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make sigmoid(a * z + b) a probability (Newton steps,
    with targets drawn in by the usual prior so that separable rows stay finite)."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-6, z.std())
    x = np.stack([z / scale, np.ones_like(z)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (p - t) + 1e-3 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, g)
        beta -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return float(beta[0] / scale), float(beta[1])


# -- scoring --------------------------------------------------------------------

OUTPUT = [
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()), T.StructField("probability", T.DoubleType()),
]


def _judge(part: pa.RecordBatch, text_col: str, model: Weights) -> dict[str, np.ndarray]:
    raw, off = text_bytes(column(part, text_col))
    h, row = word_hashes(raw, off)
    out = base_measures(column(part, text_col), raw, off, h, row)
    p = probabilities(raw, off, h, row, model)
    return out | {"kept": ~out["base_failed"] & (p >= KEEP_FROM), "probability": p}


def apply_rules(docs: DataFrame, model: Weights, id_col: str = "doc_id", text_col: str = "text",
                keep_columns: bool = True) -> DataFrame:
    """Adds the base measures, ``base_failed``, ``kept`` and ``probability``."""
    base = docs if keep_columns else docs.select(id_col, text_col)
    drop = [] if keep_columns else [text_col]
    schema = add_fields(T.StructType([f for f in base.schema.fields if f.name not in drop]), OUTPUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col, WORK_BYTES):
                got = _judge(part, text_col, model)
                if drop:
                    part = part.select([n for n in part.schema.names if n not in drop])
                yield add_columns(part, {f.name: pa.array(got[f.name]) for f in OUTPUT})

    return base.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Weights, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col, WORK_BYTES):
                yield part.filter(pa.array(_judge(part, text_col, model)["kept"]))

    return docs.mapInArrow(run, docs.schema)
