"""Quality classifier: a byte-level convolutional network in numpy (operator 7).

A document's UTF-8 bytes are read by learned filters of ``WIDTH`` bytes. The
first layer is a table of one weight per filter, offset and byte value, so a
filter's response at a place is a sum of ``WIDTH`` table rows. Responses are
rectified and max-pooled over chunks of ``CHUNK`` bytes that overlap by
``CHUNK - STRIDE``; the chunks cover the whole document, the last one its end.
The document's vector is the mean over its chunks and the maximum over its
chunks of the pooled responses, with two measures of its length (a short text
cannot wake many filters), and a logistic layer makes it one probability.

Training takes place on the driver on a bounded number of rows: ``PER_CLASS``
labelled documents of either class, all chunks of each, some documents cut
short at random so that short texts are learned too. Scoring reads every byte
of every document. The work space is bounded by blocks of ``BLOCK`` bytes, in
training of ``BLOCK_CHUNKS`` chunks.

Defined cases: a NULL or empty text is one chunk of padding and gets that
chunk's score; repeated rows get equal scores; no labelled rows, or rows of one
class only, give an untrained model that scores 0.5 everywhere and rejects
nothing; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .common import add_columns, add_fields, column, text_bytes, text_slices
from .labelled import collect_sample, sample_ids

FILTERS, WIDTH = 16, 6
CHUNK, STRIDE = 512, 448
BLOCK = 1 << 14
PER_CLASS, EPOCHS = 1000, 8
BATCH_DOCS, BLOCK_CHUNKS = 64, 128
GOOD = 0.7                      # predicted = 1 from this score on
REJECT_BELOW = 0.5              # the pipeline's verdict
INPUTS = 2 * FILTERS + 2


@dataclass
class ByteCnn:
    table: np.ndarray           # (WIDTH, 256, FILTERS) float32
    bias: np.ndarray            # (FILTERS,)
    mean: np.ndarray            # (INPUTS,), centre and scale of the document vector
    scale: np.ndarray
    weights: np.ndarray
    intercept: float
    trained: bool = True


def untrained() -> ByteCnn:
    z = np.zeros(INPUTS, np.float32)
    return ByteCnn(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32),
                   z, z + 1, z, 0.0, False)


def _responses(raw: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter responses at every place with ``WIDTH`` bytes from it on."""
    n = len(raw) - WIDTH + 1
    out = np.take(table[0], raw[:n], axis=0)
    row = np.empty_like(out)
    for o in range(1, WIDTH):
        np.take(table[o], raw[o:o + n], axis=0, out=row)
        out += row
    out += bias
    return np.maximum(out, 0, out=out)


def _chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks of a text of ``n`` bytes; the last ends with it."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - CHUNK + STRIDE, STRIDE, dtype=np.int64)
    return np.minimum(starts, n - CHUNK)


def _length_inputs(n: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum(n, CHUNK) / CHUNK, np.minimum(n, 64) / 64], axis=1).astype(np.float32)


def document_vectors(raw: np.ndarray, offsets: np.ndarray, model: ByteCnn) -> np.ndarray:
    """Mean and maximum over chunks of the pooled responses, for every row."""
    out = np.zeros((len(offsets) - 1, INPUTS), np.float32)
    out[:, 2 * FILTERS:] = _length_inputs(np.diff(offsets))
    grain = 64                                            # CHUNK and STRIDE are multiples of it
    for i in range(len(out)):
        doc = raw[offsets[i]:offsets[i + 1]]
        if len(doc) < CHUNK:
            doc = np.concatenate([doc, np.full(CHUNK - len(doc), 32, np.uint8)])
        places = len(doc) - WIDTH + 1
        grains = []
        for s in range(0, places, BLOCK):
            r = _responses(doc[s:min(s + BLOCK, places) + WIDTH - 1], model.table, model.bias)
            grains.append(np.maximum.reduceat(r, np.arange(0, len(r), grain), axis=0))
        grains = np.concatenate(grains)
        starts = _chunk_starts(len(doc))
        if len(starts) == 1:
            pooled = grains.max(axis=0, keepdims=True)
        else:
            lo = starts // grain
            hi = np.minimum(len(grains), -(-(starts + CHUNK - WIDTH + 1) // grain))
            pooled = np.stack([grains[a:b].max(axis=0) for a, b in zip(lo, hi)])
            if starts[-1] % grain:                        # the last chunk begins inside a grain
                pooled[-1] = _responses(doc[-CHUNK:], model.table, model.bias).max(axis=0)
        out[i, :FILTERS], out[i, FILTERS:2 * FILTERS] = pooled.mean(axis=0), pooled.max(axis=0)
    return out


def predict(raw: np.ndarray, offsets: np.ndarray, model: ByteCnn) -> np.ndarray:
    if not model.trained:
        return np.full(len(offsets) - 1, 0.5)
    v = (document_vectors(raw, offsets, model) - model.mean) / model.scale
    z = (v @ model.weights + model.intercept).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# -- training -----------------------------------------------------------------

def _draw(id_col: str, text_col: str):
    """The bytes of a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.compute.fill_null(column(batch, text_col), "").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, id_col), column(batch, "__y"), texts],
                                             names=[id_col, "__y", "raw"])
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None,
        id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> ByteCnn:
    """A model from the labelled rows that ``keep`` (a condition on ``labels``) allows."""
    ids = sample_ids(labels, label, PER_CLASS, keep, id_col)
    rows = collect_sample(docs, ids, _draw(id_col, text_col), [T.StructField("raw", T.BinaryType())],
                          id_col, text_col)
    y = np.array([r[0] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return untrained()
    size = np.array([len(r[1]) for r in rows])
    held = np.maximum(size, CHUNK)                        # short texts are padded with blanks
    base = np.cumsum(held) - held
    raw = np.full(held.sum(), 32, np.uint8)
    for at, r in zip(base, rows):
        raw[at:at + len(r[1])] = np.frombuffer(r[1], np.uint8)
    del rows
    starts = [_chunk_starts(int(n)) for n in held]
    owner = np.repeat(np.arange(len(y)), [len(s) for s in starts])
    return _train(raw, np.concatenate(starts) + base[owner], owner, size, y, seed)


def _train(raw: np.ndarray, chunk: np.ndarray, owner: np.ndarray, size: np.ndarray, y: np.ndarray,
           seed: int) -> ByteCnn:
    """``raw``: all texts; ``chunk`` and ``owner``: where each chunk starts and
    whose it is; ``size``: bytes of each text."""
    rng = np.random.default_rng(seed)
    p = {"t": (rng.normal(0, 0.35, (WIDTH, 256, FILTERS))).astype(np.float32),
         "b": np.zeros(FILTERS, np.float32),
         "w": rng.normal(0, 0.2, INPUTS).astype(np.float32),
         "c": np.zeros(1, np.float32)}
    first = np.searchsorted(owner, np.arange(len(y)))
    count = np.bincount(owner, minlength=len(y))
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    norm = [np.zeros(INPUTS, np.float32), np.ones(INPUTS, np.float32)]

    def read(starts: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """The chunks' bytes, blank behind ``upto`` of them."""
        x = raw[starts[:, None] + np.arange(CHUNK)]
        x[np.arange(CHUNK) >= upto[:, None]] = 32
        return x

    def highest(starts: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled responses of the chunks and their places, block by block."""
        pooled = np.empty((len(starts), FILTERS), np.float32)
        arg = np.empty((len(starts), FILTERS), np.int64)
        pad = np.zeros((WIDTH - 1, FILTERS), np.float32)
        for s in range(0, len(starts), BLOCK_CHUNKS):
            x = read(starts[s:s + BLOCK_CHUNKS], upto[s:s + BLOCK_CHUNKS])
            resp = np.concatenate([_responses(x.reshape(-1), p["t"], p["b"]), pad])
            resp = resp.reshape(len(x), CHUNK, FILTERS)[:, :CHUNK - WIDTH + 1]
            best = resp.argmax(axis=1)
            arg[s:s + len(x)] = best
            pooled[s:s + len(x)] = np.take_along_axis(resp, best[:, None], 1)[:, 0]
        return pooled, arg

    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH_DOCS):
            docs = order[at:at + BATCH_DOCS]
            n, k = size[docs].copy(), count[docs].copy()
            cut = rng.random(len(docs)) < 0.3              # these are read as short texts
            n[cut] = np.minimum(n[cut], np.exp(rng.uniform(1.5, np.log(CHUNK), cut.sum())).astype(int))
            k[cut] = 1
            rows = np.concatenate([np.arange(first[d], first[d] + m) for d, m in zip(docs, k)])
            mine = np.repeat(np.arange(len(docs)), k)
            where, upto = chunk[rows], np.where(cut, n, CHUNK)[mine]
            pooled, arg = highest(where, upto)             # (chunks, filters)
            k = k.astype(np.float32)
            starts = np.searchsorted(mine, np.arange(len(docs)))
            mean = np.add.reduceat(pooled, starts) / k[:, None]
            top = np.maximum.reduceat(pooled, starts)
            v = np.concatenate([mean, top, _length_inputs(n)], axis=1)
            if not step:
                norm = [v.mean(axis=0), v.std(axis=0) + 0.05]
            z = ((v - norm[0]) / norm[1]) @ p["w"] + p["c"]
            dz = (1 / (1 + np.exp(-z)) - y[docs]) * weight[docs] / len(docs)
            dv = dz[:, None] * p["w"] / norm[1]
            dpool = dv[mine, :FILTERS] / k[mine, None]
            dpool = dpool + dv[mine, FILTERS:2 * FILTERS] * (pooled == top[mine])
            dpool = (dpool * (pooled > 0)).astype(np.float32)
            g = {"w": ((v - norm[0]) / norm[1]).T @ dz + 1e-4 * p["w"],
                 "c": np.array([dz.sum()], np.float32), "b": dpool.sum(axis=0),
                 "t": np.zeros_like(p["t"])}
            filt = np.broadcast_to(np.arange(FILTERS), arg.shape)
            for o in range(WIDTH):
                byte = raw[where[:, None] + arg + o]
                byte[arg + o >= upto[:, None]] = 32
                np.add.at(g["t"][o], (byte, filt), dpool)
            step += 1
            rate = 0.01 * (0.5 if epoch >= EPOCHS // 2 else 1) * (0.4 if epoch >= EPOCHS - 3 else 1)
            for name, grad in g.items():
                m, s = state[name]
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                p[name] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-7)
    model = ByteCnn(p["t"].astype(np.float32), p["b"], norm[0], norm[1], p["w"], float(p["c"][0]))
    return model


# -- scoring --------------------------------------------------------------------

def score(docs: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text",
          keep_columns: bool = True) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: better) and ``predicted`` (1 from ``GOOD`` on).
    Without ``keep_columns``, only the id and these come back."""
    base = docs if keep_columns else docs.select(id_col, text_col)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    drop = [] if keep_columns else [text_col]
    schema = add_fields(T.StructType([f for f in base.schema.fields if f.name not in drop]), fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                p = predict(*text_bytes(column(part, text_col)), model)
                if drop:
                    part = part.select([n for n in part.schema.names if n not in drop])
                yield add_columns(part, {"score": pa.array(p, pa.float64()),
                                         "predicted": pa.array((p >= GOOD).astype(np.int32))})

    return base.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: ByteCnn, reject_below: float = REJECT_BELOW,
              text_col: str = "text") -> DataFrame:
    """The rows whose score is ``reject_below`` or more, with their own columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                p = predict(*text_bytes(column(part, text_col)), model)
                yield part.filter(pa.array(p >= reject_below))

    return docs.mapInArrow(run, docs.schema)
