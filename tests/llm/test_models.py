"""Quality rules, byte network and toxicity: exact measures, held-out accuracy, edges."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import base_quality
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablework.llm import byte_cnn, quality_rules, toxicity
from tablework.llm.common import text_bytes, text_slices
from tablework.llm.labelled import id_remainder

SF = "/root/testdata/sf0.01"
EDGES = [None, "", "  \n ", "a b\n\na b\n \nx", "né " * 30, "x", "w" * 200_000, "a\x0bb\x0cc\x1cd", "#*$ %&|<>"]


def auc(y, p):
    y, p = np.asarray(y), np.asarray(p)
    return np.mean([(p[y == 1][:, None] > p[y == 0]).mean(), (p[y == 1][:, None] >= p[y == 0]).mean()])


def _measures(texts):
    out = []
    for part in text_slices(pa.record_batch([pa.array(texts, pa.string())], names=["text"]), "text", 200):
        got = quality_rules._judge(part, "text", quality_rules.untrained())
        out += list(zip(*(got[k].tolist() for k in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))))
    return out


def test_base_measures_edges():
    assert _measures(EDGES) == [base_quality(t) for t in EDGES]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té#", max_size=60), min_size=1, max_size=5))
def test_base_measures_any_text(texts):
    assert _measures(texts) == [base_quality(t) for t in texts]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_rules_on_held_out(spark, tables, labelled):
    docs, labels = tables
    model = quality_rules.fit(docs, labels, keep=id_remainder(4) != 2)
    rows = {r.doc_id: r for r in quality_rules.apply_rules(docs, model, keep_columns=False).collect()}
    assert len(rows) == docs.count()
    for d, text, _, _ in labelled:
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == base_quality(text)
        assert r.kept <= (not r.base_failed)
    held = [(q, rows[d]) for d, _, q, _ in labelled if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([r.kept for q, r in held if q == 1 and not r.base_failed]) > 0.95
    assert auc([q for q, _ in held], [r.probability for _, r in held]) > 0.8


def test_byte_cnn_on_held_out(spark, tables, labelled):
    docs, labels = tables
    model = byte_cnn.fit(docs, labels, keep=id_remainder(4) != 2)
    rows = {r.doc_id: r for r in byte_cnn.score(docs, model, keep_columns=False).collect()}
    held = [(q, rows[d].score) for d, _, q, _ in labelled if zlib.crc32(str(d).encode()) % 4 == 2]
    assert auc(*zip(*held)) > 0.85
    assert all(r.predicted == (r.score >= 0.7) for r in rows.values())


def test_byte_cnn_reads_the_whole_text():
    rng = np.random.default_rng(0)
    model = byte_cnn.untrained()
    model.table = rng.normal(size=model.table.shape).astype(np.float32)
    for n in (0, 3, 511, 512, 513, 5000, 40_000):
        raw = rng.integers(0, 256, n, dtype=np.uint8)
        v = byte_cnn.document_vectors(raw, np.array([0, n]), model)[0]
        doc = np.concatenate([raw, np.full(max(0, byte_cnn.CHUNK - n), 32, np.uint8)])
        whole = byte_cnn._responses(doc, model.table, model.bias).max(axis=0)
        np.testing.assert_allclose(v[byte_cnn.FILTERS:2 * byte_cnn.FILTERS], whole, rtol=1e-5)


def test_toxicity_on_held_out(spark, tables, labelled):
    docs, labels = tables
    model = toxicity.fit(docs, labels, keep=id_remainder(3) != 1)
    rows = {r.doc_id: r for r in toxicity.score(docs, model, keep_columns=False).collect()}
    held = [(t, rows[d].score) for d, _, _, t in labelled if zlib.crc32(str(d).encode()) % 3 == 1]
    assert auc(*zip(*held)) > 0.75
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


@pytest.fixture(scope="module")
def channel():
    counts = np.zeros((toxicity._SIZE,) * 3)
    text = " you are a stupid idiot and a moron this is pathetic trash the scum clown loser disgusting worthless "
    c = toxicity._LUT[np.frombuffer((text * 20).encode("utf-32-le"), "<u4")]
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    p = (counts + 0.01) / (counts.sum(axis=2, keepdims=True) + 0.01 * toxicity._SIZE)
    return toxicity.Channel(-np.log(p), toxicity.lexicon_of({"worthless": 1.0, "loser": 1.0}))


@pytest.mark.parametrize("noisy, plain", [
    ("1d10t", "idiot"), ("s t u p i d", "stupid"), ("m.o.r.o.n", "moron"), ("stuuuupid", "stupid"),
    ("p@th3t1c", "pathetic"), ("$cum!", "scum"), ("l0s3r!!", "loser"), ("tr4sh.", "trash"), ("i-d-i-o-t", "idiot"),
    ("w0rthl3ss", "worthless"), ("c l o w n", "clown"), ("plain words, here.", "plain words here"), ("", "")])
def test_restoration(channel, noisy, plain):
    assert " ".join(channel.restore(noisy)) == plain


def test_corpus_counts_cover_all_documents(spark, tables):
    docs, _ = tables
    got = toxicity.corpus_trigrams(docs).agg(F.sum("n")).first()[0]
    chars = sum(len(r.text.lower()) for r in docs.select("text").collect() if r.text)
    assert abs(got - chars) < 0.01 * chars


@pytest.mark.parametrize("module, score, names", [
    (quality_rules, lambda d, m: quality_rules.apply_rules(d, m), ["kept", "probability"]),
    (byte_cnn, lambda d, m: byte_cnn.score(d, m), ["score", "predicted"]),
    (toxicity, lambda d, m: toxicity.score(d, m, with_text=True), ["score", "predicted", "restored"])])
def test_without_labels_and_with_clashing_names(spark, module, score, names):
    texts = [(i, t) for i, t in enumerate(EDGES)] + [(None, "x"), (1, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("Score", F.lit("clash")) \
        .withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(docs, labels)
    rows = score(docs, model)
    assert rows.count() == len(texts) and set(names) <= set(rows.columns)
    assert len({c.lower() for c in rows.columns}) == len(rows.columns)
    assert score(docs.limit(0), model).count() == 0


def test_untrained_models_reject_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, None)], "doc_id long, text string")
    assert byte_cnn.keep_good(docs, byte_cnn.untrained()).count() == 2
    assert [r.doc_id for r in quality_rules.keep_good(docs, quality_rules.untrained()).collect()] == [1]


def test_repeated_windows_are_exact():
    for text in ("a b c d e f a b c d e", "x " * 50, "one two", ""):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        starts = range(len(w) - 4)
        marked = {k + j for k in starts for m in starts if k != m and w[k:k + 5] == w[m:m + 5] for j in range(5)}
        assert quality_rules.repeated_window_words(text) == len(marked) == base_quality(text)[4]


def test_packed_grams_keep_all_counts():
    for text in ("", "é", "a b c " * 3000 + "Ünï 日本 🙂", "x" * 5000):
        raw, off = text_bytes(pa.array([text]))
        want = {}
        for f, (bucket, _) in enumerate(quality_rules._grams(raw, off, *quality_rules.word_hashes(raw, off))):
            for b, n in Counter(bucket.tolist()).items():
                want[b + (f << quality_rules.BITS)] = np.float32(n / len(bucket))
        idx, val = quality_rules.unpack_grams(quality_rules.pack_grams(text))
        assert idx.tolist() == sorted(want) and np.allclose(val, [want[i] for i in sorted(want)])


def test_character_grams_are_of_code_points():
    raw, off = text_bytes(pa.array(["aéb", "", "éé日", "xyz"]))
    points, at = quality_rules.code_points(raw, off)
    assert "".join(map(chr, points)) == "aébéé日xyz" and at.tolist() == [0, 3, 3, 6, 9]


def brute_network(text, m):
    """The score of a text, place by place and filter by filter."""
    raw = (text or "").encode()
    n, padded = len(raw), raw.ljust(byte_cnn.CHUNK)
    starts, at = [], 0
    while True:
        starts.append(min(at, len(padded) - byte_cnn.CHUNK))
        if starts[-1] == len(padded) - byte_cnn.CHUNK:
            break
        at += byte_cnn.STRIDE
    pools = []
    for s in starts:
        chunk = padded[s:s + byte_cnn.CHUNK]
        pools.append(np.max([np.maximum(0, m.bias + sum(m.table[o, chunk[i + o]] for o in range(byte_cnn.WIDTH)))
                             for i in range(len(chunk) - byte_cnn.WIDTH + 1)], axis=0))
    v = np.concatenate([np.mean(pools, axis=0), np.max(pools, axis=0),
                        [min(n, byte_cnn.CHUNK) / byte_cnn.CHUNK, min(n, 64) / 64]])
    z = float(((v - m.mean) / m.scale) @ m.weights + m.intercept)
    return 1 / (1 + np.exp(-z))


def test_network_scores_against_brute_force():
    rng = np.random.default_rng(3)
    f = byte_cnn.FILTERS
    m = byte_cnn.ByteCnn(rng.normal(0, 0.3, (byte_cnn.WIDTH, 256, f)).astype(np.float32),
                         rng.normal(0, 0.1, f).astype(np.float32), rng.normal(0, 1, 2 * f + 2).astype(np.float32),
                         rng.uniform(0.5, 2, 2 * f + 2).astype(np.float32),
                         rng.normal(0, 0.3, 2 * f + 2).astype(np.float32), 0.2)
    texts = ["", None, "short", "é" * 300, "w" * 512, "".join(map(chr, rng.integers(97, 123, 1500))),
             "".join(map(chr, rng.integers(32, 300, 1023))), "".join(map(chr, rng.integers(32, 90, 961)))]
    got = byte_cnn.predict(*text_bytes(pa.array(texts)), m)
    assert np.allclose(got, [brute_network(t, m) for t in texts], atol=1e-4)
