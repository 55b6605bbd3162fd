"""Cases of the second review: what earlier tests could not show."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import contamination
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from tablework.llm import decontamination, license_scan, quality_rules, toxicity
from tablework.llm.common import text_slices

SF = "/root/testdata/sf0.01"


def repeated_positions(text, size=5):
    """Words of a text that stand in a window found twice, by comparing all pairs of windows."""
    w = text.split()
    starts = range(len(w) - size + 1)
    return len({k + j for k in starts for m in starts if k != m and w[k:k + size] == w[m:m + size]
                for j in range(size)})


@pytest.mark.parametrize("text, n", [
    ("a b c d e 1 2 3 a b c d e 4 5 6 7", 10), ("a b c d e f a b c d e", 10), ("x " * 50, 50),
    ("a b c d e f 1 a b c d e f", 12), ("a b c d 1 a b c d", 0), ("one two", 0), ("", 0)])
def test_repeated_words_are_words_not_windows(text, n):
    assert repeated_positions(text) == n
    part = next(text_slices(pa.record_batch([pa.array([text])], names=["text"]), "text"))
    got = quality_rules._judge(part, "text", quality_rules.untrained())
    words = len(text.split())
    assert got["n_repeat_words"].tolist() == [n]
    assert got["base_failed"].tolist() == [words < 10 or 100 * n > 20 * words]


def test_rules_stage_rejects_bad_documents_that_it_receives(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    bad = labels.where("quality = 0").select("doc_id")
    passed = quality_rules.apply_rules(docs, quality_rules.untrained()).where("kept").select(docs.columns)
    # What a perfect classifier leaves, and bad texts under ids that no label names.
    planted = passed.join(bad, "doc_id").select(*[(-1 - F.col(c)).alias(c) if c == "doc_id" else c for c in docs.columns])
    received = passed.join(bad, "doc_id", "left_anti").unionByName(planted)
    kept = corpus_pipeline.quality_rule_filter(spark, received, SF)
    n, n_kept = planted.count(), kept.where("doc_id < 0").count()
    assert n > 20 and n_kept < 0.5 * n
    assert kept.where("doc_id >= 0").count() > 0.9 * received.where("doc_id >= 0").count()


@pytest.fixture(scope="module")
def channel():
    counts = np.zeros((toxicity._SIZE,) * 3)
    text = " you are a stupid idiot and a moron this is pathetic trash the scum shut up ass shit "
    c = toxicity._LUT[np.frombuffer((text * 20).encode("utf-32-le"), "<u4")]
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    p = (counts + 0.01) / (counts.sum(axis=2, keepdims=True) + 0.01 * toxicity._SIZE)
    weights = {w: 0.9 for w in ("idiot", "stupid", "moron", "scum", "ass", "shit")} | {"idio~": 0.8}
    return toxicity.Channel(-np.log(p), toxicity.lexicon_of(weights), learned=frozenset(weights))


@pytest.mark.parametrize("noisy, plain", [
    ("idio7", "idiot"), ("idio+", "idiot"), ("!diot", "idiot"), ("5h17", "shit"), ("a$$", "ass"), ("455", "ass"),
    ("stu" + "u" * 60 + "pid", "stupid"), ("s/t/u/p/i/d", "stupid"), ("s,t,u,p,i,d", "stupid"), ("a s s", "ass"),
    ("s...t...u...p...i...d", "stupid"), ("(s t u p i d)", "stupid"), ("shut up,idiot", "shut up idiot"),
    ("idiot/moron", "idiot moron"), ("idiot-moron", "idiot moron"), ("well-known", "well-known"),
    ("#idiot", "idiot"), ("in 2024, 1 2 3", "in 2024 1 2 3"), ("scum!", "scum"), ("(as)", "as"), ("as!", "as")])
def test_obfuscations_at_any_place_are_read(channel, noisy, plain):
    assert " ".join(w for w in channel.restore(noisy) if w) == plain


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_benchmark_fingerprints_carry_the_words_within_reach(spark, monkeypatch, broadcast_rows):
    seen = []
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", broadcast_rows)
    join = type(spark.range(0)).join
    monkeypatch.setattr(type(spark.range(0)), "join", lambda self, other, *a: seen.append(other) or join(self, other, *a))
    long = " ".join(f"w{k * k % 997}" for k in range(600))
    docs = [(1, long), (2, " ".join(long.split()[95:115])), (3, " ".join(long.split()[590:])), (4, "x y z")]
    items = [(1, long), (2, "x y")]
    got = decontamination.digest(decontamination.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert Counter(map(tuple, got.collect())) == contamination(docs, items)
    sizes = [f.agg(F.max(F.size("ih"))).first()[0] for f in seen if "ih" in f.columns]
    assert sizes and max(sizes) <= 2 * decontamination.REACH + decontamination.K


def test_licence_with_its_rarest_words_changed_is_found(spark):
    docs = [(1, "distribution and use in source and binary forms with or without changes are allowed"),
            (2, "source and binary forms")]
    rows = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in rows}
    assert by[1].labels == "bsd" and by[1].score == pytest.approx(11 / 14)
    assert by[2].labels == "" and by[2].score == 0


def test_every_oracle_is_sql():
    assert all(isinstance(sql, str) for sql in E.oracle_sql().values())
