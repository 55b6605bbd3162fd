"""Operators on DataFrame functions: sharding, decontamination, licence scan."""

import random
from collections import Counter

import pytest
from brute import all_licences, base_licences, contamination
from pyspark.sql import functions as F

from tablework.llm import decontamination, license_scan, sharding

SF = "/root/testdata/sf0.001"
ITEMS = [(1, "a b c d e f g h i j k l m"), (2, "x y"), (None, "É q r"), (4, ""), (5, None),
         (6, "a b c d e f g h i j"), (7, "r r r r r r r r r r r r")]
DOCS = [(1, "zz A b c, d e f g h i j k u"), (1, "x y x y"), (None, "é q r É q R"), (3, ""), (4, None),
        (5, "X Y"), (5, "X Y"), (6, "r " * 40), (7, "a b c d e f g h i"),
        (8, "w a b c d e f g h i j k l m a b c d e f g h i j"), (9, "word " * 30_000 + "x y")]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_decontamination_edges(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", broadcast_rows)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("item", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("h", F.lit(1))
    got = decontamination.digest(decontamination.decontaminate(docs, items))
    assert Counter(map(tuple, got.collect())) == contamination(DOCS, ITEMS)
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 7]


def test_decontamination_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.decontaminate(docs, none).collect()
    assert sum(r.n_rows for r in got) == len(DOCS) and not any(r.n_hit for r in got)
    assert decontamination.decontaminate(docs.limit(0), none).count() == 0


def test_decontamination_table(spark, docs_and_items):
    docs, items = docs_and_items
    got = decontamination.digest(decontamination.decontaminate(
        spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert Counter(map(tuple, got.collect())) == contamination(docs, items)


LICENCES = [(1, "MIT License mit license"), (2, None), (3, ""), (4, "x"), (4, "x"), (None, "license mit license"),
            (5, "under the GNU General Public License, version 3 and Apache  license"),
            (6, "Licensed under CC BY-NC 4.0."), (7, "mit É license"), (8, "w " * 20_000 + "mit license")]


def test_licence_scan_edges(spark):
    docs = spark.createDataFrame(LICENCES, "doc_id long, text string").withColumn("word", F.lit("clash"))
    rows = license_scan.scan(docs).collect()
    assert Counter((r[0], *r[1:6]) for r in rows) == Counter((d, *base_licences(t)) for d, t in LICENCES)
    by = {r.doc_id: r for r in rows}
    assert by[6].labels == "cc-by-nc" and by[6].base_labels == "" and by[6].score == 1
    assert by[2].score == 0 and by[5].labels == "apache,gpl"
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_licence_scan_table(spark, docs_and_items):
    rows = license_scan.scan(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    want = Counter((d, *base_licences(t)) for d, t in docs_and_items[0])
    assert Counter((r[0], *r[1:6]) for r in rows) == want


def test_sharding_limits(spark):
    docs = [(i, "x" * (i % 50)) for i in range(400)] + [(7, "dup dup dup")] * 300 + [(None, None)] * 5 \
        + [(9, "y" * 5000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("depth", F.lit("clash"))
    rows = sharding.assign(frame, 300, keep_columns=True).collect()
    assert len(rows) == len(docs)
    size, n = Counter(), Counter()
    for r in rows:
        size[r.shard] += r.n_bytes
        n[r.shard] += 1
    assert all(v <= 300 or n[k] == 1 for k, v in size.items())
    assert [r.doc_id for r in rows if r.oversize] == [9]
    whole = {s.split(".")[0] for s in size}                  # no shard's bits begin another's
    assert not any(a != b and b.startswith(a) for a in whole for b in whole if len(b) < 60)
    assert sharding.assign(frame.limit(0), 300).count() == 0


def test_native_plans_hold_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for df in (decontamination.decontaminate(docs, items), license_scan.scan(docs), sharding.assign(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def damaged_notices(seed):
    """Template statements with words changed, dropped or doubled, among other words."""
    rng = random.Random(seed)
    out = []
    for t in license_scan.templates():
        for _ in range(4):
            w = list(t["words"])
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([["other"], [], [w[k]] * 2, ["license"], ["the", w[k]]])
            around = [rng.choice(["x", "the", "license", "public", "software", "Y,"]) for _ in range(rng.randint(0, 9))]
            cut = rng.randint(0, len(around))
            out.append(" ".join(around[:cut] + w + around[cut:]))
    return out + [" ".join(rng.sample(out, 3)) for _ in range(30)]


def test_licence_templates_against_brute_force(spark):
    docs = list(enumerate(damaged_notices(6)))
    rows = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs) and len(license_scan.TEMPLATES) >= 30
    by = {r.doc_id: r for r in rows}
    found = 0
    for d, text in docs:
        labels, score, at = all_licences(text, license_scan.templates(), license_scan.COVER)
        r = by[d]
        assert r.labels == labels and r.score == pytest.approx(score), text
        assert [(m.label, m["first"], m["last"]) for m in r.matched] == [a[:3] for a in at], text
        found += len(at)
    assert found > 100


def test_a_file_looks_up_its_own_rarest_words(spark):
    docs = spark.createDataFrame([(1, "mozilla public license"), (2, "public license"), (3, "license mozilla public x"),
                                  (4, "")], "doc_id long, text string")
    vocabulary = sorted({w for t in license_scan.templates() for w in t["words"]})
    chosen = license_scan.look_up_words(*license_scan.document_frequencies(docs, vocabulary))
    own = license_scan.own_words(license_scan.ascii_words("text"), chosen)
    got = {r.doc_id: r.own for r in docs.select("doc_id", own.alias("own")).collect()}
    assert got == {1: ["mozilla"], 2: [], 3: ["mozilla"], 4: []}
