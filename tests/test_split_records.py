"""Range-wise reading of CSV and JSON records (``sources.records``)."""

import csv
import io
import json
import os
import random

import numpy as np
import pytest

from tablework.sources import records as R
from tablework.sources.files import _over_one_range, load_table

SCHEMA = "id long, text string, other string"


@pytest.fixture()
def small_ranges(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]

    def use(size):
        for n in names:
            spark.conf.set(n, str(size))
    yield use
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def random_rows(n, seed):
    rng = random.Random(seed)
    bits = ["a", '"', ",", "\n", "\n\n", '""', ' "x" ', "é", "{", "}", "[", "]", "\\", "\t", "5\" pipe", "日本"]
    return [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) or None, rng.choice(["x", "y,z", None]))
            for k in range(n)]


def tuples(df):
    return sorted(((r[0], r[1], r[2]) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [7, 64, 1000, 10 ** 6])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_csv_in_ranges_of_any_size(spark, tmp_dir, small_ranges, size, line_end):
    rows = random_rows(60 if size < 64 else 400, size)
    out = io.StringIO()
    w = csv.writer(out, lineterminator=line_end)
    w.writerow(["id", "text", "other"])
    w.writerows([["" if v is None else v for v in r] for r in rows])
    path = put(tmp_dir, "t.csv", out.getvalue())
    small_ranges(size)
    got = load_table(spark, path, schema=SCHEMA, multiline="split")
    assert tuples(got) == sorted(((a, b, c) for a, b, c in rows), key=str)
    if size == 64:
        assert R._pieces(spark, path, "\n").rdd.getNumPartitions() >= 8


@pytest.mark.parametrize("text, want", [
    ("", []), ("id,text,other\n", []), ("id,text,other\n\n\n1,a,b\n\n", [(1, "a", "b")]),
    ("id,text,other\n1,5\" pipe,x\n2,\"q\n\"\"q\",y", [(1, '5" pipe', "x"), (2, 'q\n"q', "y")]),
    ("﻿id,text,other\n1,a,b", [(1, "a", "b")]),
    ("id,text,other\n1,a\"b\n2,\"c,\nd\",e\n3,f\"\",g\n", [(1, 'a"b', None), (2, "c,\nd", "e"), (3, 'f""', "g")]),
    ("id,text,other\n1,\"open\nto the end", [(1, "open\nto the end", None)])])
def test_csv_odd_files(spark, tmp_dir, small_ranges, text, want):
    path = put(tmp_dir, "odd.csv", text)
    for size in (5, 10 ** 6):
        small_ranges(size)
        got = load_table(spark, path, schema=SCHEMA, multiline="split")
        assert tuples(got) == sorted(want, key=str)


def test_csv_split_equals_the_whole_file_parser(spark, tmp_dir, small_ranges):
    for k in range(3):
        out = io.StringIO()
        csv.writer(out, delimiter="|").writerows([["" if v is None else v for v in r] for r in random_rows(150, k)])
        put(tmp_dir, f"{k}.csv", out.getvalue())
    small_ranges(100)
    whole = load_table(spark, tmp_dir, "csv", schema=SCHEMA, header=False, sep="|", multiline=True)
    split = load_table(spark, tmp_dir, "csv", schema=SCHEMA, header=False, sep="|", multiline="split")
    fix = lambda rows: sorted([(a, b and b.replace("\r\n", "\n"), c) for a, b, c in rows], key=str)
    assert fix(tuples(split)) == fix(tuples(whole)) and len(tuples(split)) == 450


def json_rows(n, seed):
    return [{"id": a, "text": b, "other": c} for a, b, c in random_rows(n, seed)]


@pytest.mark.parametrize("size", [9, 80, 10 ** 6])
@pytest.mark.parametrize("layout", ["line", "indent", "objects", "lines"])
def test_json_in_ranges_of_any_size(spark, tmp_dir, small_ranges, size, layout):
    rows = json_rows(50 if size < 80 else 300, size)
    text = {"line": json.dumps(rows, ensure_ascii=False), "indent": json.dumps(rows, indent=2) + "\n",
            "objects": "".join(json.dumps(r, indent=1) for r in rows),
            "lines": "".join(json.dumps(r) + "\n" for r in rows)}[layout]
    path = put(tmp_dir, "t.json", text)
    small_ranges(size)
    got = load_table(spark, path, schema=SCHEMA, multiline="split")
    assert tuples(got) == sorted(((r["id"], r["text"], r["other"]) for r in rows), key=str)


def test_json_nested_records(spark, tmp_dir, small_ranges):
    rows = [{"id": k, "deep": [{"a": {"b": "}]" * (k % 3)}}, {"a": {"b": "\\\"{"}}]} for k in range(80)]
    path = put(tmp_dir, "n.json", json.dumps(rows, indent=1))
    small_ranges(50)
    schema = "id long, deep array<struct<a: struct<b: string>>>"
    got = load_table(spark, path, schema=schema, multiline="split").orderBy("id").collect()
    assert [json.loads(json.dumps(r.asDict(recursive=True))) for r in got] == rows


@pytest.mark.parametrize("text", ["", "[]", "  [ ]\n", "\n"])
def test_json_without_records(spark, tmp_dir, text):
    path = put(tmp_dir, "e.json", text)
    assert load_table(spark, path, schema=SCHEMA, multiline="split").collect() == []


def test_large_input_is_split_by_default(spark, tmp_dir, small_ranges):
    rows = json_rows(200, 4)
    path = put(tmp_dir, "big.json", json.dumps(rows))
    assert not _over_one_range(spark, path)
    small_ranges(500)
    assert _over_one_range(spark, path) and _over_one_range(spark, [tmp_dir + "/*.json"])
    df = load_table(spark, path, schema=SCHEMA)
    assert "MapInArrow" in df._jdf.queryExecution().toString() and df.count() == 200
    lines = put(tmp_dir, "lines.json", "".join(json.dumps(r) + "\n" for r in rows))
    df = load_table(spark, lines, schema=SCHEMA)
    assert "MapInArrow" not in df._jdf.queryExecution().toString() and df.count() == 200
    with pytest.raises(ValueError):
        load_table(spark, path, multiline="split")


def test_walk_is_the_step_by_step_walk():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        to0, to1 = rng.integers(0, 2, n), rng.integers(0, 2, n)
        d0, d1 = rng.integers(-3, 4, n), rng.integers(-3, 4, n)
        for state in (0, 1):
            s, d, want = state, 5, []
            for k in range(n):
                d += (d0, d1)[s][k]
                s = (to0, to1)[s][k]
                want.append((s, d))
            after, depths = R.walk(to0, to1, d0, d1, state, 5)
            assert list(zip(after, depths)) == want
