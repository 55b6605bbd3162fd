"""Frequent affixes against enumeration; date formats told from the values."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablework.operators import date_formats as DF
from tablework.operators import patterns as PT


def enumerated(values, support):
    rows, keys = defaultdict(int), defaultdict(set)
    present = [v for v in values if v is not None]
    for v in present:
        for k in range(1, len(v) + 1):
            for kind, p in (("prefix", v[:k]), ("suffix", v[-k:])):
                rows[kind, p] += 1
                keys[kind, p].add(v)
    longest = defaultdict(int)
    for (kind, p), n in rows.items():
        q = p[:-1] if kind == "prefix" else p[1:]
        longest[kind, q] = max(longest[kind, q], n)
    return sorted((kind, p, n, len(keys[kind, p]), longest[kind, p] < n)
                  for (kind, p), n in rows.items() if n >= support * len(present))


@pytest.mark.parametrize("support", [0.02, 0.3, 1.0])
def test_all_frequent_affixes(spark, support):
    rng = random.Random(7)
    values = ["".join(rng.choice("abé🙂") for _ in range(rng.randint(0, 6))) for _ in range(300)]
    values += ["prefix-" + str(k % 3) for k in range(100)] + [None] * 50 + ["same" * 20] * 40
    df = spark.createDataFrame([(v, 1) for v in values], "value string, depth int")
    got = sorted(map(tuple, PT.frequent_affixes(df, "value", support).collect()))
    assert got == enumerated(values, support)


def test_affixes_edges(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    assert PT.frequent_affixes(df, "t", 0.5).collect() == []
    assert PT.frequent_affixes(df.limit(0), "t", 0.5).collect() == []
    one = spark.createDataFrame([("abc",)] * 4, "t string")
    assert len(PT.frequent_affixes(one, "t", 1).collect()) == 6
    with pytest.raises(ValueError):
        PT.frequent_affixes(one, "t", 0)


DAYS = [dt.datetime(2020, 1, 1, 0, 0) + dt.timedelta(days=3 * k, minutes=977 * k, milliseconds=37 * k) for k in range(120)]
WAYS = {"dd-MM-yyyy": "%d-%m-%Y", "MM/dd/yyyy": "%m/%d/%Y", "yyyy-MM-dd": "%Y-%m-%d", "yyyy-dd-MM": "%Y-%d-%m",
        "dd.MM.yy": "%d.%m.%y", "yyyyMMdd": "%Y%m%d", "yyyy/MM/dd HH:mm:ss": "%Y/%m/%d %H:%M:%S",
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'": "%Y-%m-%dT%H:%M:%S.%fZ", "MM/dd/yyyy hh:mm a": "%m/%d/%Y %I:%M %p",
        "MMMM dd, yyyy": "%B %d, %Y"}


@pytest.mark.parametrize("fmt", WAYS)
def test_formats_are_found_and_parse_their_column(spark, fmt):
    texts = [d.strftime(WAYS[fmt]) for d in DAYS]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, w string")
    found = DF.induce_date_formats(df, "w").collect()
    assert {r.format for r in found} == {fmt} and sum(r.n_rows for r in found) == len(DAYS)
    assert any(r.ambiguous for r in found) == (fmt == "dd.MM.yy")      # years 20 and 21 could be days
    parsed = {r.id: r.w for r in DF.parse_induced(df, "w", DF.induce_date_formats(df, "w")).collect()}
    assert parsed == {k: dt.datetime.strptime(t, WAYS[fmt]) for k, t in enumerate(texts)}


def test_several_templates_ambiguous_and_no_dates(spark):
    rows = ["01/02/2020", "12/11/2020", "2020-05-06", "31.12.1999", "x", "", None, "99-99-9999", "1:2:3", "20201345",
            "20200101", "5 Mar 2021", "a" * 100, "2020-01-01 25:00", " 13-1-2020 "]
    got = {r.template: r for r in DF.induce_date_formats(
        spark.createDataFrame([(v,) for v in rows], "v string"), "v").collect()}
    assert sum(r.n_rows for r in got.values()) == len(rows) - 2
    both = got["99/99/9999"]
    assert both.ambiguous and both.formats == ["dd/MM/yyyy", "MM/dd/yyyy"] and both.format == "dd/MM/yyyy"
    assert got["9999-99-99"].formats == ["yyyy-MM-dd", "yyyy-dd-MM"]
    assert got["99.99.9999"].formats == ["dd.MM.yyyy"] and got["99-9-9999"].formats == ["dd-M-yyyy"]
    assert got["9 {Mon} 9999"].formats == ["d MMM yyyy"]
    for t in ("x", "99-99-9999", "9:9:9", "99999999", None, "9999-99-99 99:99"):
        assert got[t].format is None and got[t].formats == []


def test_no_values(spark):
    df = spark.createDataFrame([(None,), (" ",)], "v string")
    assert DF.induce_date_formats(df, "v").collect() == []
    assert [r.v for r in DF.parse_induced(df, "v", DF.induce_date_formats(df, "v")).collect()] == [None, None]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="9TZ:-/. {}MonthAM", max_size=20), st.lists(st.integers(0, 9999), min_size=8, max_size=8))
def test_any_template_is_read(template, numbers):
    for f in DF.formats_of(template, numbers, numbers, numbers[:4]):
        assert isinstance(f, str)
