"""The eight enrollment questions on a table made by hand, through the same
operators the registered queries use; and the goldens of the 2,000-row sample
"""

import os

import pytest

from tablework.functions.text import starts_with
from tablework.operators import cleaning as C
from tablework.operators import stats as S
from tablework.sources import files as FS

CSV = os.environ.get("TABLEWORK_ENROLLMENT_CSV", "")
ROWS = "1,6D 2,6D 3,6D 4,8A 5,8A 6,10E 7,7E 8,7E 9,nan x,8B 1,6D ,9C"


def cleaned(spark, path):
    raw = FS.load_table(spark, path, schema="studentId STRING, class STRING")
    return C.clean_table(raw, required=["studentId", "class"], numeric={"studentId": "int64"},
                         null_tokens={"class": ["nan"]}, drop_missing_in=["class"], dedupe=True)


def test_eight_questions_by_hand(spark, tmp_dir):
    path = os.path.join(tmp_dir, "enrollment.csv")
    with open(path, "w") as f:
        f.write("studentId,class\n" + ROWS.replace(" ", "\n") + "\n")
    df, report = cleaned(spark, path)
    rep = {r["step"]: r["rows"] for r in report.collect()}
    assert (rep["loaded"], rep["final"]) == (12, 8)
    assert S.min_max(df, "studentId").first() == (1, 8)
    assert S.count_distinct(df, "class").first()[0] == 4
    assert tuple(S.top_groups(df, "class").first()) == ("6D", 3)
    assert [r[0] for r in S.groups_with_count(df, "class", 1).collect()] == ["10E"]
    d = S.describe_group_sizes(df, "class").first()
    assert (d["count"], d["mean"], round(d["std"], 6)) == (4, 2.0, 0.816497)
    assert (d["min"], d["p25"], d["p50"], d["p75"], d["max"]) == (1, 1.75, 2, 2.25, 3)
    assert dict(map(tuple, S.group_size_histogram(df, "class").collect())) == {1: 1, 2: 2, 3: 1}
    pats = {"ends_E": (None, "E"), "starts_8": ("8", None)}
    assert tuple(S.pattern_counts(df, "class", pats, "row").first()) == (3, 2)
    assert tuple(S.pattern_counts(df, "class", pats, "key").first()) == (2, 1)
    assert S.percentage(df, starts_with("class", "8")).first()[0] == 25.0
    assert dict(map(tuple, S.group_mean(df, "class", "studentId").collect())) == \
        {"6D": 2.0, "8A": 4.5, "10E": 6.0, "7E": 7.5}
    assert [r["class"] for r in S.group_counts(df, "class").orderBy("class").collect()] == ["10E", "6D", "7E", "8A"]


@pytest.fixture(scope="module")
def classes(spark):
    clean, report = cleaned(spark, CSV)
    return clean.cache(), report


def check_cleaning(classes):
    clean, report = classes
    rep = {r["step"]: r["rows"] for r in report.collect()}
    assert rep["loaded"] == 2000 and rep["final"] == 2000
    assert S.min_max(clean, "studentId").first() == (1, 2000)


def check_eight_questions(classes):
    df, _ = classes
    assert S.count_distinct(df, "class").first()[0] == 312
    assert tuple(S.top_groups(df, "class").first()) == ("6D", 16)
    assert sorted(r[0] for r in S.groups_with_count(df, "class", 1).collect()) == ["10K", "10N", "1B", "5M", "8K"]
    d = S.describe_group_sizes(df, "class").first()
    assert d["count"] == 312 and round(d["mean"], 6) == 6.410256 and round(d["std"], 6) == 2.733317
    assert (d["min"], d["p25"], d["p50"], d["p75"], d["max"]) == (1, 5, 6, 8, 16)
    hist = dict(tuple(r) for r in S.group_size_histogram(df, "class").collect())
    assert hist == {1: 5, 2: 17, 3: 22, 4: 33, 5: 45, 6: 49, 7: 41, 8: 36, 9: 24, 10: 13, 11: 12,
                    12: 7, 13: 7, 16: 1}
    pats = {"ends_E": (None, "E"), "starts_8": ("8", None)}
    assert tuple(S.pattern_counts(df, "class", pats, "row").first()) == (85, 189)
    assert tuple(S.pattern_counts(df, "class", pats, "key").first()) == (12, 26)
    assert round(S.percentage(df, starts_with("class", "8")).first()[0], 2) == 9.45
    means = dict(tuple(r) for r in S.group_mean(df, "class", "studentId").collect())
    assert means["6D"] == 948.75


def check_bar_series_sorted_by_key(classes):
    df, _ = classes
    bars = S.group_counts(df, "class").orderBy("class").collect()
    assert len(bars) == 312 and bars[0]["class"] == "10A"


if CSV and os.path.exists(CSV):
    test_cleaning, test_eight_questions = check_cleaning, check_eight_questions
    test_bar_series_sorted_by_key = check_bar_series_sorted_by_key
