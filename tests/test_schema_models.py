"""JSON schemas told from the data; least squares per group."""

import numpy as np
import pytest

from tablework.operators import cleaning as C
from tablework.operators import stats as S


@pytest.mark.parametrize("texts, want", [
    (['{"a":1}', '{"a":2.5,"b":"x"}', "bad", None], "STRUCT<a: DOUBLE, b: STRING>"),
    (['{"a b":{"x":null},"l":[{"p":1},{"q":true}]}'], "STRUCT<`a b`: STRUCT<x: STRING>, l: ARRAY<STRUCT<p: BIGINT, q: BOOLEAN>>>"),
    (['{"m":1}', '{"m":"x"}', '{"VOID":1,"OBJECT":2}'], "STRUCT<OBJECT: BIGINT, VOID: BIGINT, m: STRING>"),
    (["{}"], "STRING"), ([None], "STRING"), (["3"], "STRING"), (["[1,2]", "[]"], "ARRAY<BIGINT>"),
    (['{"e":[],"o":{}}'], "STRUCT<e: ARRAY<STRING>, o: STRING>")])
def test_schema_of_json_text(spark, texts, want):
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    assert C.json_schemas(df, ["j"]) == {"j": want}


def test_flatten_without_a_schema(spark):
    rows = [(1, '{"a":1,"in":{"x":"u"},"l":[{"p":1},{"p":2}]}'), (2, '{"in":{"y":true}}'), (3, "bad"), (4, None)]
    out = C.flatten(spark.createDataFrame(rows, "id int, j string"), json_columns=["j"])
    assert sorted(out.columns) == ["id", "j_a", "j_in_x", "j_in_y", "j_l_p"]
    got = sorted((r.id, r.j_a, r.j_in_x, r.j_in_y, r.j_l_p) for r in out.collect() if r.id != 1)
    assert got == [(2, None, None, True, None), (3, None, None, None, None), (4, None, None, None, None)]
    assert sorted(r.j_l_p for r in out.where("id = 1").collect()) == [1, 2]
    assert C.flatten(spark.createDataFrame([(1, None)], "id int, j string"), json_columns=["j"]).columns == ["id", "j"]


def test_models_per_group_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in ("a", "b", None):
        x = rng.normal(1e6, 3, (200, 3))
        y = x @ rng.normal(size=3) + rng.normal(0, 0.1, 200)
        rows += [(g, *map(float, r), float(v)) for r, v in zip(x, y)]
    rows += [("a", None, 1.0, 2.0, 3.0), ("b", float("nan"), 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, y double").repartition(7)
    got = {r.g: r for r in S.fit_groups(df, ["x1", "x2", "x3"], "y", ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        mine = np.array([v[1:] for v in rows if v[0] == g and v[1] is not None and v[1] == v[1]])
        x, y = mine[:, :3] - mine[:, :3].mean(0), mine[:, 3] - mine[:, 3].mean()
        b, *_ = np.linalg.lstsq(x, y, rcond=None)
        assert r.n == 200 and np.allclose(r.coefficients, b, rtol=1e-6)
        assert np.isclose(r.r2, 1 - ((y - x @ b) ** 2).sum() / (y ** 2).sum(), rtol=1e-6)


def test_models_without_a_solution(spark):
    rows = [("same", 1.0, 2.0, 5.0)] * 5 + [("line", float(k), 2.0 * k, 1.0) for k in range(5)] + [("one", 1.0, 1.0, 1.0)] \
        + [("flat", float(k), float(k * k), 7.0) for k in range(6)]
    df = spark.createDataFrame(rows, "g string, x double, z double, y double")
    got = {r.g: r for r in S.fit_groups(df, ["x", "z"], "y", ["g"]).collect()}
    assert all(got[g].coefficients is None and got[g].r2 is None for g in ("same", "line", "one"))
    assert np.allclose(got["flat"].coefficients, 0) and got["flat"].intercept == 7 and got["flat"].r2 is None
    assert S.fit_groups(df.limit(0), ["x"], "y").collect() == []
    assert len(S.fit_groups(df, ["x"], "y").collect()) == 1
