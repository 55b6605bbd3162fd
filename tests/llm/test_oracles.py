"""The registered queries that SQL can express, against DuckDB on the same tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402
from tablework.llm.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in E.queries()


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, key):
    r = compare(spark, duck(SF), key, E.queries()[key], E.oracle_sql()[key], SF)
    assert r["status"] == "ok", r
