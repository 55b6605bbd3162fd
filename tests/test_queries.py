"""Every registered query against its DuckDB SQL on the same tables
(sf0.001): same columns, same rows (order-insensitive)."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from core import core_queries, core_sql  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(core_queries()))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, core_queries()[key], core_sql().get(key), SF)
    assert r["status"] in ("ok", "rows-only"), r


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "binary": "BLOB"}


@pytest.mark.parametrize("key", sorted(core_sql()))
def test_query_types_match_oracle(spark, con, key):
    df = core_queries()[key](spark, SF)
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {core_sql()[key]}").fetchall()}
    assert spark_types == duck_types
