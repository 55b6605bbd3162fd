"""Sources, sinks and cleaning on small edge-case inputs."""

import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.operators import cleaning as C
from tablework.plans.fixtures import workbook_bytes
from tablework.sources import archives as AR
from tablework.sources import files as FS
from tablework.sources import jdbc as JD
from tablework.sources import workbooks as WB

EDGE_CSV = ("studentId,class\n"
            "1,6D\n"
            "2,7D,extra\n"          # extra field
            "3,\n"                  # empty class
            " 4 ,\t8A \n"      # padded values (tab, NBSP)
            "nan,9B\n"              # missing id
            "1,6D\n"                # exact duplicate
            "1.5,8E\n"              # fraction → truncated
            "x,6F\n")               # bad id

SCHEMA = T.StructType([T.StructField("studentId", T.StringType()), T.StructField("class", T.StringType())])


def _write(tmp_dir, name, text):
    p = os.path.join(tmp_dir, name)
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(text)
    return p


def test_source_kind():
    assert FS.source_kind("s3://b/x/data.CSV") == "csv"
    assert FS.source_kind("/d/t.tsv.gz") == "tsv"
    assert FS.source_kind("https://h/a.parquet?x=1") == "parquet"
    assert FS.source_kind("f.xlsx") == "workbook"
    with pytest.raises(ValueError):
        FS.source_kind("notes.docx")


def test_csv_split_and_clean_report(spark, tmp_dir):
    p = _write(tmp_dir, "q.csv", EDGE_CSV)
    good, bad = FS.load_csv_split(spark, p, SCHEMA)
    assert bad.count() == 1 and bad.first()["_corrupt_record"] == "2,7D,extra"
    # pruning must not let the malformed row back in
    assert sorted(r[0] for r in good.select("studentId").collect() if r[0]) == sorted(
        ["1", "3", " 4 ", "1", "1.5", "x"])
    clean, report = C.clean_table(good, required=["studentId", "class"], strip=["studentId", "class"],
                                  numeric={"studentId": "bigint"}, drop_missing_in=["class"], dedupe=True)
    assert sorted(tuple(r) for r in clean.collect()) == [(1, "6D"), (1, "8E"), (4, "8A")]
    rep = {r["step"]: r["rows"] for r in report.collect()}
    assert rep == {"loaded": 7, "dropped: invalid studentId": 2, "dropped: missing class": 1,
                   "dropped: duplicate": 1, "final": 3}


def test_require_columns_message(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="not in the table"):
        C.require_columns(df, ["a", "b"])


def test_apply_schema_modes(spark):
    df = spark.createDataFrame([("1", "2020-01-02", "true"), ("7D", "bad", "no")], "a string, d string, b string")
    decl = {"a": "int64", "d": "date", "b": "bool"}
    assert C.apply_schema(df, decl).collect()[1].asDict() == {"a": None, "d": None, "b": False}
    assert C.apply_schema(df, decl, on_mismatch="drop").count() == 1
    with pytest.raises(Exception):
        C.apply_schema(df, decl, on_mismatch="raise").collect()


def test_parse_dates_and_flatten(spark):
    df = spark.createDataFrame([("15-03-2020", '{"a": {"b": 1}, "xs": [1, 2]}'),
                                ("2020-03-15", '{"a": {"b": 2}, "xs": []}')], "d string, j string")
    out = C.parse_dates(df, {"d": "dd-MM-yyyy"})
    assert [str(r[0]) for r in out.select("d").collect()] == ["2020-03-15", "None"]
    flat = C.flatten(df.select("j"), json_columns={"j": "a STRUCT<b: INT>, xs ARRAY<INT>"})
    assert flat.columns == ["j_a_b", "j_xs"]
    assert sorted(tuple(r) for r in flat.collect()) == [(1, 1), (1, 2), (2, None)]


def test_workbooks_shared_and_inline(spark, tmp_dir):
    for i, shared in enumerate([True, False]):
        blob = workbook_bytes(["id", "name", "price"], [[1, "a & b", 2.5], [2, None, 3.0]], shared=shared)
        with open(os.path.join(tmp_dir, f"w{i}.xlsx"), "wb") as fh:
            fh.write(blob)
    out = WB.load_workbooks(spark, os.path.join(tmp_dir, "*.xlsx"),
                            schema="id BIGINT, name STRING, price DOUBLE")
    got = sorted((r["id"], r["name"], r["price"]) for r in out.collect())
    assert got == [(1, "a & b", 2.5), (1, "a & b", 2.5), (2, None, 3.0), (2, None, 3.0)]


def test_archives_zip_and_tar(spark, tmp_dir):
    member = b"k,v\n1,a\n2,b\n"
    with zipfile.ZipFile(os.path.join(tmp_dir, "a.zip"), "w") as zf:
        zf.writestr("x/one.csv", member)
        zf.writestr("skip.txt", b"nope")
    with tarfile.open(os.path.join(tmp_dir, "b.tar.gz"), "w:gz") as tf:
        info = tarfile.TarInfo("two.csv")
        info.size = len(member)
        tf.addfile(info, io.BytesIO(member))
    out = AR.load_archive_csv(spark, os.path.join(tmp_dir, "*.*"), "k INT, v STRING")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]
    listing = AR.load_archive_members(spark, os.path.join(tmp_dir, "*.*"), "*.csv")
    assert sorted(r["n_lines"] for r in listing.collect()) == [3, 3]


def test_load_tables_keeps_order_and_errors(spark, tmp_dir):
    p = _write(tmp_dir, "ok.csv", "a\n1\n")
    frames, report = FS.load_tables(spark, [{"name": "ok", "path": p, "schema": "a INT"},
                                            {"name": "bad", "path": os.path.join(tmp_dir, "none.csv")},
                                            {"name": "odd", "path": "x.unknown"}])
    rep = [(r["position"], r["name"], r["status"]) for r in report.orderBy("position").collect()]
    assert rep == [(0, "ok", "ok"), (1, "bad", "error"), (2, "odd", "error")]
    assert frames["ok"].count() == 1


def test_sinks_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "x", 1.5), (2, "y", None)], "a INT, s STRING, d DOUBLE")
    for kind in ("csv", "json", "parquet", "orc"):
        path = FS.save_table(df, os.path.join(tmp_dir, f"t.{kind}"), kind)
        back = FS.load_table(spark, path, kind, schema=df.schema)
        assert sorted(tuple(r) for r in back.collect()) == [(1, "x", 1.5), (2, "y", None)]


def test_partition_pruning_in_plan(spark, tmp_dir):
    df = spark.range(100).select((F.col("id") % 5).alias("year"), F.col("id"))
    root = FS.save_table(df, os.path.join(tmp_dir, "p"), "parquet", partition_by=["year"])
    q = FS.load_table(spark, root, "parquet", where="year = 3 AND id > 10")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(id), GreaterThan(id,10)]" in plan
    assert q.count() == 18


def test_jdbc_subquery_text():
    assert JD.jdbc_query("t", ["a", "b"], "a > 1") == "(SELECT a, b FROM t WHERE a > 1) tw_src"


def test_schema_of_and_sample_rows(spark):
    from tablework.operators import quality as Q
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id BIGINT, class STRING")
    assert [tuple(r) for r in Q.schema_of(df).collect()] == [(0, "id", "bigint"), (1, "class", "string")]
    assert [r["id"] for r in Q.sample_rows(df, 2, ["id"]).collect()] == [1, 2]
    with pytest.raises(ValueError):
        Q.sample_rows(df, 2, [])


def test_nan_as_null_at_load(spark, tmp_dir):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.5)], "id INT, v DOUBLE")
    path = FS.save_table(df, os.path.join(tmp_dir, "nan.parquet"), "parquet")
    raw = FS.load_table(spark, path)
    clean = FS.load_table(spark, path, nan_as_null=True)
    assert sorted(tuple(r) for r in clean.collect()) == [(1, None), (2, 2.5)]
    assert raw.where("isnan(v)").count() == 1


def test_workbook_sheet_by_name_and_text_source(spark, tmp_dir):
    blob = workbook_bytes(["id", "name"], [[1, "a"], [2, "b"]])
    with open(os.path.join(tmp_dir, "s.xlsx"), "wb") as fh:
        fh.write(blob)
    pattern = os.path.join(tmp_dir, "*.xlsx")
    by_name = WB.load_workbooks(spark, pattern, sheet="data", schema="id BIGINT, name STRING")
    assert sorted(tuple(r) for r in by_name.select("id", "name").collect()) == [(1, "a"), (2, "b")]
    assert {r["sheet"] for r in by_name.collect()} == {"data"}
    assert WB.load_workbooks(spark, pattern, sheet="nope", schema="id BIGINT, name STRING").count() == 0
    p = _write(tmp_dir, "notes.txt", "first line\nsecond line\n")
    assert [r[0] for r in FS.load_table(spark, p).collect()] == ["first line", "second line"]


def test_infer_and_best_date_format(spark):
    from tablework.operators import quality as Q
    df = spark.createDataFrame([("15-03-2020",), ("01-12-2019",), ("2020-03-15",), ("",), (None,), ("x",)],
                               "d string")
    shares = {r["format"]: (r["n_parsed"], r["n_values"]) for r in
              Q.infer_date_format(df, "d", ["yyyy-MM-dd", "dd-MM-yyyy", "MM/dd/yyyy"]).collect()}
    assert shares == {"yyyy-MM-dd": (1, 4), "dd-MM-yyyy": (2, 4), "MM/dd/yyyy": (0, 4)}
    best = Q.best_date_format(df, "d", ["yyyy-MM-dd", "dd-MM-yyyy"]).first()
    assert best["format"] == "dd-MM-yyyy" and best["share"] == 0.5


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_dir):
    rows = [(1, 'a "b" c, d'), (2, "two\nlines"), (3, ""), (4, None), (5, ' "edge" '), (6, "x\\")]
    df = spark.createDataFrame(rows, "i int, t string")
    path = FS.save_table(df, f"{tmp_dir}/t.csv", "csv")
    got = {r["i"]: r["t"] for r in FS.load_table(spark, path, "csv", schema=df.schema).collect()}
    assert got == dict(rows) | {3: None}                  # an empty field is missing, as in pandas


def test_json_documents_and_lines(spark, tmp_dir):
    from pathlib import Path
    Path(f"{tmp_dir}/array.json").write_text('[\n  {"a": 1},\n  {"a": 2}\n]\n')
    Path(f"{tmp_dir}/lines.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    read = lambda n: sorted(r["a"] for r in FS.load_table(spark, f"{tmp_dir}/{n}.json", schema="a int").collect())
    assert read("array") == [1, 2] and read("lines") == [1, 2, 3]


def test_malformed_flag_leaves_the_session_alone(spark, tmp_dir):
    from pathlib import Path
    before = spark.conf.get("spark.sql.csv.parser.columnPruning.enabled")
    Path(f"{tmp_dir}/m.csv").write_text("a,b\n1,x\n2,y,z\n")
    rows = FS.load_csv_flagged(spark, f"{tmp_dir}/m.csv", spark.createDataFrame([], "a int, b string").schema)
    assert {r["a"]: r["malformed"] for r in rows.select("a", "malformed").collect()} == {1: False, 2: True}
    assert spark.conf.get("spark.sql.csv.parser.columnPruning.enabled") == before


def test_building_operators_starts_no_job(spark):
    from tablework.operators import cleaning as C
    from tablework.operators import stats as S
    sc = spark.sparkContext
    base = spark.range(1000).selectExpr("id", "cast(id % 7 as string) AS k")
    joined = base.join(base.groupBy("k").count(), "k")
    sc.setJobGroup("planning", "no job expected")
    C.coerce_numeric(joined, "k")
    C.apply_schema(joined, {"k": "int64"})
    S.top_groups(joined, "k")
    assert not sc.statusTracker().getJobIdsForGroup("planning")
    sc.setJobGroup("", "")
