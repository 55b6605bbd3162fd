"""A folder of run-history files as a stream, rolled up by the same
operator as the batch path."""

import os

from tablework.operators.responses import run_report
from tablework.streaming import stream_table, write_stream

SCHEMA = "task_id INT, attempt INT, success BOOLEAN, error STRING"


def test_stream_run_report_matches_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    files = {"a.csv": "task_id,attempt,success,error\n1,1,false,boom\n2,1,true,\n",
             "b.csv": "task_id,attempt,success,error\n1,2,true,\n2,2,false,late\n3,1,false,x\n"}
    for name, text in files.items():
        with open(os.path.join(src, name), "w") as fh:
            fh.write(text)
    stream = stream_table(spark, src, "csv", SCHEMA, max_files_per_trigger=1)
    out = os.path.join(tmp_dir, "out")
    q = write_stream(run_report(stream), out, output_mode="complete",
                     checkpoint_location=os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    batch = run_report(spark.read.schema(SCHEMA).option("header", True).csv(src))
    assert got == sorted(tuple(r) for r in batch.collect())
    assert len(got) == 3


def test_stream_cleaning_append_matches_batch(spark, tmp_dir):
    from tablework.operators import cleaning as C
    src = os.path.join(tmp_dir, "raw")
    os.makedirs(src)
    for i, text in enumerate(["studentId,class\n 1 ,6D\nx,7E\n", "studentId,class\n2.5,8A\n3,\t9B \n"]):
        with open(os.path.join(src, f"part{i}.csv"), "w") as fh:
            fh.write(text)
    schema = "studentId STRING, class STRING"

    def clean(df):
        return C.strip_whitespace(C.coerce_numeric(df, "studentId", "int64"), ["class"])

    out = os.path.join(tmp_dir, "clean")
    q = write_stream(clean(stream_table(spark, src, "csv", schema)), out, output_mode="append",
                     checkpoint_location=os.path.join(tmp_dir, "ckpt2"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    batch = clean(spark.read.schema(schema).option("header", True).csv(src))
    assert got == sorted(tuple(r) for r in batch.collect()) == [(1, "6D"), (2, "8A"), (3, "9B")]


def test_stream_parquet_and_json_sources(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None)], "id INT, s STRING, v DOUBLE")
    for kind in ("parquet", "json"):
        src = os.path.join(tmp_dir, f"in_{kind}")
        df.write.mode("overwrite").format(kind).save(src)
        out = os.path.join(tmp_dir, f"out_{kind}")
        q = write_stream(stream_table(spark, src, kind, df.schema), out,
                         checkpoint_location=os.path.join(tmp_dir, f"ck_{kind}"))
        q.awaitTermination(120)
        assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "a", 1.5), (2, "b", None)]
