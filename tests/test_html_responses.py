"""Web pages, responses, runs, answers and grading."""

import json

import pytest
from pyspark.sql import functions as F

from tablework.operators import answers as A
from tablework.operators import responses as RS
from tablework.operators.cleaning import rows_to_table
from tablework.sources import html as H

FILMS = """<html><body><p>Intro<p>More
<table class="infobox"><tr><td>x</td></tr></table>
<table class="wikitable sortable">
<tr><th>Rank</th><th>Peak</th><th>Title</th><th>Worldwide gross</th><th>Year</th></tr>
<tr><td>1</td><td>1</td><td><i>Avatar</i></td><td>$2,923,706,026</td><td>2009</td></tr>
<tr><td>2</td><td>1</td><td>Avengers: Endgame</td><td>$2,797,501,328</td><td>2019</td></tr>
<tr><td>3</td><td>3</td><td>Titanic &amp; more</td><td>$2,257,844,554</td><td>1997</td></tr>
<tr><td colspan="5">footnote</td></tr>
</table><script>var t = "</td></tr>";</script></body></html>"""


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(1, "https://x.org/films", FILMS)], "page_id long, url string, html string")


def test_html_table_by_class_to_typed_rows(spark, pages):
    rows = H.extract_html_tables(pages, css_class="wikitable", index=0, n_cells=5)
    films = rows_to_table(rows, ["page_id", "table_idx"],
                          schema={"Rank": "int64", "Peak": "int64", "Title": "string",
                                  "Worldwide gross": "string", "Year": "int64"})
    from tablework.operators.cleaning import parse_currency
    films = parse_currency(films, "Worldwide gross")
    got = sorted(tuple(r)[2:] for r in films.collect())
    assert got == [(1, 1, "Avatar", 2923706026, 2009), (2, 1, "Avengers: Endgame", 2797501328, 2019),
                   (3, 3, "Titanic & more", 2257844554, 1997)]
    # earliest film over 2.5 bn, films over 2 bn before 2000
    assert films.where(F.col("Worldwide gross") > 2.5e9).orderBy("Year", "Rank").first()["Title"] == "Avatar"
    assert films.where((F.col("Worldwide gross") > 2e9) & (F.col("Year") < 2000)).count() == 1


def test_html_elements_and_urls(spark):
    html = ('<ul><li><a href="/a">A &amp; B</a></li><li><a href="/b">B</a></li></ul>'
            '<p><a href="https://data.example.com/x.csv">data</a> see s3://bucket/key.parquet and '
            'https://api.example.com/v1/items?q=1 or ftp://f.example.com/pub/file.txt</p> '
            'https://files.example.org/dumps/courts.duckdb')
    pages = spark.createDataFrame([(7, html)], "page_id long, html string")
    els = H.extract_html_elements(pages, "a", attr="href", parent="li").collect()
    assert [(r["attr"], r["text"]) for r in els] == [("/a", "A & B"), ("/b", "B")]
    urls = H.harvest_urls(pages, "html", keep=["page_id"]).collect()
    kinds = {r["url"]: r["kind"] for r in urls}
    assert kinds['https://data.example.com/x.csv">data</a>'] == "html"
    assert kinds["s3://bucket/key.parquet"] == "object_store"
    assert kinds["https://api.example.com/v1/items?q=1"] == "api"
    assert kinds["ftp://f.example.com/pub/file.txt</p>"] == "ftp"   # \S+ runs to whitespace
    assert kinds["https://files.example.org/dumps/courts.duckdb"] == "database"


def test_parse_answer_by_format(spark):
    rows = [("42", "number"), ("3.14", "number"), ("1_000", "number"), ("x", "number"),
            ('"Titanic"', "string"), ("plain", "string"), ('[1, "a"]', "json_array"), ("{broken", "json")]
    df = spark.createDataFrame(rows, "t string, f string")
    out = RS.parse_answer(df, "t", F.col("f")).select("num", "is_int", "str", F.to_json("json")).collect()
    assert [r[0] for r in out[:4]] == [42.0, 3.14, 1000.0, None]
    assert [r[1] for r in out[:4]] == [True, False, True, False]
    assert [r[2] for r in out[4:6]] == ["Titanic", "plain"]
    assert json.loads(out[6][3]) == [1, "a"] and out[7][3] is None


def test_response_text_nested(spark):
    schema = "content array<struct<type:string, text:string, content:array<struct<type:string,text:string>>>>"
    df = spark.createDataFrame([([("text", "hello", None), ("tool_use", "ignored", None),
                                  ("tool_result", None, [("text", "out1"), ("image", "x"), ("text", "42")])],)],
                               schema)
    got = RS.response_text(df, nested=True).first()["text"]
    assert got == "hello\nout1\n42\n"
    assert RS.result_line(RS.response_text(df, nested=True), "text").first()["last_line"] == "42"


def test_run_report_and_rollup(spark):
    hist = spark.createDataFrame([(1, 1, False, "boom " * 60), (1, 2, True, None), (2, 1, False, "bad"),
                                  (2, 2, False, "worse")], "task_id int, attempt int, success boolean, error string")
    got = {r["task_id"]: r for r in RS.run_report(hist).collect()}
    assert got[1]["attempts"] == 2 and got[1]["final_success"] is True and got[1]["final_error"] is None
    assert got[2]["final_error"] == "worse" and got[2]["failures"] == 2
    ans = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "task_id int, error string")
    assert tuple(RS.answer_rollup(ans).first()) == (3, 2, 1)


def test_grade(spark):
    rubric = [{"kind": "is_json", "n_items": 4},
              {"item": 0, "kind": "equals", "expected": "1", "weight": 1},
              {"item": 1, "kind": "regex", "expected": "titanic", "weight": 1},
              {"item": 2, "kind": "within", "expected": "0.485782", "tolerance": 0.001, "weight": 1}]
    subs = spark.createDataFrame([("good", '[1, "Titanic", 0.4857, "data:image/png;base64,AA"]'),
                                  ("short", '[1, "Titanic", 0.4857]'), ("broken", "not json"),
                                  ("wrong", '[2, "Avatar", 0.3, ""]')], "submission_id string, answer string")
    got = {r["submission_id"]: (r["score"], r["gate_ok"], r["passed"]) for r in RS.grade(subs, rubric).collect()}
    assert got == {"good": (3.0, True, 3), "short": (0.0, False, 3), "broken": (0.0, False, 0),
                   "wrong": (0.0, True, 0)}


def test_format_answer_formats_and_rows(spark):
    df = spark.createDataFrame([("b", 2.5), ("a", 1.0)], "k string, v double")
    fa = lambda d, f, **kw: A.format_answer(d, f, **kw).first()["answer"]
    assert fa(df.select("v").orderBy("v").limit(1), "number") == "1.0"
    assert fa(df.select("k").where("k = 'a'"), "string") == '"a"'
    assert json.loads(fa(df, "json_object")) == {"a": 1.0, "b": 2.5}
    assert json.loads(fa(df.select("k"), "json_array")) == ["a", "b"]
    assert json.loads(fa(df, "records")) == [{"k": "a", "v": 1.0}, {"k": "b", "v": 2.5}]
    assert json.loads(fa(df.where("false"), "json_array")) == [] and fa(df.where("false"), "number") is None
    missing = spark.createDataFrame([(None, 1), ("a", 2)], "k string, n int")
    assert json.loads(fa(missing, "json_object")) == {"null": 1, "a": 2}
    listed = A.answer_rows(spark.range(20_000).toDF("i"), ["i"]).orderBy("position").collect()
    assert [json.loads(r["element"]) for r in listed] == list(range(20_000))
    answers = spark.createDataFrame([(2, "q2", '"x"'), (1, "q1", "5")], "task_id int, qid string, answer string")
    assert A.assemble(answers, "json_array").first()["result"] == '[5,"x"]'
    assert json.loads(A.assemble(answers, "json_object").first()["result"]) == {"q1": 5, "q2": "x"}
    assert json.loads(A.assemble(answers, "array_of_strings").first()["result"]) == ["5", '"x"']


def test_format_answer_query_answers_for_every_part_name(spark, tmp_dir):
    from tablework.plans.queries import QUERIES
    parts = [(i, f"name {i // 2}", "Brand#11", "t", "MFGR#1", 1, 1.0) for i in range(10)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_mfgr string, "
                                 "p_size int, p_retailprice double").write.parquet(f"{tmp_dir}/part.parquet")
    got = QUERIES["format_answer"](spark, tmp_dir).collect()
    assert [json.loads(r["answer"]) for r in got] == [{f"name {k}": 2 * k + 0.5 for k in range(5)}]


def test_format_answer_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK_BITS", 2)
    texts = [None, "", '"', "a,b", "]", "\u2028", "\n", *[f"k{i:03d}" for i in range(100)]]
    rows = [(t, None if i % 7 == 3 else float(i)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode()))
    fa = lambda d, f, **kw: json.loads(A.format_answer(d, f, **kw).first()["answer"])
    assert list(fa(df, "json_object").items()) == [("null" if k is None else k, v) for k, v in want]
    assert fa(df.select("k"), "json_array") == [k for k, _ in want]
    assert fa(df, "records") == [{n: x for n, x in zip("kv", r) if x is not None} for r in want]
    assert list(fa(df, "json_object", order_by=["v", "k"]))[-1] == "k099"
    assert fa(df.where("false"), "json_object") == {}


def test_format_answer_equal_keys_are_an_error(spark):
    twice = spark.createDataFrame([(None, 1), ("null", 2), ("a", 3)], "k string, n int")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        A.format_answer(twice, "json_object").collect()


@pytest.mark.parametrize("fmt", ["number", "string", "json_array", "records", "json_object"])
def test_answer_expr_matches_format_answer(spark, fmt):
    one = spark.createDataFrame([("k1", 2.5, 7)], "k string, v double, n bigint")
    for cols in (["v"], ["k", "v"], ["k", "v", "n"]):
        frame = one.select(*cols)
        want = A.format_answer(frame, fmt).first()["answer"]
        got = one.select(A.answer_expr([(c, F.col(c)) for c in cols], fmt).alias("a")).first()["a"]
        assert got == want, (fmt, cols)


def test_string_answer_quotes_like_python(spark):
    want = {'"': "", "''": "", '"a"': "a", "'b'": "b", '"c\'': '"c\'', "plain": "plain", '""x""': '"x"'}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r["t"]: r["str"] for r in RS.parse_answer(df, "t", "string").collect()} == want


def test_grade_with_key_table(spark):
    key = spark.createDataFrame(
        [("films", 0, "is_json", None, None, 2, 0.0), ("films", 0, "equals", "1", None, None, 1.0),
         ("films", 1, "regex", "titanic", None, None, 2.0),
         ("sales", 0, "is_json", None, None, 1, 0.0), ("sales", 0, "within", "137.5", 0.01, None, 1.0)],
        "rubric string, item int, kind string, expected string, tolerance double, n_items int, weight double")
    subs = spark.createDataFrame([("a", "films", '[1, "Titanic"]'), ("b", "films", '[2, "Avatar"]'),
                                  ("c", "sales", "[137.5]"), ("d", "sales", "[1, 2]")],
                                 "submission_id string, rubric string, answer string")
    got = {r["submission_id"]: (r["score"], r["max_score"], r["gate_ok"]) for r in RS.grade(subs, key).collect()}
    assert got == {"a": (3.0, 3.0, True), "b": (0.0, 3.0, True), "c": (1.0, 1.0, True), "d": (0.0, 1.0, False)}


def test_grade_is_typed_and_row_by_row(spark):
    rubric = [{"kind": "is_json", "n_items": 2}, {"item": 0, "kind": "equals", "expected": 1, "weight": 1.0},
              {"item": 1, "kind": "within", "expected": 0.48, "tolerance": 0.01, "weight": 2.0}]
    subs = spark.createDataFrame(
        [("a", "[1, 0.485]"), ("b", '["1", "0.48"]'), ("c", '[1.0, "0.48D"]'), ("d", "[true, null]"),
         ("e", "[1, 0.485, 2]"), ("f", "not json"), ("g", None), ("a", "[2, 9]")],
        "submission_id string, answer string")
    got = sorted((r["submission_id"], r["score"], r["gate_ok"]) for r in RS.grade(subs, rubric).collect())
    assert got == [("a", 0.0, True), ("a", 3.0, True), ("b", 2.0, True), ("c", 1.0, True), ("d", 0.0, True),
                   ("e", 0.0, False), ("f", 0.0, False), ("g", 0.0, False)]


def test_parse_answer_keeps_large_integers(spark):
    df = spark.createDataFrame([("9007199254740993",), ("-1_000",), ("2.5",)], "t string")
    got = {r["t"]: r["int_value"] for r in RS.parse_answer(df, "t", "number").collect()}
    assert got["9007199254740993"] == 9007199254740993 and got["-1_000"] == -1000 and got["2.5"] is None


def test_table_spans_nested_tables_and_style_text():
    from tablework.sources.html import page_tables
    html = ("<table><tr><th>Year</th><th colspan=2>Film</th></tr>"
            "<tr><td rowspan='2'>1997</td><td>A<style>.x{color:red}</style></td><td>1</td></tr>"
            "<tr><td>B</td><td>2</td></tr>"
            "<tr><td>1998</td><td>C<table><tr><td>inner</td></tr></table></td><td>3</td></tr></table>")
    outer, inner = page_tables(html)
    assert [r[1] for r in outer["rows"]] == [["Year", "Film", "Film"], ["1997", "A", "1"], ["1997", "B", "2"],
                                             ["1998", "C", "3"]]
    assert [r[0] for r in outer["rows"]] == [True, False, False, False]
    assert inner["rows"] == [(False, ["inner"], 1)]
    last = page_tables("<table><tr><td>a</td><td rowspan=3>z</td></tr><tr><td>b</td></tr><tr><td>c</td></table>")
    assert [r[1] for r in last[0]["rows"]] == [["a", "z"], ["b", "z"], ["c", "z"]]


ODD_PAGES = ['<table><tr><td rowspan="²">a</td><td>b</td></tr></table>',
             '<table><tr><td rowspan="' + "9" * 5000 + '" colspan="x">a</td><td>b</td></tr></table>',
             "<table><tr><td>a</td><td>b</td></tr></table><![foo[ x ]]><p>behind</p>", "<![", "<!x[<p>", None]


def test_odd_markup_never_ends_a_job(spark):
    df = spark.createDataFrame([(k, h) for k, h in enumerate(ODD_PAGES)], "page_id long, html string")
    rows = {r.page_id: list(r.cells) for r in H.extract_html_tables(df, index=0).collect()}
    assert rows == {0: ["a", "b"], 1: ["a", "b"], 2: ["a", "b"]}
    assert [r.text for r in H.extract_html_elements(df, "td").collect()].count("a") == 3


def test_a_row_span_of_zero_reaches_the_end(spark):
    html = '<table><tr><td rowspan="0">x</td><td>1</td></tr><tr><td>2</td></tr><tr><td>3</td></tr></table>'
    rows = [r["rows"] for r in H.page_tables(html)][0]
    assert [cells for _, cells, _ in rows] == [["x", "1"], ["x", "2"], ["x", "3"]]
