"""Registered queries: one per operator key of the inventory, each reading
the given tables (or data Spark derives from them) in full, each paired
with DuckDB SQL over the same tables where the result is SQL-expressible.

Floating results that come from sums are rounded to 6 decimals on both
sides (summation order differs between engines); every computed column is
aliased to the same name on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.functions.format import data_uri, days_between, fmt_number, json_text, sentence
from tablework.functions.format import within_uri_limit
from tablework.functions.text import MISSING_WORDS, ends_with, replace_all, starts_with
from tablework.operators import answers as A
from tablework.operators import charts as CH
from tablework.operators import cleaning as C
from tablework.operators import date_formats as DF
from tablework.operators import distinct_states as DS
from tablework.operators import layout as LY
from tablework.operators import patterns as PT
from tablework.operators import quality as Q
from tablework.operators import relational as RL
from tablework.operators import responses as RS
from tablework.operators import sketches as SK
from tablework.operators import stats as S
from tablework.plans import fixtures as FX
from tablework.session import scratch_path
from tablework.sources import archives as AR
from tablework.sources import files as FS
from tablework.sources import html as H
from tablework.sources import workbooks as WB

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- shared SQL
# numeric-text guard of coerce_numeric, written for DuckDB
_SQL_NUM = """CASE WHEN regexp_full_match({s}, '[+-]?[0-9]+') THEN TRY_CAST({s} AS BIGINT)
     WHEN regexp_full_match({s}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
     THEN TRY_CAST(trunc(TRY_CAST({s} AS DOUBLE)) AS BIGINT) END"""

_QTY_TEXT_SQL = """CASE WHEN l_returnflag = 'N' THEN ' ' || CAST(l_quantity AS VARCHAR) || chr(9)
            ELSE CAST(l_linenumber AS VARCHAR) || l_linestatus END"""


def _qty_text() -> F.Column:
    """Quantity as text for returned-flag N, a class-code-like '3F' / '3O'
    otherwise (Spark's own cast reads those as 3.0)."""
    return (F.when(F.col("l_returnflag") == "N",
                   F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit("\t")))
            .otherwise(F.concat(F.col("l_linenumber").cast("string"), F.col("l_linestatus"))))


# ------------------------------------------------------ 2.1 sources and sinks
@query("scan_csv", "SELECT * FROM customer")
def q_scan_csv(spark, sf):
    src = table(spark, sf, "customer")
    path = FS.save_table(src, scratch_path(spark, "customer.csv"), "csv")
    return FS.load_table(spark, path, schema=src.schema, null_tokens=MISSING_WORDS)


@query("csv_text_round_trip", "SELECT * FROM documents")
def q_csv_text_round_trip(spark, sf):
    """Texts with quotes, commas and line breaks, written as CSV and read again."""
    src = table(spark, sf, "documents")
    path = FS.save_table(src, scratch_path(spark, "documents.csv"), "csv")
    return FS.load_table(spark, path, schema=src.schema)


@query("csv_split_records", "SELECT * FROM documents")
def q_csv_split_records(spark, sf):
    """Texts with line breaks inside quoted fields, read in byte ranges."""
    src = table(spark, sf, "documents")
    path = FS.save_table(src, scratch_path(spark, "documents_split.csv"), "csv")
    return FS.load_table(spark, path, schema=src.schema, multiline="split")


@query("json_split_records", "SELECT * FROM documents")
def q_json_split_records(spark, sf):
    """Array documents whose objects go over lines, read in byte ranges."""
    src = table(spark, sf, "documents")
    path = FS.save_table(FX.to_json_array(src), scratch_path(spark, "documents_array.json"), "text")
    return FS.load_table(spark, path, "json", schema=src.schema, multiline="split")


_MALFORMED_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("scan_malformed", f"""SELECT {', '.join(_MALFORMED_COLS)}, o_orderpriority = '1-URGENT' AS malformed
FROM orders""")
def q_scan_malformed(spark, sf):
    o = table(spark, sf, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    line = FX.csv_line([iso if c == "o_orderdate" else c for c in _MALFORMED_COLS])
    raw = o.select(F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(line, F.lit(",EXTRA")))
                   .otherwise(line).alias("value"))
    path = FS.save_table(raw, scratch_path(spark, "orders_raw.csv"), "text")
    schema = o.select(*_MALFORMED_COLS).schema
    return FS.load_csv_flagged(spark, path, schema, header=False).drop(FS.CORRUPT_COLUMN)


@query("scan_json", "SELECT * FROM events")
def q_scan_json(spark, sf):
    src = table(spark, sf, "events")
    path = FS.save_table(src, scratch_path(spark, "events.json"), "json")
    return FS.load_table(spark, path, schema=src.schema)


@query("scan_parquet", """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice
FROM lineitem WHERE l_quantity > 25""")
def q_scan_parquet(spark, sf):
    return FS.load_table(spark, f"{sf.rstrip('/')}/lineitem.parquet",
                         columns=["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"],
                         where="l_quantity > 25")


@query("scan_partitioned", """SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year,
       o_orderpriority
FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998""")
def q_scan_partitioned(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    root = FS.save_table(o, scratch_path(spark, "orders_by_year"), "parquet",
                         partition_by=["year", "o_orderpriority"])
    return FS.load_table(spark, root, "parquet", where="year BETWEEN 1996 AND 1998",
                         columns=["o_orderkey", "o_totalprice", "year", "o_orderpriority"])


@query("scan_by_extension", "SELECT * FROM nation")
def q_scan_by_extension(spark, sf):
    src = table(spark, sf, "nation")
    path = FS.save_table(src, scratch_path(spark, "nation.tsv"), "tsv")
    return FS.load_table(spark, path, schema=src.schema)          # kind from ".tsv"


@query("scan_workbooks", "SELECT * FROM supplier")
def q_scan_workbooks(spark, sf):
    src = table(spark, sf, "supplier")
    books = FX.to_workbooks(src, rows_per_book=40)
    out = WB.workbooks_to_table(books, schema=src.schema)
    return out.select(*src.columns)


@query("scan_archives", "SELECT * FROM part")
def q_scan_archives(spark, sf):
    src = table(spark, sf, "part")
    files = (FX.to_archives(src.where(F.col("p_size") <= 25), "zip", rows_per_member=200)
             .unionByName(FX.to_archives(src.where(F.col("p_size") > 25), "tar.gz", rows_per_member=200)))
    lines = AR.parse_archive_lines(files, "*.csv")
    return AR.archive_lines_to_csv(lines, src.schema)


@query("html_tables", "SELECT * FROM customer")
def q_html_tables(spark, sf):
    src = table(spark, sf, "customer")
    pages = FX.to_pages(src, rows_per_page=50)
    rows = H.extract_html_tables(pages, css_class="wikitable", index=0)
    return C.rows_to_table(rows, ["page_id", "table_idx"], schema=src.schema).select(*src.columns)


@query("html_select", """SELECT page_id, regexp_extract(m, 'href="([^"]*)"', 1) AS href,
       regexp_extract(m, '>([^<]*)</a>', 1) AS text
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS m
      FROM pages)""")
def q_html_select(spark, sf):
    pages = table(spark, sf, "pages")
    el = H.extract_html_elements(pages, "a", attr="href", parent="li")
    return el.select("page_id", F.col("attr").alias("href"), "text")


_URL_SQL = """WITH u AS (
  SELECT page_id, unnest(regexp_extract_all(url || ' ' || html,
         '(https?://\\S+|ftp://\\S+|gs://\\S+|s3://\\S+)', 1)) AS url FROM pages),
p AS (SELECT page_id, url,
        lower(regexp_extract(url, '^[a-zA-Z0-9+.-]+://[^/?#]*([^?#]*)', 1)) AS path,
        lower(regexp_extract(url, '^[a-zA-Z0-9+.-]+://([^/?#:]*)', 1)) AS host FROM u)
SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z0-9+.-]+)://', 1)) AS scheme, host,
  CASE WHEN regexp_matches(url, '^(s3|gs)://') THEN 'object_store'
       WHEN starts_with(url, 'ftp://') THEN 'ftp'
       WHEN regexp_extract(path, '\\.([a-z0-9]+)$', 1) IN ('db','sqlite','sqlite3','duckdb') THEN 'database'
       WHEN regexp_extract(path, '\\.([a-z0-9]+)$', 1) IN ('csv','tsv','txt','json','parquet','orc',
            'xlsx','xls','zip','gz','tar','pdf','feather') THEN 'file'
       WHEN regexp_matches(path, '(^|/)api(/|$)') OR starts_with(host, 'api.') THEN 'api'
       ELSE 'html' END AS kind
FROM p"""


@query("url_harvest", _URL_SQL)
def q_url_harvest(spark, sf):
    pages = table(spark, sf, "pages")
    text = pages.select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return H.harvest_urls(text, "text", keep=["page_id"])


@query("filtered_view", "SELECT * FROM orders WHERE o_totalprice > 400000")
def q_filtered_view(spark, sf):
    FS.register_view(table(spark, sf, "orders"), "tw_orders_over_400k", where="o_totalprice > 400000")
    return spark.table("tw_orders_over_400k")


@query("sql_query", """SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 6) AS avg_price
FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus""")
def q_sql_query(spark, sf):
    FS.register_view(table(spark, sf, "orders"), "tw_orders")
    return FS.run_sql(spark, """SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 6) AS avg_price
                                FROM tw_orders WHERE o_totalprice > :lo GROUP BY o_orderstatus""",
                      {"lo": 100000})


@query("load_many", """SELECT 0 AS position, 'orders' AS name, 'ok' AS status, 6 AS n_columns,
       (SELECT count(*) FROM orders) AS n_rows
UNION ALL SELECT 1, 'lineitem', 'ok', 11, (SELECT count(*) FROM lineitem)
UNION ALL SELECT 2, 'missing', 'error', NULL, NULL""")
def q_load_many(spark, sf):
    base = sf.rstrip("/")
    specs = [{"name": "orders", "path": f"{base}/orders.parquet"},
             {"name": "lineitem", "path": f"{base}/lineitem.parquet"},
             {"name": "missing", "path": f"{base}/no_such_table.parquet"}]
    frames, report = FS.load_tables(spark, specs)
    counts = None
    for name, df in frames.items():
        c = df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"))
        counts = c if counts is None else counts.unionByName(c)
    return (report.join(counts, "name", "left")
            .select("position", "name", "status", "n_columns", "n_rows"))


@query("sink_parquet", "SELECT * FROM lineitem")
def q_sink_parquet(spark, sf):
    src = table(spark, sf, "lineitem")
    path = FS.save_table(src, scratch_path(spark, "lineitem.parquet"), "parquet",
                         partition_by=["l_returnflag"])
    return FS.load_table(spark, path)


@query("sink_csv", "SELECT * FROM orders")
def q_sink_csv(spark, sf):
    src = table(spark, sf, "orders")
    path = FS.save_table(src, scratch_path(spark, "orders.csv"), "csv")
    return FS.load_table(spark, path, schema=src.schema)


@query("sink_json", "SELECT * FROM conversations")
def q_sink_json(spark, sf):
    src = table(spark, sf, "conversations")
    path = FS.save_table(src, scratch_path(spark, "conversations.json.gz"), "json", compression="gzip")
    return FS.load_table(spark, path, "json", schema=src.schema)


# ------------------------------------------------- 2.2 cleaning, projection
@query("coerce_numeric", f"""SELECT l_orderkey, l_linenumber, qty FROM (
  SELECT l_orderkey, l_linenumber, {_SQL_NUM.format(s="s")} AS qty
  FROM (SELECT l_orderkey, l_linenumber, trim({_QTY_TEXT_SQL}, ' ' || chr(9)) AS s FROM lineitem))
WHERE qty IS NOT NULL""")
def q_coerce_numeric(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _qty_text().alias("qty"))
    return C.coerce_numeric(li, "qty", "bigint", on_error="drop")


@query("parse_currency", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def q_parse_currency(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("$"), F.format_number(F.round(F.col("o_totalprice") * 100), 0)).alias("cents"))
    return C.parse_currency(o, "cents")


@query("cast_columns", "SELECT * FROM lineitem")
def q_cast_columns(spark, sf):
    src = table(spark, sf, "lineitem")
    as_text = src.select(*[F.col(c).cast("string").alias(c) for c in src.columns])
    return C.apply_schema(as_text, src.schema, on_mismatch="null")


@query("strip_whitespace", "SELECT c_custkey, c_name FROM customer")
def q_strip_whitespace(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit(" \t "), F.col("c_name"), F.lit(" \n ")).alias("c_name"))
    return C.strip_whitespace(c, ["c_name"])


def _status_with_missing(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit("nan"))
                    .otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@query("null_literals", "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus FROM orders")
def q_null_literals(spark, sf):
    return C.null_literals(_status_with_missing(spark, sf), ["o_orderstatus"])


@query("drop_missing", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def q_drop_missing(spark, sf):
    return C.drop_missing(C.null_literals(_status_with_missing(spark, sf), ["o_orderstatus"]),
                          ["o_orderstatus"])


@query("drop_duplicates", """SELECT DISTINCT * FROM (
  SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_quantity > 25)""")
def q_drop_duplicates(spark, sf):
    li = table(spark, sf, "lineitem")
    return C.drop_duplicates(li.unionByName(li.where("l_quantity > 25")))


@query("clean_report", f"""WITH t AS (
  SELECT {_SQL_NUM.format(s="s")} AS qty, l_returnflag, l_linestatus
  FROM (SELECT trim({_QTY_TEXT_SQL}, ' ' || chr(9)) AS s, l_returnflag, l_linestatus FROM lineitem)),
k AS (SELECT * FROM t WHERE qty IS NOT NULL)
SELECT 0 AS position, 'loaded' AS step, count(*) AS rows FROM t
UNION ALL SELECT 1, 'dropped: invalid qty', count(*) FROM t WHERE qty IS NULL
UNION ALL SELECT 2, 'dropped: duplicate',
  (SELECT count(*) FROM k) - (SELECT count(*) FROM (SELECT DISTINCT * FROM k))
UNION ALL SELECT 3, 'final', (SELECT count(*) FROM (SELECT DISTINCT * FROM k))""")
def q_clean_report(spark, sf):
    li = table(spark, sf, "lineitem").select(_qty_text().alias("qty"), "l_returnflag", "l_linestatus")
    _, report = C.clean_table(li, numeric={"qty": "bigint"}, dedupe=True)
    return report


@query("project", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def q_project(spark, sf):
    return C.project(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_quantity"])


@query("filter_and", """SELECT * FROM orders
WHERE o_totalprice > 400000 AND year(o_orderdate) < 1998""")
def q_filter_and(spark, sf):
    return C.filter_and(table(spark, sf, "orders"), F.col("o_totalprice") > 400000,
                        F.year("o_orderdate") < 1998)


@query("parse_dates", """SELECT o_orderkey,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS decision_date
FROM orders""")
def q_parse_dates(spark, sf):
    o = table(spark, sf, "orders")
    text = F.date_format("o_orderdate", "dd-MM-yyyy")
    raw = o.select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(text, F.lit("x")))
                   .otherwise(text).alias("decision_date"))
    return C.parse_dates(raw, {"decision_date": "dd-MM-yyyy"})


@query("flatten_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def q_flatten_json(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "props")
    return C.flatten(ev, json_columns={"props": "k BIGINT"})


@query("flatten_json_inferred", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def q_flatten_json_inferred(spark, sf):
    """The same records, their schema told from the data."""
    return C.flatten(table(spark, sf, "events").select("event_id", "props"), json_columns=["props"])


@query("flatten_json_nested", """SELECT o_orderkey AS rec_key, o_custkey AS rec_who_cust, o_orderstatus AS rec_who_status,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' END AS rec_note, x.no::BIGINT AS rec_lines_no, x.price AS rec_lines_price
FROM orders, LATERAL (SELECT unnest([1, 2]) AS no, unnest([o_totalprice, 0.5]) AS price) x""")
def q_flatten_json_nested(spark, sf):
    """Records in records and in lists, some keys only here and there, no schema given."""
    line = lambda no, price: F.struct(F.lit(no).alias("no"), price.alias("price"))
    rec = F.struct(
        F.col("o_orderkey").alias("key"), F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))
        .alias("who"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("now")).alias("note"),
        F.array(line(1, F.col("o_totalprice")), line(2, F.lit(0.5))).alias("lines"))
    out = C.flatten(table(spark, sf, "orders").select(F.to_json(rec).alias("rec")), json_columns=["rec"])
    return out.select("rec_key", "rec_who_cust", "rec_who_status", "rec_note", "rec_lines_no", "rec_lines_price")


# ------------------------------------------------- 2.3 validation, profiling
@query("validate", f"""SELECT *, violations = 0 AS passed FROM (
SELECT 0 AS position, 'required' AS rule, 'o_orderkey' AS "column", 0::BIGINT AS violations
UNION ALL SELECT 1, 'required', 'o_custkey', 0
UNION ALL SELECT 2, 'required', 'o_comment', 1
UNION ALL SELECT 3, 'type', 'o_orderpriority',
  count(*) FILTER (WHERE o_orderpriority IS NOT NULL AND ({_SQL_NUM.format(s="trim(o_orderpriority)")}) IS NULL)
  FROM orders
UNION ALL SELECT 4, 'not_null', 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL) FROM orders
UNION ALL SELECT 5, 'non_empty', NULL, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM orders
UNION ALL SELECT 6, 'unique', 'o_custkey,o_orderdate',
  CAST(COALESCE(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT)
  FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate))""")
def q_validate(spark, sf):
    rules = {"required": ["o_orderkey", "o_custkey", "o_comment"],
             "types": {"o_orderpriority": "int"}, "not_null": ["o_custkey"],
             "non_empty": True, "unique": [["o_custkey", "o_orderdate"]]}
    return Q.validate(table(spark, sf, "orders"), rules)


def _profile_sql() -> str:
    cols = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
            ("c_acctbal", "double"), ("c_mktsegment", "string")]
    parts = []
    for i, (c, t) in enumerate(cols):
        parts.append(f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype, count(*) AS n_rows,
  count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct,
  CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM customer""")
    return "\nUNION ALL ".join(parts)


@query("profile_columns", _profile_sql())
def q_profile_columns(spark, sf):
    return Q.profile(table(spark, sf, "customer"), exact_distinct=True)


_LINEITEM_RANGES = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]


@query("profile_states", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, "
    f"min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value FROM lineitem"
    for i, c in enumerate(_LINEITEM_RANGES)))
def q_profile_states(spark, sf):
    """Profile of the line items from states stored per year and merged."""
    li = table(spark, sf, "lineitem")
    states = SK.profile_states(li, F.year("l_shipdate"), _LINEITEM_RANGES)
    path = FS.save_table(states, scratch_path(spark, "lineitem_states"))
    profile = SK.profile_of(SK.merge_states(FS.load_table(spark, path, "parquet")))
    return profile.select("position", "column", "n_rows", "n_null", "min_value", "max_value")


_DATE_TEXT_SQL = """CASE WHEN o_orderpriority = '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d')
            ELSE strftime(o_orderdate, '%d-%m-%Y') END"""




def _mixed_dates(spark, sf) -> DataFrame:
    """Order dates as text, written in five ways."""
    ways = {"1-URGENT": "dd-MM-yyyy", "2-HIGH": "MM/dd/yyyy", "3-MEDIUM": "dd MMMM yyyy", "5-LOW": "yyyyMMdd"}
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")
    for priority, fmt in ways.items():
        text = F.when(F.col("o_orderpriority") == priority, F.date_format("o_orderdate", fmt)).otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", text.alias("written"))


@query("induce_date_formats", """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'dd-MM-yyyy'
    WHEN '2-HIGH' THEN 'MM/dd/yyyy' WHEN '3-MEDIUM' THEN 'dd MMMM yyyy' WHEN '5-LOW' THEN 'yyyyMMdd'
    ELSE 'yyyy-MM-dd''T''HH:mm' END AS format, count(*) AS n_rows, false AS ambiguous FROM orders GROUP BY 1""")
def q_induce_date_formats(spark, sf):
    """Five formats, told from the values."""
    found = DF.induce_date_formats(_mixed_dates(spark, sf), "written")
    return found.groupBy("format").agg(F.sum("n_rows").alias("n_rows"), F.max("ambiguous").alias("ambiguous"))


@query("parse_induced_dates", "SELECT o_orderkey, date_trunc('minute', o_orderdate)::TIMESTAMP AS written FROM orders")
def q_parse_induced_dates(spark, sf):
    """The mixed column parsed by the formats that were told from it."""
    mixed = _mixed_dates(spark, sf)
    return DF.parse_induced(mixed, "written", DF.induce_date_formats(mixed, "written"))


@query("infer_date_format", f"""WITH t AS (SELECT {_DATE_TEXT_SQL} AS s FROM orders),
a AS (SELECT count(*) FILTER (WHERE s IS NOT NULL AND s <> '') AS n,
  count(*) FILTER (WHERE try_strptime(s, '%Y-%m-%d') IS NOT NULL) AS f0,
  count(*) FILTER (WHERE try_strptime(s, '%d-%m-%Y') IS NOT NULL) AS f1,
  count(*) FILTER (WHERE try_strptime(s, '%m/%d/%Y') IS NOT NULL) AS f2 FROM t)
SELECT 0 AS position, 'yyyy-MM-dd' AS format, f0 AS n_parsed, n AS n_values, round(f0 / n, 6) AS share FROM a
UNION ALL SELECT 1, 'dd-MM-yyyy', f1, n, round(f1 / n, 6) FROM a
UNION ALL SELECT 2, 'MM/dd/yyyy', f2, n, round(f2 / n, 6) FROM a""")
def q_infer_date_format(spark, sf):
    o = table(spark, sf, "orders")
    text = (F.when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "yyyy-MM-dd"))
            .otherwise(F.date_format("o_orderdate", "dd-MM-yyyy")))
    out = Q.infer_date_format(o.select(text.alias("s")), "s", ["yyyy-MM-dd", "dd-MM-yyyy", "MM/dd/yyyy"])
    return out.withColumn("share", r6("share"))


@query("sample_rows", """SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 100""")
def q_sample_rows(spark, sf):
    return Q.sample_rows(table(spark, sf, "lineitem"), 100, ["l_orderkey", "l_linenumber"])


# -------------------------------------------------------- 2.4 aggregations
@query("row_count", "SELECT count(*) AS n_rows FROM lineitem")
def q_row_count(spark, sf):
    return S.row_count(table(spark, sf, "lineitem"))


@query("filtered_count", """SELECT count(*) AS n_rows FROM orders
WHERE o_totalprice > 400000 AND year(o_orderdate) < 1998""")
def q_filtered_count(spark, sf):
    return S.filtered_count(table(spark, sf, "orders"),
                            (F.col("o_totalprice") > 400000) & (F.year("o_orderdate") < 1998))


@query("count_distinct", "SELECT count(DISTINCT p_name) AS n_distinct FROM part")
def q_count_distinct(spark, sf):
    return S.count_distinct(table(spark, sf, "part"), "p_name")


_DISTINCT_OF = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]


@query("distinct_states", " UNION ALL ".join(
    f"""SELECT {part} AS part, '{c}' AS "column", count(DISTINCT {c}) AS n_distinct FROM lineitem {group}"""
    for c in _DISTINCT_OF for part, group in (("'all'", ""), ("CAST(year(l_shipdate) AS VARCHAR)", "GROUP BY 1"))))
def q_distinct_states(spark, sf):
    """Exact distincts per ship year and in all, the latter from the years' stored states."""
    li = table(spark, sf, "lineitem")
    path = FS.save_table(DS.distinct_states(li, _DISTINCT_OF, F.year("l_shipdate")), scratch_path(spark, "distincts"))
    years = spark.read.parquet(path)
    return DS.distinct_counts(years).unionByName(DS.distinct_counts(DS.merge_distinct(years)))


@query("distinct_in_one_pass", " UNION ALL ".join(
    f"""SELECT 'all' AS part, '{c}' AS "column", count(DISTINCT {c}) AS n_distinct FROM lineitem"""
    for c in _DISTINCT_OF))
def q_distinct_in_one_pass(spark, sf):
    return DS.distinct_counts(DS.distinct_states(table(spark, sf, "lineitem"), _DISTINCT_OF))


@query("global_mean", "SELECT round(avg(l_extendedprice), 6) AS mean FROM lineitem")
def q_global_mean(spark, sf):
    return S.global_mean(table(spark, sf, "lineitem"), "l_extendedprice").select(r6("mean").alias("mean"))


@query("min_max", "SELECT min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value FROM lineitem")
def q_min_max(spark, sf):
    return S.min_max(table(spark, sf, "lineitem"), "l_extendedprice")


@query("group_count", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name")
def q_group_count(spark, sf):
    return S.group_counts(table(spark, sf, "part"), "p_name")


@query("group_mean", "SELECT p_name, round(avg(p_partkey), 6) AS mean FROM part GROUP BY p_name")
def q_group_mean(spark, sf):
    return S.group_mean(table(spark, sf, "part"), "p_name", "p_partkey").withColumn("mean", r6("mean"))


@query("top_group", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 1")
def q_top_group(spark, sf):
    return S.top_groups(table(spark, sf, "part"), "p_name", 1)


@query("top_group_bounded", """SELECT l_partkey, count(*) AS n FROM lineitem
    GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10""")
def q_top_group_bounded(spark, sf):
    return S.top_groups_bounded(table(spark, sf, "lineitem"), "l_partkey", 10)


@query("top_group_in_range", """SELECT o_custkey, count(*) AS n FROM orders
WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 1""")
def q_top_group_in_range(spark, sf):
    o = table(spark, sf, "orders").where(F.year("o_orderdate").between(1996, 1998))
    return S.top_groups(o, "o_custkey", 1)


@query("having_count", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 1")
def q_having_count(spark, sf):
    return S.groups_with_count(table(spark, sf, "orders"), "o_custkey", 1)


@query("size_histogram", """SELECT n AS group_size, count(*) AS n_groups
FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) GROUP BY n""")
def q_size_histogram(spark, sf):
    return S.group_size_histogram(table(spark, sf, "part"), "p_name")


@query("size_describe", """SELECT count(*) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std,
  CAST(min(n) AS DOUBLE) AS min, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50,
  quantile_cont(n, 0.75) AS p75, CAST(max(n) AS DOUBLE) AS max
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)""")
def q_size_describe(spark, sf):
    d = S.describe_group_sizes(table(spark, sf, "orders"), "o_custkey")
    return d.withColumn("mean", r6("mean")).withColumn("std", r6("std"))


_NAME_PATTERNS = {"starts_blue": ("blue", None), "ends_gear": (None, "gear")}


@query("pattern_rows", """SELECT count(*) FILTER (WHERE starts_with(p_name, 'blue')) AS starts_blue,
  count(*) FILTER (WHERE ends_with(p_name, 'gear')) AS ends_gear FROM part""")
def q_pattern_rows(spark, sf):
    return S.pattern_counts(table(spark, sf, "part"), "p_name", _NAME_PATTERNS, per="row")


@query("pattern_keys", """SELECT count(DISTINCT CASE WHEN starts_with(p_name, 'blue') THEN p_name END) AS starts_blue,
  count(DISTINCT CASE WHEN ends_with(p_name, 'gear') THEN p_name END) AS ends_gear FROM part""")
def q_pattern_keys(spark, sf):
    return S.pattern_counts(table(spark, sf, "part"), "p_name", _NAME_PATTERNS, per="key")


@query("pattern_discovery", """WITH k AS (SELECT p_brand AS key, count(*) AS n FROM part
                                          WHERE p_brand IS NOT NULL GROUP BY p_brand),
e AS (SELECT 'first_char' AS kind, left(key, 1) AS pattern, n FROM k
      UNION ALL SELECT 'last_char', right(key, 1), n FROM k
      UNION ALL SELECT 'shape', regexp_replace(regexp_replace(key, '[0-9]', '9', 'g'), '\\p{L}', 'A', 'g'), n FROM k)
SELECT kind, pattern, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys FROM e GROUP BY kind, pattern""")
def q_pattern_discovery(spark, sf):
    return S.discover_patterns(table(spark, sf, "part"), "p_brand")


@query("pattern_growth", """WITH v AS (SELECT p_name AS t, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1),
total AS (SELECT sum(n) AS all_rows FROM v),
e AS (SELECT 'prefix' AS kind, left(t, k) AS pattern, n FROM v, LATERAL (SELECT unnest(range(1, length(t) + 1)) AS k)
  UNION ALL SELECT 'suffix', right(t, k), n FROM v, LATERAL (SELECT unnest(range(1, length(t) + 1)) AS k)),
c AS (SELECT kind, pattern, sum(n)::BIGINT AS n_rows, count(*) AS n_keys FROM e GROUP BY 1, 2),
f AS (SELECT c.* FROM c, total WHERE n_rows >= 0.01::DOUBLE * all_rows),
longer AS (SELECT kind, CASE kind WHEN 'prefix' THEN left(pattern, length(pattern) - 1)
    ELSE right(pattern, length(pattern) - 1) END AS pattern, max(n_rows) AS most FROM c GROUP BY 1, 2)
SELECT kind, pattern, n_rows, n_keys, coalesce(most < n_rows, true) AS closed FROM f LEFT JOIN longer USING (kind, pattern)""")
def q_pattern_growth(spark, sf):
    """All prefixes and suffixes that one in a hundred part names have."""
    return PT.frequent_affixes(table(spark, sf, "part"), "p_name", 0.01)


@query("percentage", """SELECT round(COALESCE(100.0 * count(*) FILTER (WHERE starts_with(p_name, 'blue'))
  / NULLIF(count(*), 0), 0), 6) AS pct FROM part""")
def q_percentage(spark, sf):
    return S.percentage(table(spark, sf, "part"), starts_with("p_name", "blue")).select(r6("pct").alias("pct"))


@query("correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem")
def q_correlation(spark, sf):
    return S.correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(r6("corr").alias("corr"))


@query("regression", """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
  CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n
FROM lineitem GROUP BY l_returnflag""")
def q_regression(spark, sf):
    r = S.regression(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", by="l_returnflag")
    return r.select("l_returnflag", r6("slope").alias("slope"), r6("intercept").alias("intercept"),
                    r6("r2").alias("r2"), "n")


@query("delay_trend", """WITH d AS (
  SELECT CAST(year(o_orderdate) AS DOUBLE) AS year,
         CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS delay
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
y AS (SELECT year, avg(delay) AS avg_delay FROM d GROUP BY year)
SELECT 'row_level' AS method, round(regr_slope(delay, year), 6) AS slope,
       round(regr_intercept(delay, year), 6) AS intercept FROM d
UNION ALL SELECT 'of_year_means', round(regr_slope(avg_delay, year), 6),
       round(regr_intercept(avg_delay, year), 6) FROM y""")
def q_delay_trend(spark, sf):
    j = RL.join_tables(table(spark, sf, "lineitem"),
                       table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey"),
                       "l_orderkey")
    summary, _ = S.delay_trend(j, "o_orderdate", "l_shipdate")
    return summary.select("method", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("independence_test", """WITH p AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o
                                          FROM orders GROUP BY 1, 2),
ra AS (SELECT a, sum(o) AS ra FROM p GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM p GROUP BY b),
s AS (SELECT CAST(sum(o) AS DOUBLE) AS n, sum(CAST(o AS DOUBLE) * o / (ra * cb)) AS s,
             count(DISTINCT a) AS ka, count(DISTINCT b) AS kb
      FROM p JOIN ra USING (a) JOIN cb USING (b))
SELECT round(n * s - n, 6) AS statistic, CAST((ka - 1) * (kb - 1) AS BIGINT) AS dof, CAST(n AS BIGINT) AS n FROM s""")
def q_independence_test(spark, sf):
    t = S.chi_square(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", with_p_value=False)
    return t.withColumn("statistic", r6("statistic"))


@query("fit_groups", """WITH m AS (
  SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_extendedprice) AS mp,
    var_pop(l_quantity) AS qq, var_pop(l_discount) AS dd, var_pop(l_extendedprice) AS pp,
    covar_pop(l_quantity, l_discount) AS qd, covar_pop(l_quantity, l_extendedprice) AS qp,
    covar_pop(l_discount, l_extendedprice) AS dp FROM lineitem GROUP BY l_returnflag),
b AS (SELECT *, (qp * dd - dp * qd) / (qq * dd - qd * qd) AS b1, (dp * qq - qp * qd) / (qq * dd - qd * qd) AS b2 FROM m)
SELECT l_returnflag, n, round(mp - b1 * mq - b2 * md, 4) AS intercept, round(b1, 4) AS per_quantity,
  round(b2, 4) AS per_discount, round((b1 * qp + b2 * dp) / pp, 6) AS r2 FROM b""")
def q_fit_groups(spark, sf):
    """Price by quantity and discount, a model per return flag, in one pass."""
    fit = S.fit_groups(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", ["l_returnflag"])
    return fit.select("l_returnflag", "n", F.round("intercept", 4).alias("intercept"),
                      F.round(F.col("coefficients")[0], 4).alias("per_quantity"),
                      F.round(F.col("coefficients")[1], 4).alias("per_discount"), r6("r2").alias("r2"))


@query("linear_model", """WITH t AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d,
         CAST(l_extendedprice AS DOUBLE) AS p FROM lineitem
  WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_extendedprice IS NOT NULL),
m AS (SELECT avg(q) AS mq, avg(d) AS md, avg(p) AS mp, var_pop(q) AS qq, var_pop(d) AS dd,
        covar_pop(q, d) AS qd, covar_pop(q, p) AS qp, covar_pop(d, p) AS dp FROM t),
b AS (SELECT mq, md, mp, (qp * dd - dp * qd) / (qq * dd - qd * qd) AS b1,
        (dp * qq - qp * qd) / (qq * dd - qd * qd) AS b2 FROM m)
SELECT l_orderkey, l_linenumber, q AS l_quantity, d AS l_discount, p AS l_extendedprice,
  round(mp + b1 * (q - mq) + b2 * (d - md), 2) AS prediction FROM t, b""")
def q_linear_model(spark, sf):
    li = table(spark, sf, "lineitem")
    _, scored, _ = S.fit_linear(li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                          "l_extendedprice"),
                                ["l_quantity", "l_discount"], "l_extendedprice")
    return scored.withColumn("prediction", F.round("prediction", 2))


# ------------------------------------------------- 2.5 joins, sorts, answers
@query("join_sources", """SELECT l_orderkey, l_linenumber, o_custkey, c_mktsegment
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def q_join_sources(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return RL.join_tables(RL.join_tables(li, o, "l_orderkey"), c, "o_custkey")


_SKEWED_SQL = """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_partkey END AS p_partkey FROM lineitem"""


def _skewed_lineitem(spark, sf) -> DataFrame:
    """Line items of which a third names one part."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_orderkey") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("l_partkey")).alias("p_partkey"))


@query("join_skewed", f"""SELECT p_partkey, l_orderkey, l_linenumber, p_name, p_brand
FROM ({_SKEWED_SQL}) LEFT JOIN part USING (p_partkey)""")
def q_join_skewed(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return RL.skew_join(_skewed_lineitem(spark, sf), parts, "p_partkey", "left")


@query("join_bucketed", f"""SELECT p_partkey, l_orderkey, l_linenumber, p_name, p_brand
FROM ({_SKEWED_SQL}) LEFT JOIN part USING (p_partkey)""")
def q_join_bucketed(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    items = LY.save_bucketed(_skewed_lineitem(spark, sf), "items_by_part", "p_partkey", 16)
    return LY.join_bucketed(spark, items, LY.save_bucketed(parts, "parts_by_key", "p_partkey", 16), "left")


@query("join_pruned", """SELECT n_name, count(*) AS n_customers, round(sum(c_acctbal), 4) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'EUROPE' GROUP BY n_name""")
def q_join_pruned(spark, sf):
    """Customers stored by nation, joined with the nations of one region: the
    partitions to read are known from the filtered side (dynamic pruning)."""
    root = FS.save_table(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey"),
                         scratch_path(spark, "customer_by_nation"), "parquet", partition_by=["c_nationkey"])
    region = table(spark, sf, "region").where("r_name = 'EUROPE'").select(F.col("r_regionkey").alias("n_regionkey"))
    nations = RL.join_tables(table(spark, sf, "nation"), region, "n_regionkey", "left_semi")
    nations = nations.select(F.col("n_nationkey").cast("int").alias("c_nationkey"), "n_name")
    joined = RL.join_tables(FS.load_table(spark, root, "parquet"), nations, "c_nationkey")
    return joined.groupBy("n_name").agg(F.count("*").alias("n_customers"),
                                        F.round(F.sum("c_acctbal"), 4).alias("balance"))


@query("first_by", """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_totalprice > 450000
ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def q_first_by(spark, sf):
    return RL.first_by(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"],
                       where=F.col("o_totalprice") > 450000,
                       columns=["o_orderkey", "o_orderdate", "o_totalprice"])


@query("sort_by_key", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY p_brand")
def q_sort_by_key(spark, sf):
    return RL.sort_by_key(S.group_counts(table(spark, sf, "part"), "p_brand"), ["p_brand"])


_ANSWERS_SQL = """SELECT 1 AS task_id, 'q1' AS qid, 'number' AS output_format,
       CAST(count(DISTINCT p_name) AS VARCHAR) AS answer FROM part
UNION ALL SELECT 2, 'q2', 'string', CAST(to_json(p_name) AS VARCHAR)
FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 1)"""


def _two_answers(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    a1 = A.format_answer(S.count_distinct(part, "p_name"), "number")
    a2 = A.format_answer(S.top_groups(part, "p_name").select("p_name"), "string")
    frames = [a.select(F.lit(i + 1).alias("task_id"), F.lit(f"q{i + 1}").alias("qid"), "output_format", "answer")
              for i, a in enumerate([a1, a2])]
    return RL.order_answers(frames)


@query("order_answers", _ANSWERS_SQL)
def q_order_answers(spark, sf):
    return _two_answers(spark, sf)


# ------------------------------------------------- 2.6 scalar expressions
@query("str_prefix_suffix", """SELECT p_partkey, COALESCE(starts_with(p_name, 'blue'), false) AS starts_blue,
  COALESCE(ends_with(p_name, 'gear'), false) AS ends_gear FROM part""")
def q_str_prefix_suffix(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", starts_with("p_name", "blue").alias("starts_blue"),
                    ends_with("p_name", "gear").alias("ends_gear"))


@query("str_replace", "SELECT p_partkey, replace(p_brand, 'Brand#', 'B-') AS brand_code FROM part")
def q_str_replace(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", replace_all("p_brand", [("Brand#", "B-")]).alias("brand_code"))


@query("fmt_number", """SELECT p_partkey, printf('%.2f', p_retailprice) AS price_text,
  printf('%.2f%%', p_size * 2.0) AS size_pct FROM part""")
def q_fmt_number(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", fmt_number("p_retailprice", 2).alias("price_text"),
                    fmt_number(F.col("p_size") * 2.0, 2, percent=True).alias("size_pct"))


@query("sentence", "SELECT p_brand, printf('Brand %s has %d parts', p_brand, count(*)) AS sentence FROM part GROUP BY p_brand")
def q_sentence(spark, sf):
    g = S.group_counts(table(spark, sf, "part"), "p_brand")
    return g.select("p_brand", sentence("Brand %s has %d parts", "p_brand", "n").alias("sentence"))


@query("json_text", """SELECT p_brand, CAST(to_json({'brand': p_brand, 'n': count(*)}) AS VARCHAR) AS json
FROM part GROUP BY p_brand""")
def q_json_text(spark, sf):
    g = S.group_counts(table(spark, sf, "part"), "p_brand")
    return g.select("p_brand", json_text("p_brand", "n", names=["brand", "n"]).alias("json"))


@query("data_uri", """SELECT p_partkey, 'data:text/plain;base64,' || to_base64(encode(p_name)) AS uri,
  length('data:text/plain;base64,' || to_base64(encode(p_name))) < 100000 AS fits FROM part""")
def q_data_uri(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", data_uri(F.encode("p_name", "UTF-8"), "text/plain").alias("uri"))
    return p.withColumn("fits", within_uri_limit("uri"))


@query("date_diff", """SELECT l_orderkey, l_linenumber,
  date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q_date_diff(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    j = RL.join_tables(li, o, "l_orderkey")
    return j.select("l_orderkey", "l_linenumber", days_between("l_shipdate", "o_orderdate").cast("bigint").alias("days"))


# -------------------------------------------------------- 2.7 chart series
@query("bar_series", """WITH c AS (SELECT p_brand AS category, count(*) AS n FROM part GROUP BY p_brand),
t AS (SELECT * FROM c ORDER BY n DESC, category LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY n DESC, category) - 1 AS INTEGER) AS position, category, n FROM t
UNION ALL SELECT 10, 'other', CAST((SELECT sum(n) FROM c) - (SELECT sum(n) FROM t) AS BIGINT)
WHERE (SELECT sum(n) FROM c) - (SELECT sum(n) FROM t) > 0""")
def q_bar_series(spark, sf):
    return CH.bar_series(table(spark, sf, "part"), "p_brand", order="count", max_bars=10)


@query("bar_series_bounded", """WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS category, count(*) AS n FROM orders GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS place FROM g),
    b AS (SELECT 0 AS rest, category, n FROM r WHERE place <= 15
          UNION ALL SELECT 1, 'other', CAST(sum(n) AS BIGINT) FROM r WHERE place > 15 HAVING sum(n) > 0)
    SELECT CAST(row_number() OVER (ORDER BY rest, n DESC, category) - 1 AS INTEGER) AS position, category, n FROM b""")
def q_bar_series_bounded(spark, sf):
    return CH.bar_series_bounded(table(spark, sf, "orders"), "o_custkey", 15, order="count")


@query("scatter_series", """WITH p AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part
                                       WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL AND NOT isnan(p_retailprice)),
s AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt, min(x) AS x0, max(x) AS x1,
             min(y) AS y0, max(y) AS y1 FROM p),
g AS (SELECT CAST(least(floor((x - x0) * 20.0 / (x1 - x0)), 19) AS INTEGER) AS bx,
             CAST(least(floor((y - y0) * 20.0 / (y1 - y0)), 19) AS INTEGER) AS "by" FROM p, s),
c AS (SELECT bx, "by", count(*) AS n FROM g GROUP BY bx, "by")
SELECT bx, "by", round(x0 + (bx + 0.5) * (x1 - x0) / 20.0, 6) AS x, round(y0 + ("by" + 0.5) * (y1 - y0) / 20.0, 6) AS y,
       n, round(slope * (x0 + (bx + 0.5) * (x1 - x0) / 20.0) + icpt, 6) AS fit
FROM c, s""")
def q_scatter_series(spark, sf):
    s = CH.scatter_series(table(spark, sf, "part"), "p_size", "p_retailprice", max_points=400)
    return s.select("bx", "by", r6("x").alias("x"), r6("y").alias("y"), "n", r6("fit").alias("fit"))


# ---------------------------------------------- 2.8 answers, responses, runs
@query("format_answer", """SELECT 'json_object' AS output_format,
  '{' || string_agg(CAST(to_json(p_name) AS VARCHAR) || ':' || CAST(to_json(mean) AS VARCHAR), ','
                    ORDER BY p_name) || '}' AS answer
FROM (SELECT p_name, round(avg(p_partkey), 6) AS mean FROM part GROUP BY p_name)""")
def q_format_answer(spark, sf):
    """One text: a figure for every part name."""
    means = S.group_mean(table(spark, sf, "part"), "p_name", "p_partkey").withColumn("mean", r6("mean"))
    return A.format_answer(means, "json_object")


@query("answer_rows", """SELECT '{"p_name":' || CAST(to_json(p_name) AS VARCHAR) || ',"mean":'
  || CAST(to_json(mean) AS VARCHAR) || '}' AS element
FROM (SELECT p_name, round(avg(p_partkey), 6) AS mean FROM part GROUP BY p_name)""")
def q_answer_rows(spark, sf):
    """A result with a row per key of an unbounded column: an element a row, by many tasks."""
    means = S.group_mean(table(spark, sf, "part"), "p_name", "p_partkey").withColumn("mean", r6("mean"))
    return A.answer_rows(means).select("element")


@query("assemble_answers", f"""SELECT 'json_array' AS format, '[' || string_agg(answer, ',' ORDER BY task_id) || ']' AS result
FROM ({_ANSWERS_SQL})""")
def q_assemble_answers(spark, sf):
    return A.assemble(_two_answers(spark, sf), "json_array")


_FENCED_PREFIX = "Sure, here is the script:\n```python\nimport json\n"


@query("strip_fences", """SELECT conv_id, turn, 'import json' || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS code
FROM conversations""")
def q_strip_fences(spark, sf):
    cv = table(spark, sf, "conversations")
    raw = cv.select("conv_id", "turn",
                    F.concat(F.lit(_FENCED_PREFIX), F.col("text"), F.lit("\n```")).alias("code"))
    return RS.strip_code_fences(raw, "code", code_only=True)


@query("response_text", """SELECT conv_id, turn, text || chr(10) || role || chr(10) AS all_text FROM conversations""")
def q_response_text(spark, sf):
    cv = table(spark, sf, "conversations")
    blocks = cv.select("conv_id", "turn", F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text")),
        F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("tool_result").alias("type"), F.col("role").alias("text"))).alias("content"))
    return RS.response_text(blocks, "content", out="all_text").drop("content")


@query("last_line", """SELECT conv_id, turn,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))),
              lambda x: x <> '' AND NOT starts_with(x, 'DEBUG:') AND NOT starts_with(x, 'INFO:'))[-1] AS last_line
FROM conversations""")
def q_last_line(spark, sf):
    cv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return RS.result_line(cv, "text", RS.LOG_PREFIXES).drop("text")


_ANSWER_TEXT_SQL = """CASE role WHEN 'user' THEN CASE WHEN turn % 2 = 0 THEN CAST(length(text) AS VARCHAR)
                                              ELSE CAST(length(text) AS VARCHAR) || '.5' END
            WHEN 'assistant' THEN '"' || text || '"'
            ELSE '{"turn": ' || CAST(turn AS VARCHAR) || '}' END"""


@query("parse_answer", f"""SELECT conv_id, turn,
  CASE WHEN role = 'user' THEN CAST({_ANSWER_TEXT_SQL} AS DOUBLE) END AS num,
  CASE WHEN role = 'user' THEN turn % 2 = 0 END AS is_int,
  CASE WHEN role = 'assistant' THEN text END AS str,
  CASE WHEN role NOT IN ('user', 'assistant') THEN CAST(json({_ANSWER_TEXT_SQL}) AS VARCHAR) END AS json
FROM conversations""")
def q_parse_answer(spark, sf):
    cv = table(spark, sf, "conversations")
    n = F.length("text").cast("string")
    text = (F.when(F.col("role") == "user",
                   F.when(F.col("turn") % 2 == 0, n).otherwise(F.concat(n, F.lit(".5"))))
            .when(F.col("role") == "assistant", F.concat(F.lit('"'), F.col("text"), F.lit('"')))
            .otherwise(F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}"))))
    fmt = (F.when(F.col("role") == "user", F.lit("number"))
           .when(F.col("role") == "assistant", F.lit("string")).otherwise(F.lit("json")))
    parsed = RS.parse_answer(cv.select("conv_id", "turn", text.alias("txt"), fmt.alias("fmt")), "txt", F.col("fmt"))
    return parsed.select("conv_id", "turn", "num", "is_int", "str", F.to_json("json").alias("json"))


@query("answer_rollup", """SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS succeeded,
  count(*) FILTER (WHERE event_type = 'error') AS failed FROM events""")
def q_answer_rollup(spark, sf):
    ev = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    return RS.answer_rollup(ev)


@query("run_rollup", """WITH h AS (SELECT user_id, ts, event_id, event_type <> 'error' AS success,
         CASE WHEN event_type = 'error' THEN repeat(props, 25) END AS error FROM events),
last AS (SELECT user_id, success, error FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM h) WHERE rn = 1),
agg AS (SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE NOT success) AS failures FROM h GROUP BY user_id)
SELECT agg.user_id, attempts, failures, success AS final_success, substr(error, 1, 200) AS final_error
FROM agg JOIN last USING (user_id)""")
def q_run_rollup(spark, sf):
    ev = table(spark, sf, "events")
    hist = ev.select("user_id", F.struct("ts", "event_id").alias("attempt"),
                     (F.col("event_type") != "error").alias("success"),
                     F.when(F.col("event_type") == "error", F.repeat("props", 25)).alias("error"))
    return RS.run_report(hist, task="user_id", attempt="attempt")


_RUBRIC = [
    {"kind": "is_json", "n_items": 3},
    {"item": 0, "kind": "equals", "expected": "10", "weight": 1.0},
    {"item": 1, "kind": "regex", "expected": "^f$", "weight": 1.0},
    {"item": 2, "kind": "within", "expected": "250000", "tolerance": 50000.0, "weight": 2.0},
]


@query("grade_answers", """WITH s AS (
  SELECT o_custkey AS submission_id, count(*) AS n, arg_max(o_orderstatus, o_orderkey) AS last,
         round(avg(o_totalprice), 2) AS avg_price FROM orders GROUP BY o_custkey),
a AS (SELECT submission_id, CASE WHEN n < 5 THEN '[' || n || ',"' || last || '"]'
        ELSE '[' || n || ',"' || last || '",' || CAST(avg_price AS VARCHAR) || ']' END AS answer FROM s),
c AS (SELECT submission_id,
        COALESCE(json_array_length(answer) = 3, false) AS gate,
        COALESCE(trim(json_extract_string(answer, '$[0]')) = '10', false) AS c0,
        COALESCE(regexp_matches(json_extract_string(answer, '$[1]'), '(?i)^f$'), false) AS c1,
        COALESCE(abs(TRY_CAST(json_extract_string(answer, '$[2]') AS DOUBLE) - 250000) <= 50000, false) AS c2
      FROM a)
SELECT submission_id,
  CAST(CASE WHEN gate THEN CAST(c0 AS INTEGER) * 1 + CAST(c1 AS INTEGER) * 1 + CAST(c2 AS INTEGER) * 2
       ELSE 0 END AS DOUBLE) AS score,
  CAST(4 AS DOUBLE) AS max_score, gate AS gate_ok,
  CAST(CAST(c0 AS INTEGER) + CAST(c1 AS INTEGER) + CAST(c2 AS INTEGER) AS BIGINT) AS passed,
  CAST(3 AS BIGINT) AS checks FROM c""")
def q_grade_answers(spark, sf):
    o = table(spark, sf, "orders")
    s = o.groupBy(F.col("o_custkey").alias("submission_id")).agg(
        F.count("*").alias("n"), F.max_by("o_orderstatus", "o_orderkey").alias("last"),
        F.round(F.avg("o_totalprice"), 2).alias("avg_price"))
    head = F.concat(F.lit("["), F.col("n").cast("string"), F.lit(',"'), F.col("last"), F.lit('"'))
    ans = F.when(F.col("n") < 5, F.concat(head, F.lit("]"))).otherwise(
        F.concat(head, F.lit(","), F.col("avg_price").cast("string"), F.lit("]")))
    subs = s.select("submission_id", ans.alias("answer"))
    return RS.grade(subs, _RUBRIC)


# ------------------------------------------------------ 2.9 composition
def flagship_spec(sf_dir: str) -> dict:
    """Report over orders: count, distinct, top group, size describe,
    percentage, correlation, group counts and means, histogram, one failing task."""
    base = sf_dir.rstrip("/")
    return {
        "sourcing_plan": [{
            "name": "orders", "path": f"{base}/orders.parquet", "kind": "parquet",
            "columns": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                        "o_orderpriority"],
            "clean": {"required": ["o_orderkey", "o_custkey"], "drop_missing_in": ["o_custkey"],
                      "dedupe": True},
            "validate": {"required": ["o_orderkey", "o_custkey"], "non_empty": True},
        }],
        "analysis_plan": [
            {"task_id": 1, "qid": "rows", "source": "orders", "op": "row_count", "output_format": "number"},
            {"task_id": 2, "qid": "customers", "source": "orders", "op": "count_distinct",
             "params": {"column": "o_custkey"}, "output_format": "number"},
            {"task_id": 3, "qid": "top_customer", "source": "orders", "op": "top_group",
             "params": {"key": "o_custkey"}, "output_format": "json_object"},
            {"task_id": 4, "qid": "orders_per_customer", "source": "orders", "op": "size_describe",
             "params": {"key": "o_custkey"}, "output_format": "json_object", "round": 6},
            {"task_id": 5, "qid": "urgent_pct", "source": "orders", "op": "percentage",
             "params": {"predicate": "o_orderpriority = '1-URGENT'"}, "output_format": "number", "round": 2},
            {"task_id": 6, "qid": "price_vs_key", "source": "orders", "op": "correlation",
             "params": {"x": "o_orderkey", "y": "o_totalprice"}, "output_format": "number", "round": 6},
            {"task_id": 7, "qid": "status_counts", "source": "orders", "op": "group_count",
             "params": {"key": "o_orderstatus"}, "output_format": "json_object"},
            {"task_id": 8, "qid": "broken", "source": "orders", "op": "global_mean",
             "params": {"column": "no_such_column"}, "output_format": "number"},
            {"task_id": 9, "qid": "price_per_priority", "source": "orders", "op": "group_mean",
             "params": {"key": "o_orderpriority", "column": "o_totalprice"}, "output_format": "json_object", "round": 2},
            {"task_id": 10, "qid": "customer_sizes", "source": "orders", "op": "size_histogram",
             "params": {"key": "o_custkey"}, "output_format": "records"},
        ],
        "final_output_format": {"format": "json_array"},
    }


# The answers as text: objects by key, doubles as Spark writes them (small ones with an exponent).
_REPORT_SQL = """
WITH o AS (SELECT DISTINCT * FROM orders WHERE o_custkey IS NOT NULL),
c AS (SELECT o_custkey AS k, count(*) AS n FROM o GROUP BY 1),
s AS (SELECT n AS size, count(*) AS groups FROM c GROUP BY 1),
a(task_id, qid, output_format, answer, error) AS (
  SELECT 1, 'rows', 'number', (SELECT count(*) FROM o)::VARCHAR, NULL
  UNION ALL SELECT 2, 'customers', 'number', (SELECT count(*) FROM c)::VARCHAR, NULL
  UNION ALL SELECT 3, 'top_customer', 'json_object',
    (SELECT '{"' || k || '":' || n || '}' FROM c ORDER BY n DESC, k LIMIT 1), NULL
  UNION ALL SELECT 4, 'orders_per_customer', 'json_object',
    (SELECT '{"count":' || count(*) || ',"mean":' || round(avg(n), 6) || ',"std":' || round(stddev_samp(n), 6)
       || ',"min":' || min(n)::DOUBLE || ',"p25":' || quantile_cont(n, 0.25)::DOUBLE
       || ',"p50":' || quantile_cont(n, 0.5)::DOUBLE || ',"p75":' || quantile_cont(n, 0.75)::DOUBLE
       || ',"max":' || max(n)::DOUBLE || '}' FROM c), NULL
  UNION ALL SELECT 5, 'urgent_pct', 'number',
    (SELECT round(100.0::DOUBLE * count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 2) FROM o)::VARCHAR, NULL
  UNION ALL SELECT 6, 'price_vs_key', 'number', (SELECT CASE WHEN r = 0 OR abs(r) >= 1e-3 THEN r::VARCHAR
              WHEN abs(r) >= 1e-4 THEN round(r * 1e4, 2) || 'E-4' WHEN abs(r) >= 1e-5 THEN round(r * 1e5, 1) || 'E-5'
              ELSE round(r * 1e6, 1) || 'E-6' END
     FROM (SELECT round(corr(o_totalprice, o_orderkey), 6) AS r FROM o)), NULL
  UNION ALL SELECT 7, 'status_counts', 'json_object',
    (SELECT '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}'
     FROM (SELECT o_orderstatus AS k, count(*) AS n FROM o GROUP BY 1)), NULL
  UNION ALL SELECT 8, 'broken', 'number', NULL,
    'ValueError: column ''no_such_column'' of parameter ''column'' not in source ''orders'''
  UNION ALL SELECT 9, 'price_per_priority', 'json_object',
    (SELECT '{' || string_agg('"' || k || '":' || m, ',' ORDER BY k) || '}'
     FROM (SELECT o_orderpriority AS k, round(avg(o_totalprice), 2) AS m FROM o GROUP BY 1)), NULL
  UNION ALL SELECT 10, 'customer_sizes', 'records',
    (SELECT '[' || string_agg('{"group_size":' || size || ',"n_groups":' || groups || '}', ',' ORDER BY size) || ']'
     FROM s), NULL)
SELECT task_id::INTEGER AS task_id, qid, output_format, NULL::BIGINT AS position, answer, error FROM a
"""


@query("report_job", _REPORT_SQL)
def q_report_job(spark, sf):
    from tablework.plans.report import run_report_job
    return run_report_job(spark, flagship_spec(sf))


@query("report_distincts", """SELECT * FROM (
    SELECT 1 AS task_id, 'orders' AS qid, 'number' AS output_format, NULL::BIGINT AS position,
      CAST(count(DISTINCT l_orderkey) AS VARCHAR) AS answer, NULL::VARCHAR AS error FROM lineitem
    UNION ALL SELECT 2, 'parts', 'number', NULL, CAST(count(DISTINCT l_partkey) AS VARCHAR), NULL FROM lineitem
    UNION ALL SELECT 3, 'days', 'number', NULL, CAST(count(DISTINCT l_shipdate) AS VARCHAR), NULL FROM lineitem
    UNION ALL SELECT 4, 'rows', 'number', NULL, CAST(count(*) AS VARCHAR), NULL FROM lineitem
    UNION ALL SELECT 5, 'large', 'number', NULL, CAST(count(*) FILTER (WHERE l_quantity > 45) AS VARCHAR), NULL FROM lineitem)""")
def q_report_distincts(spark, sf):
    """A report with several exact distinct counts: one pass for them, one for the other scalars."""
    from tablework.plans.report import run_report_job

    def task(tid, qid, op, **params):
        return {"task_id": tid, "qid": qid, "source": "items", "op": op, "params": params, "output_format": "number"}
    return run_report_job(spark, {
        "sourcing_plan": [{"name": "items", "path": f"{sf.rstrip('/')}/lineitem.parquet", "kind": "parquet"}],
        "analysis_plan": [task(1, "orders", "count_distinct", column="l_orderkey"),
                          task(2, "parts", "count_distinct", column="l_partkey"),
                          task(3, "days", "count_distinct", column="l_shipdate"),
                          task(4, "rows", "row_count"),
                          task(5, "large", "filtered_count", predicate="l_quantity > 45")],
        "final_output_format": {"format": "json_array"}})
