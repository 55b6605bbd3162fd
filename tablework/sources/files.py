"""File and table sources and sinks (#1-#6, #13-#18).

Every loader returns a lazy DataFrame: nothing is read until an action,
so projection and filters written later reach the scan (``PushedFilters``,
``ReadSchema``, ``PartitionFilters``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.text import MISSING_WORDS
from tablework.sources.records import read_csv_records, read_json_records

# File extension → source kind.
EXTENSION_KINDS = {
    "csv": "csv", "tsv": "tsv", "tab": "tsv", "txt": "text", "json": "json",
    "jsonl": "json", "ndjson": "json", "parquet": "parquet", "pq": "parquet",
    "orc": "orc", "xlsx": "workbook", "avro": "avro",
}
_COMPRESSED = ("gz", "bz2", "deflate", "zst", "lz4", "snappy")

CORRUPT_COLUMN = "_corrupt_record"

# Text formats keep microseconds (Spark's default writes milliseconds only).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
# CSV as pandas reads and writes it: a quote inside a quoted field is doubled,
# and white space at the edges of a field is kept.
CSV_QUOTES = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# Reader options that the range-wise reading does not follow (lower case).
_WHOLE_FILE_OPTIONS = {"quote", "escape", "linesep", "comment", "chartoescapequoteescaping", "encoding", "charset",
                       "ignoreleadingwhitespace", "ignoretrailingwhitespace", "unescapedquotehandling",
                       "recursivefilelookup", "pathglobfilter", "modifiedbefore", "modifiedafter"}

_TEXT_TS = {"timestampFormat": TS_FORMAT, "timestampNTZFormat": TS_FORMAT}


def source_kind(path: str) -> str:
    """Source kind from a path or URL extension; unknown → ValueError."""
    clean = path.split("?", 1)[0].split("#", 1)[0].rstrip("/")
    name = clean.rsplit("/", 1)[-1].lower()
    parts = name.split(".")
    while len(parts) > 1 and parts[-1] in _COMPRESSED:
        parts.pop()
    ext = parts[-1] if len(parts) > 1 else ""
    if ext not in EXTENSION_KINDS:
        raise ValueError(f"unsupported source type for {path!r} (extension {ext!r})")
    return EXTENSION_KINDS[ext]


def load_table(spark: SparkSession, path: str | Sequence[str], kind: str | None = None, *,
               schema: T.StructType | str | None = None, sep: str | None = None,
               header: bool = True, encoding: str = "UTF-8", multiline: bool | str | None = None,
               mode: str = "PERMISSIVE", null_tokens: Iterable[str] | None = None,
               columns: Sequence[str] | None = None, where: str | None = None,
               nan_as_null: bool = False, **options: Any) -> DataFrame:
    """Load one source as a DataFrame.

    ``kind`` is inferred from the extension when omitted: csv, tsv, text,
    json, parquet, orc, avro, workbook (folder of .xlsx) or jdbc (``path``
    is then the JDBC URL; pass ``table=``). Pass ``schema`` for text formats:
    inference reads the data twice and turns codes like ``6D`` into doubles.
    ``null_tokens`` (CSV/TSV): words read as NULL in string columns.
    ``multiline``: whether a record may go over several lines, and how such
    files are read. ``True``: by Spark's parser, one task a file. ``"split"``
    (needs ``schema``; UTF-8): in ranges of any place (``sources.records``).
    ``False``: every line is a record. By default, CSV records may go over lines,
    as quoted fields may hold line breaks: input of more bytes than one range is
    split where the options allow it. JSON is told from its beginning (an array,
    or a first line that is no whole value: documents; else JSON lines) and large
    documents are split likewise.
    CSV quotes are doubled inside quoted fields, on reading and writing.
    ``columns`` / ``where``: projection and predicate applied lazily.
    ``nan_as_null``: floating NaN read as NULL (pandas missing semantics).
    """
    first = path if isinstance(path, str) else path[0]
    kind = (kind or source_kind(first)).lower()
    reader = spark.read
    if schema is not None and kind not in ("jdbc", "workbook"):
        reader = reader.schema(schema)
    if kind in ("csv", "tsv", "json"):
        reader = reader.options(**_TEXT_TS)
    sep = sep or ("\t" if kind == "tsv" else ",")
    splits = schema is not None and encoding.upper() in ("UTF-8", "UTF8") and mode in ("PERMISSIVE", "FAILFAST") \
        and len(sep) == 1 and not _WHOLE_FILE_OPTIONS & {o.lower() for o in options}
    if multiline == "split" and not splits:
        raise ValueError("splitting needs a schema, UTF-8, one-character separators and the usual CSV quotes")
    split = splits and kind in ("csv", "tsv", "json") and (
        multiline == "split" or (multiline is None and _over_one_range(spark, path)))
    if split and kind == "json" and multiline is None:
        multiline = _json_layout(spark, path)
        split = multiline == "split"
    if split:
        typed = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        known = {**_TEXT_TS, "mode": mode, **{k: str(v) for k, v in options.items()}}
        df = read_json_records(spark, path, typed, known) if kind == "json" else \
            read_csv_records(spark, path, typed, sep, header, {**CSV_QUOTES, **known})
        if null_tokens is not None and kind != "json":
            df = _nulls(df, null_tokens)
    elif kind in ("csv", "tsv"):
        df = (reader.option("header", header)
              .option("sep", sep)
              .option("encoding", encoding)
              .option("mode", mode)
              .option("multiLine", multiline is not False)
              .options(**CSV_QUOTES)
              .options(**options)
              .csv(path))
        if null_tokens is not None:
            df = _nulls(df, null_tokens)
    elif kind == "text":
        df = reader.options(**options).text(path)
    elif kind == "json":
        if multiline is None:
            multiline = _json_layout(spark, path) == "split"
        df = reader.option("multiLine", multiline).option("mode", mode).options(**options).json(path)
    elif kind == "parquet":
        df = reader.options(**options).parquet(*([path] if isinstance(path, str) else path))
    elif kind == "orc":
        df = reader.options(**options).orc(path)
    elif kind == "avro":
        df = reader.format("avro").options(**options).load(path)
    elif kind == "jdbc":
        from tablework.sources.jdbc import load_jdbc
        df = load_jdbc(spark, first, columns=columns, where=where, **options)
        columns, where = None, None
    elif kind == "workbook":
        from tablework.sources.workbooks import load_workbooks
        df = load_workbooks(spark, first, schema=schema, **options)
    else:
        raise ValueError(f"unsupported source kind {kind!r}")
    if where:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    if nan_as_null:
        df = df.select(*[F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name)
                         if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                         for f in df.schema.fields])
    return df


def _over_one_range(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Whether the files hold more bytes than one range of a scan (file listing only)."""
    limit = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    total = 0
    for p in [path] if isinstance(path, str) else path:
        place = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for found in fs.globStatus(place) or []:
            total += fs.getContentSummary(found.getPath()).getLength()
            if total > limit:
                return True
    return False


def _json_layout(spark: SparkSession, path: str | Sequence[str]) -> str | bool:
    """``"split"`` for documents, False for JSON lines. An array is told from the
    text up to its first object's end; of other files the first line is read."""
    head = spark.read.option("lineSep", "}").text(path).first()
    if head is None or head["value"].lstrip("\ufeff \t\r\n").startswith("["):
        return "split"
    value = F.trim("value")
    first = spark.read.text(path).where(value != "").select(
        F.get_json_object(value, "$").isNotNull().alias("whole")).first()
    return False if first is None or first["whole"] else "split"


def _nulls(df: DataFrame, tokens: Iterable[str]) -> DataFrame:
    toks = list(tokens)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and f.name != CORRUPT_COLUMN:
            c = F.when(c.isin(toks), F.lit(None).cast("string")).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def load_csv_split(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, *,
                   sep: str = ",", header: bool = True, encoding: str = "UTF-8",
                   null_tokens: Iterable[str] | None = MISSING_WORDS,
                   **options: Any) -> tuple[DataFrame, DataFrame]:
    """``load_csv_flagged`` cut in two: ``(good_rows, bad_rows)``. Using both
    reads the file twice; ``load_csv_flagged`` reads it once."""
    raw = load_csv_flagged(spark, path, schema, sep=sep, header=header, encoding=encoding,
                           null_tokens=null_tokens, **options)
    return raw.where("NOT malformed").drop("malformed", CORRUPT_COLUMN), raw.where("malformed").drop("malformed")


def load_csv_flagged(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, *,
                     sep: str = ",", header: bool = True, encoding: str = "UTF-8",
                     null_tokens: Iterable[str] | None = MISSING_WORDS,
                     **options: Any) -> DataFrame:
    """Read a CSV once in PERMISSIVE mode, with two columns more.

    A row that does not fit the schema (extra or missing fields, a value of
    the wrong type) has ``malformed`` true and its raw text in
    ``_corrupt_record``, besides the fields that could be parsed.
    """
    # With CSV column pruning on, a row with an extra field is only caught
    # when every column is parsed; the flag must not depend on what a later
    # select keeps, so pruning is switched off for this read.
    options = {"columnPruning": "false", **options}
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT_COLUMN, T.StringType())])
    raw = load_table(spark, path, "csv", schema=full, sep=sep, header=header,
                     encoding=encoding, mode="PERMISSIVE",
                     columnNameOfCorruptRecord=CORRUPT_COLUMN, **options)
    if null_tokens is not None:
        raw = _nulls(raw, null_tokens)
    # Spark refuses a scan that reads only the corrupt column (e.g. a bare
    # count of bad rows); the always-true length test references every parsed
    # field so no later projection can narrow the scan to that column alone.
    fields = [F.col(f"`{f.name}`").cast("string") for f in schema.fields]
    keep_fields = F.length(F.concat_ws("\u0001", *fields)) >= 0
    return raw.withColumn("malformed", F.col(CORRUPT_COLUMN).isNotNull() & keep_fields)


def load_tables(spark: SparkSession, specs: Sequence[Mapping[str, Any]]
                ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Load several sources, keeping request order.

    Each spec: ``{"name", "path", "kind"?, ...load_table options}``. A source
    that fails to resolve becomes an error entry; the others still load.
    Returns ``(frames by name, report)``; the report has one row per spec
    ``(position, name, status, error, n_columns)``. Resolution is lazy apart
    from schema discovery, so the loop does no data work.
    """
    frames: dict[str, DataFrame] = {}
    rows = []
    for i, spec in enumerate(specs):
        spec = dict(spec)
        name = spec.pop("name", f"source_{i}")
        path = spec.pop("path")
        kind = spec.pop("kind", None)
        try:
            df = load_table(spark, path, kind, **spec)
            frames[name] = df
            rows.append((i, name, "ok", None, len(df.columns)))
        except Exception as exc:  # one failing source must not stop the rest
            rows.append((i, name, "error", f"{type(exc).__name__}: {exc}", None))
    report = spark.createDataFrame(
        rows, "position INT, name STRING, status STRING, error STRING, n_columns INT")
    return frames, report


def save_table(df: DataFrame, path: str, kind: str = "parquet", *,
               partition_by: Sequence[str] | None = None, mode: str = "overwrite",
               header: bool = True, compression: str | None = None,
               **options: Any) -> str:
    """Write a DataFrame (parquet, csv, tsv, json, orc, text); returns ``path``.

    With ``partition_by`` the rows are first rebalanced on the partition
    columns (``REBALANCE`` hint): AQE then writes few, right-sized files
    per partition value and splits a hot value over several tasks instead
    of leaving one task to write it.
    """
    kind = kind.lower()
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if compression:
        w = w.option("compression", compression)
    if kind in ("csv", "tsv", "json"):
        w = w.options(**_TEXT_TS)
    w = w.options(**options)
    if kind == "parquet":
        w.parquet(path)
    elif kind in ("csv", "tsv"):
        w.options(**CSV_QUOTES).option("header", header).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind == "json":
        w.json(path)
    elif kind == "orc":
        w.orc(path)
    elif kind == "text":
        w.text(path)
    else:
        raise ValueError(f"unsupported sink kind {kind!r}")
    return path


def register_view(df: DataFrame, name: str, where: str | None = None) -> DataFrame:
    """Named temp view over a source, optionally with a predicate; the
    predicate is part of the view's plan and is pushed into the scan."""
    view = df.where(where) if where else df
    view.createOrReplaceTempView(name)
    return view


def run_sql(spark: SparkSession, query: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """Run SQL with named parameters (``:name``), never string-formatted."""
    return spark.sql(query, args=dict(args) if args else None)
