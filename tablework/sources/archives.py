"""Archive source (#9): read only the needed members of zip / tar /
tar.gz archives. Each archive is one task (the formats are not
splittable); members stream out line by line in bounded batches, so a
large member never sits in one row. Plain ``.gz`` text files need none of
this: Spark's text/CSV readers decompress them natively.

Limit: ``binaryFile`` hands each archive to its task as one value, up to
``spark.sql.sources.binaryFile.maxLength`` (2 GB by default); bigger
archives should be split upstream, since neither format can be read in
parallel from the middle.
"""

from __future__ import annotations

import fnmatch
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


LINE_SCHEMA = "archive STRING, member STRING, line_no BIGINT, line STRING"
_BATCH = 10_000


def _members(blob: bytes, pattern: str) -> Iterator[tuple[str, io.BufferedIOBase]]:
    buf = io.BytesIO(blob)
    if zipfile.is_zipfile(buf):
        with zipfile.ZipFile(buf) as zf:
            for info in zf.infolist():
                if not info.is_dir() and fnmatch.fnmatch(info.filename, pattern):
                    with zf.open(info) as fh:
                        yield info.filename, fh
        return
    buf.seek(0)
    with tarfile.open(fileobj=buf, mode="r:*") as tf:
        for info in tf:
            if info.isfile() and fnmatch.fnmatch(info.name, pattern):
                fh = tf.extractfile(info)
                if fh is not None:
                    yield info.name, fh


def archive_lines(archive: str, blob: bytes, pattern: str, encoding: str
                  ) -> Iterator[tuple[str, str, int, str]]:
    for name, fh in _members(blob, pattern):
        text = io.TextIOWrapper(fh, encoding=encoding, newline=None)
        for i, line in enumerate(text):
            yield archive, name, i, line.rstrip("\n")


def parse_archive_lines(files: DataFrame, pattern: str = "*", encoding: str = "utf-8") -> DataFrame:
    """``(path, content)`` frame of archives → ``(archive, member, line_no,
    line)`` for members matching ``pattern``."""
    cols = ["archive", "member", "line_no", "line"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, blob in zip(pdf["path"], pdf["content"]):
                buf = []
                for rec in archive_lines(p, bytes(blob), pattern, encoding):
                    buf.append(rec)
                    if len(buf) >= _BATCH:
                        yield pd.DataFrame(buf, columns=cols)
                        buf = []
                if buf:
                    yield pd.DataFrame(buf, columns=cols)

    return files.select("path", "content").mapInPandas(parse, LINE_SCHEMA)


def load_archive_lines(spark: SparkSession, path_glob: str, pattern: str = "*",
                       encoding: str = "utf-8") -> DataFrame:
    """``(archive, member, line_no, line)`` for members matching ``pattern``."""
    return parse_archive_lines(spark.read.format("binaryFile").load(path_glob), pattern, encoding)


def archive_lines_to_csv(lines: DataFrame, schema: T.StructType | str, header: bool = True,
                         sep: str = ",") -> DataFrame:
    """Lines of CSV members → typed rows (``from_csv``; header line dropped)."""
    if header:
        lines = lines.where(F.col("line_no") > 0)
    lines = lines.where(F.col("line") != "")
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    rec = F.from_csv(F.col("line"), F.lit(ddl), {"sep": sep})
    return lines.select(rec.alias("r")).select("r.*")


def load_archive_members(spark: SparkSession, path_glob: str, pattern: str = "*"
                         ) -> DataFrame:
    """``(archive, member, n_lines)`` listing of the matching members."""
    return (load_archive_lines(spark, path_glob, pattern)
            .groupBy("archive", "member").agg(F.count("*").alias("n_lines")))


def load_archive_csv(spark: SparkSession, path_glob: str, schema: T.StructType | str,
                     pattern: str = "*.csv", header: bool = True, sep: str = ",",
                     encoding: str = "utf-8") -> DataFrame:
    """CSV members of archives as one typed table (parsed by ``from_csv``)."""
    return archive_lines_to_csv(load_archive_lines(spark, path_glob, pattern, encoding),
                                schema, header, sep)
