"""Workbook source (#8): a folder of .xlsx files → one row table.

Files are listed and read by Spark (``binaryFile``), one workbook per
task; the sheet XML is parsed on the executor with the standard library
(``zipfile`` + ``ElementTree``) and rows are streamed out in batches.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


ROW_SCHEMA = "path STRING, sheet STRING, row_idx BIGINT, cells ARRAY<STRING>"

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
_BATCH = 5_000


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _shared_strings(zf: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in zf.namelist():
        return []
    root = ET.fromstring(zf.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t"))
            for si in root.findall("m:si", _NS)]


def _sheet_paths(zf: zipfile.ZipFile) -> list[tuple[str, str]]:
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.findall("p:Relationship", _NS)}
    out = []
    for s in wb.find("m:sheets", _NS).findall("m:sheet", _NS):
        t = target[s.get(f"{{{_NS['r']}}}id")]
        t = t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join("xl", t))
        out.append((s.get("name"), t))
    return out


def _cell_text(c: ET.Element, shared: list[str]) -> str | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
    v = c.find("m:v", _NS)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    return v.text


def workbook_rows(path: str, content: bytes, sheet: str | int | None = 0
                  ) -> Iterator[tuple[str, str, int, list[str | None]]]:
    """Rows of one workbook as ``(path, sheet, row_idx, cells)``."""
    with zipfile.ZipFile(io.BytesIO(content)) as zf:
        shared = _shared_strings(zf)
        sheets = _sheet_paths(zf)
        if sheet is None:
            chosen = sheets
        elif isinstance(sheet, int):
            chosen = sheets[sheet:sheet + 1]
        else:
            chosen = [s for s in sheets if s[0] == sheet]
        for name, member in chosen:
            root = ET.fromstring(zf.read(member))
            data = root.find("m:sheetData", _NS)
            for i, row in enumerate(data.findall("m:row", _NS) if data is not None else []):
                cells: dict[int, str | None] = {}
                for pos, c in enumerate(row.findall("m:c", _NS)):
                    ref = c.get("r")
                    cells[_col_index(ref) if ref else pos] = _cell_text(c, shared)
                width = max(cells) + 1 if cells else 0
                yield path, name, i, [cells.get(j) for j in range(width)]


def parse_workbooks(files: DataFrame, sheet: str | int | None = 0) -> DataFrame:
    """``(path, content)`` frame of workbook files → ``(path, sheet,
    row_idx, cells)``; one workbook per input row, rows out in batches."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, blob in zip(pdf["path"], pdf["content"]):
                buf = []
                for rec in workbook_rows(p, bytes(blob), sheet):
                    buf.append(rec)
                    if len(buf) >= _BATCH:
                        yield pd.DataFrame(buf, columns=["path", "sheet", "row_idx", "cells"])
                        buf = []
                if buf:
                    yield pd.DataFrame(buf, columns=["path", "sheet", "row_idx", "cells"])

    return files.select("path", "content").mapInPandas(parse, ROW_SCHEMA)


def read_workbook_rows(spark: SparkSession, path_glob: str, sheet: str | int | None = 0,
                       recursive: bool = False) -> DataFrame:
    """``(path, sheet, row_idx, cells)`` of every workbook under the glob."""
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", str(recursive).lower())
             .load(path_glob))
    return parse_workbooks(files, sheet)


def workbooks_to_table(files: DataFrame, *, sheet: str | int | None = 0,
                       schema: T.StructType | str | None = None, header: bool = True,
                       on_mismatch: str = "null") -> DataFrame:
    """Typed table from a ``(path, content)`` frame of workbooks."""
    from tablework.operators.cleaning import rows_to_table
    return rows_to_table(parse_workbooks(files, sheet), ["path", "sheet"], schema=schema,
                         header=header, on_mismatch=on_mismatch)


def load_workbooks(spark: SparkSession, path_glob: str, *, sheet: str | int | None = 0,
                   schema: T.StructType | str | None = None, header: bool = True,
                   on_mismatch: str = "null", recursive: bool = False) -> DataFrame:
    """All workbooks under ``path_glob`` as one typed table
    ``(path, sheet, *schema columns)``.

    The first row of each sheet is the header when ``header``; cells are
    matched to ``schema`` by position and cast (``on_mismatch`` as in
    ``apply_schema``). ``sheet``: index, name, or None for every sheet.
    """
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", str(recursive).lower())
             .load(path_glob))
    return workbooks_to_table(files, sheet=sheet, schema=schema, header=header,
                              on_mismatch=on_mismatch)
