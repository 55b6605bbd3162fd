"""Inputs derived from the given tables for round-trip queries.

The driver's tables are Parquet; several sources of the toolkit read other
shapes (workbooks, archives, web pages, broken CSV, typed response blocks).
These builders turn a table into such inputs on the executors, partition by
partition, in bounded chunks (no grouping of a whole key), so the
round-trip query's work grows with the table. Nothing here touches the
driver's filesystem: binary files come out as ``(path, content)`` rows,
the same shape ``binaryFile`` produces.
"""

from __future__ import annotations

import html as _html
import io
import tarfile
import zipfile
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_SCHEMA = "path STRING, content BINARY"


def _text(v) -> str | None:
    if v is None or (isinstance(v, float) and pd.isna(v)):
        return None
    if isinstance(v, pd.Timestamp):
        return v.isoformat(sep=" ")
    return str(v)


def _col_name(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def workbook_bytes(columns: Sequence[str], rows: Sequence[Sequence], shared: bool = True) -> bytes:
    """A one-sheet .xlsx (header + rows) built with the standard library.
    Numbers are numeric cells; other values are shared or inline strings."""
    strings: dict[str, int] = {}

    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{repr(v) if isinstance(v, float) else v}</v></c>'
        t = _text(v)
        if shared:
            idx = strings.setdefault(t, len(strings))
            return f'<c r="{ref}" t="s"><v>{idx}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(t)}</t></is></c>'

    body = []
    for r, values in enumerate([list(columns)] + [list(x) for x in rows]):
        cells = "".join(cell(f"{_col_name(c)}{r + 1}", v) for c, v in enumerate(values))
        body.append(f'<row r="{r + 1}">{cells}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = f'<?xml version="1.0" encoding="UTF-8"?><worksheet {ns}><sheetData>{"".join(body)}</sheetData></worksheet>'
    workbook = (f'<?xml version="1.0" encoding="UTF-8"?><workbook {ns} {rns}><sheets>'
                f'<sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>')
    rels = ('<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
            '</Relationships>')
    root_rels = ('<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                 '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
                 '</Relationships>')
    types = ('<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
             '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
             '<Default Extension="xml" ContentType="application/xml"/>'
             '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
             '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
             '</Types>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("[Content_Types].xml", types)
        zf.writestr("_rels/.rels", root_rels)
        zf.writestr("xl/workbook.xml", workbook)
        zf.writestr("xl/_rels/workbook.xml.rels", rels)
        zf.writestr("xl/worksheets/sheet1.xml", sheet)
        if shared:
            items = "".join(f"<si><t>{escape(s)}</t></si>" for s in strings)
            zf.writestr("xl/sharedStrings.xml",
                        f'<?xml version="1.0" encoding="UTF-8"?><sst {ns} count="{len(strings)}">{items}</sst>')
    return buf.getvalue()


def _chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Re-cut a stream of batches into frames of exactly ``size`` rows
    (the last one shorter); each row is copied once."""
    tail: pd.DataFrame | None = None
    for pdf in batches:
        whole = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
        full = len(whole) // size * size
        for start in range(0, full, size):
            yield whole.iloc[start:start + size]
        tail = whole.iloc[full:] if full < len(whole) else None
    if tail is not None and len(tail):
        yield tail


def _records(pdf: pd.DataFrame) -> list[list]:
    out = []
    for row in pdf.itertuples(index=False):
        out.append([None if (isinstance(v, float) and pd.isna(v)) else
                    (v.item() if hasattr(v, "item") else v) for v in row])
    return out


def to_workbooks(df: DataFrame, rows_per_book: int = 20_000, prefix: str = "book") -> DataFrame:
    """One .xlsx per chunk of ``rows_per_book`` rows of each partition →
    ``(path, content)``."""
    cols = df.columns

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        for i, chunk in enumerate(_chunks(batches, rows_per_book)):
            blob = workbook_bytes(cols, _records(chunk), shared=(i % 2 == 0))
            yield pd.DataFrame({"path": [f"{prefix}-{pid:05d}-{i:04d}.xlsx"], "content": [blob]})

    return df.mapInPandas(build, FILE_SCHEMA)


def _csv_text(pdf: pd.DataFrame) -> bytes:
    return pdf.to_csv(index=False, lineterminator="\n").encode("utf-8")


def to_archives(df: DataFrame, kind: str = "zip", rows_per_member: int = 20_000,
                members_per_archive: int = 4, prefix: str = "archive") -> DataFrame:
    """CSV members (header + rows) packed into zip or tar.gz archives, plus
    one non-matching ``README.txt`` member per archive → ``(path, content)``.
    Values are rendered by pandas; doubles keep their shortest repr."""

    def pack(members: list[tuple[str, bytes]], name: str) -> pd.DataFrame:
        buf = io.BytesIO()
        if kind == "zip":
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
                for m, data in members:
                    zf.writestr(m, data)
        else:
            with tarfile.open(fileobj=buf, mode="w:gz") as tf:
                for m, data in members:
                    info = tarfile.TarInfo(m)
                    info.size = len(data)
                    tf.addfile(info, io.BytesIO(data))
        ext = "zip" if kind == "zip" else "tar.gz"
        return pd.DataFrame({"path": [f"{name}.{ext}"], "content": [buf.getvalue()]})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        members: list[tuple[str, bytes]] = []
        n_arch = 0
        for i, chunk in enumerate(_chunks(batches, rows_per_member)):
            members.append((f"data/part-{i:04d}.csv", _csv_text(chunk)))
            if len(members) == members_per_archive:
                members.append(("README.txt", b"not data\n"))
                yield pack(members, f"{prefix}-{pid:05d}-{n_arch:03d}")
                members, n_arch = [], n_arch + 1
        if members:
            members.append(("README.txt", b"not data\n"))
            yield pack(members, f"{prefix}-{pid:05d}-{n_arch:03d}")

    return df.mapInPandas(build, FILE_SCHEMA)


def to_pages(df: DataFrame, rows_per_page: int = 50, css_class: str = "wikitable",
             title: str = "Table") -> DataFrame:
    """Web pages ``(page_id, url, html)``, each holding up to
    ``rows_per_page`` rows of a partition in a ``<table class=css_class>``
    with a ``<th>`` header row, after a decoy infobox table and inside some
    unclosed markup. Cell text is HTML-escaped."""
    cols = df.columns

    def page(pid: int, i: int, rows: list[list]) -> tuple[int, str, str]:
        head = "".join(f"<th>{_html.escape(c)}</th>" for c in cols)
        body = "".join("<tr>" + "".join(f"<td>{_html.escape(_text(v) or '')}</td>" for v in r) + "</tr>\n"
                       for r in rows)
        page_id = pid * 1_000_000 + i
        doc = (f"<!DOCTYPE html><html><head><title>{title} {page_id}</title>"
               f"<script>var s = \"</td></tr>\";</script></head><body>"
               f"<p>Intro text<p>More <b>text</b>"
               f"<table class=\"infobox\"><tr><td>decoy</td><td>1</td></tr></table>"
               f"<table class=\"{css_class} sortable\"><tr>{head}</tr>\n{body}</table>"
               f"<div>footer &amp; links</div></body></html>")
        return page_id, f"https://example.org/tables/{page_id}.html", doc

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        out = [page(pid, i, _records(chunk)) for i, chunk in enumerate(_chunks(batches, rows_per_page))]
        yield pd.DataFrame(out, columns=["page_id", "url", "html"])

    return df.mapInPandas(build, "page_id BIGINT, url STRING, html STRING")


def to_json_array(df: DataFrame) -> DataFrame:
    """Text lines of one JSON array document per partition: objects spread over
    lines, as a pretty-printer leaves them."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = "["
        for pdf in batches:
            lines = []
            for text in pdf["value"]:
                lines += [mark, "  " + text[0], "    " + text[1:-1], "  " + text[-1]]
                mark = "  ,"
            yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["]"] if mark != "[" else ["[", "]"]})

    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")) \
        .mapInPandas(build, "value STRING")


def csv_line(cols: Sequence[Column | str], sep: str = ",") -> Column:
    """One CSV text line from columns (values must not contain ``sep``)."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"),
                                          F.lit("")) for c in cols])
