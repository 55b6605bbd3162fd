"""Tables, elements and URLs inside web pages (#10-#12).

Pages arrive as a table ``(page_id, url, html)``. Parsing needs a real
tokenizer (unclosed ``<p>``, ``</p>`` inside ``<script>``), so it runs on
executors with the standard-library ``html.parser`` inside
``mapInPandas``: one Arrow batch of pages in, one batch of rows out, no
per-row Python UDF calls. URL harvest is pure built-in regex.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


OUTPUT_ROWS = 5000      # rows handed on at a time

TABLE_ROW_SCHEMA = "{key} {key_type}, table_idx INT, row_idx INT, is_header BOOLEAN, cells ARRAY<STRING>"
ELEMENT_SCHEMA = "{key} {key_type}, elem_idx INT, parent STRING, text STRING, attr STRING"

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link",
         "meta", "param", "source", "track", "wbr"}


def _classes(attrs: list[tuple[str, str | None]]) -> set[str]:
    for k, v in attrs:
        if k == "class" and v:
            return set(v.split())
    return set()


# The largest column span that the HTML standard allows.
_MAX_COLSPAN = 1000
_NO_TEXT = {"style", "script"}


# Rows that a row span of 0 ("to the end") reaches, and that any may.
_MAX_ROWSPAN = 65534


def _span(attrs: dict, name: str) -> int:
    """A span attribute: ASCII digits; anything else counts as 1."""
    text = (attrs.get(name) or "").strip()
    return int(text[:9]) if text.isascii() and text.isdigit() else 1


def _guarded_feed(parser: HTMLParser, html: str) -> bool:
    """Feeds a page; markup that the parser cannot take ends the page there, and
    what was read is kept. Returns whether all was read."""
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError, RecursionError):
        return False
    return True


class _OpenTable:
    """A table being read: its finished rows and the row and cell at hand."""

    def __init__(self, attrs):
        self.found = {"classes": _classes(attrs), "id": dict(attrs).get("id"), "rows": []}
        self.row: list[tuple[str, int, int]] | None = None      # (text, row span, column span)
        self.header = True
        self.cell: list[str] | None = None
        self.spans = (1, 1)
        self.below: dict[int, tuple[int, str]] = {}             # column -> (rows to go, text)

    def open_row(self):
        self.close_row()
        self.row, self.header = [], True

    def open_cell(self, attrs: dict, header: bool):
        if self.row is None:
            self.open_row()
        self.close_cell()
        self.cell = []
        down = _span(attrs, "rowspan")
        self.spans = (min(_MAX_ROWSPAN, down or _MAX_ROWSPAN), min(_MAX_COLSPAN, max(1, _span(attrs, "colspan"))))
        self.header = self.header and header

    def close_cell(self):
        if self.cell is not None and self.row is not None:
            self.row.append((" ".join("".join(self.cell).split()), *self.spans))
        self.cell = None

    def close_row(self):
        """Cells at their columns: what spans several is repeated in each."""
        self.close_cell()
        if self.row is not None:
            cells: list[str] = []
            from_above = 0

            def take_spanning():
                nonlocal from_above
                while len(cells) in self.below:
                    left, text = self.below.pop(len(cells))
                    if left > 1:
                        still[len(cells)] = (left - 1, text)
                    cells.append(text)
                    from_above += 1

            still: dict[int, tuple[int, str]] = {}
            for text, down, across in self.row:
                take_spanning()
                for _ in range(across):
                    if down > 1:
                        still[len(cells)] = (down - 1, text)
                    self.below.pop(len(cells), None)
                    cells.append(text)
            take_spanning()
            self.below = still
            self.found["rows"].append((self.header and bool(cells), cells, len(self.row) + from_above))
        self.row = None


class _TableParser(HTMLParser):
    """Collects every <table> as rows of cell texts. A table inside a cell is a
    table of its own; the outer row goes on behind it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []   # {"classes", "id", "rows": [(is_header, [cells], n_cells)]}
        self._open: list[_OpenTable] = []
        self._silent = 0               # open elements whose content is no text

    def handle_starttag(self, tag, attrs):
        if tag in _NO_TEXT:
            self._silent += 1
        elif tag == "table":
            t = _OpenTable(attrs)
            self.tables.append(t.found)
            self._open.append(t)
        elif not self._open:
            return
        elif tag == "tr":
            self._open[-1].open_row()
        elif tag in ("td", "th"):
            self._open[-1].open_cell(dict(attrs), tag == "th")
        elif tag == "br" and self._open[-1].cell is not None:
            self._open[-1].cell.append(" ")

    def handle_endtag(self, tag):
        if tag in _NO_TEXT:
            self._silent = max(0, self._silent - 1)
        if not self._open:
            return
        if tag in ("td", "th"):
            self._open[-1].close_cell()
        elif tag == "tr":
            self._open[-1].close_row()
        elif tag == "table":
            self._open.pop().close_row()

    def handle_data(self, data):
        if self._open and not self._silent and self._open[-1].cell is not None:
            self._open[-1].cell.append(data)

    def finish(self):
        while self._open:
            self._open.pop().close_row()


def page_tables(html: str | None) -> list[dict]:
    p = _TableParser()
    _guarded_feed(p, html or "")
    p.finish()
    return p.tables


def extract_html_tables(pages: DataFrame, *, key: str = "page_id", html_col: str = "html",
                        css_class: str | None = None, table_id: str | None = None,
                        index: int | None = None, n_cells: int | None = None) -> DataFrame:
    """Rows of the chosen tables of every page.

    ``css_class`` / ``table_id`` pick tables by attribute, ``index`` picks
    the n-th of those per page (0-based), ``n_cells`` keeps rows with
    exactly that many cells (one that spans columns counts once, one that
    reaches down from above counts too). Spanned cells are repeated. Output ``(key, table_idx, row_idx, is_header,
    cells)``; ``table_idx`` counts all tables of the page, ``row_idx`` the
    rows of the table.
    """
    key_type = pages.schema[key].dataType.simpleString()
    schema = TABLE_ROW_SCHEMA.format(key=key, key_type=key_type)
    cols = [key, "table_idx", "row_idx", "is_header", "cells"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, html in zip(pdf[key], pdf[html_col]):
                picked = 0
                for t_idx, t in enumerate(page_tables(html)):
                    if css_class is not None and css_class not in t["classes"]:
                        continue
                    if table_id is not None and t["id"] != table_id:
                        continue
                    if index is not None and picked != index:
                        picked += 1
                        continue
                    picked += 1
                    for r_idx, (is_header, cells, own) in enumerate(t["rows"]):
                        if n_cells is None or own == n_cells:
                            out.append((k, t_idx, r_idx, is_header, cells))
                        if len(out) >= OUTPUT_ROWS:
                            yield pd.DataFrame(out, columns=cols)
                            out = []
            yield pd.DataFrame(out, columns=cols)

    return pages.select(key, html_col).mapInPandas(run, schema)


class _ElementParser(HTMLParser):
    def __init__(self, tag: str, css_class: str | None, attr: str | None,
                 parent: str | None, elem_id: str | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.css_class, self.attr, self.parent = tag, css_class, attr, parent
        self.elem_id = elem_id
        self.open: list[str] = []
        self.found: list[list] = []   # [parent, text_parts, attr]
        self.active: list[tuple[int, list]] = []  # (depth, record)

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1] if self.open else None
        if tag == self.tag and (self.css_class is None or self.css_class in _classes(attrs)) \
                and (self.parent is None or parent == self.parent) \
                and (self.elem_id is None or dict(attrs).get("id") == self.elem_id):
            a = dict(attrs)
            if self.attr is None or self.attr in a:
                rec = [parent, [], a.get(self.attr) if self.attr else None]
                self.found.append(rec)
                if tag not in _VOID:
                    self.active.append((len(self.open), rec))
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open and self.open[-1] == tag:
            self.open.pop()
            if self.active and self.active[-1][0] == len(self.open):
                self.active.pop()

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            top = self.open.pop()
            while self.active and self.active[-1][0] >= len(self.open):
                self.active.pop()
            if top == tag:
                break

    def handle_data(self, data):
        for _, rec in self.active:
            rec[1].append(data)


def page_elements(html: str | None, tag: str, css_class: str | None = None,
                  attr: str | None = None, parent: str | None = None,
                  elem_id: str | None = None) -> list[tuple]:
    p = _ElementParser(tag.lower(), css_class, attr, parent, elem_id)
    _guarded_feed(p, html or "")
    return [(par, "".join(parts).strip(), a) for par, parts, a in p.found]


def extract_html_elements(pages: DataFrame, tag: str, *, key: str = "page_id",
                          html_col: str = "html", css_class: str | None = None,
                          attr: str | None = None, parent: str | None = None,
                          elem_id: str | None = None) -> DataFrame:
    """Every ``tag`` element (with ``css_class`` / ``id``, having ``attr``,
    directly inside ``parent``) of every page → ``(key, elem_idx, parent,
    text, attr)``; ``attr`` holds the attribute value (e.g. ``href``)."""
    key_type = pages.schema[key].dataType.simpleString()
    schema = ELEMENT_SCHEMA.format(key=key, key_type=key_type)
    cols = [key, "elem_idx", "parent", "text", "attr"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, html in zip(pdf[key], pdf[html_col]):
                for i, (par, text, a) in enumerate(page_elements(html, tag, css_class, attr, parent,
                                                                 elem_id)):
                    out.append((k, i, par, text, a))
            yield pd.DataFrame(out, columns=cols)

    return pages.select(key, html_col).mapInPandas(run, schema)


# Fixed value: the source-URL pattern (http(s), ftp, gs, s3 up to whitespace).
URL_PATTERN = r"(https?://\S+|ftp://\S+|gs://\S+|s3://\S+)"

# URL classes by scheme / file extension.
FILE_EXTENSIONS = ("csv", "tsv", "txt", "json", "parquet", "orc", "xlsx", "xls", "zip",
                   "gz", "tar", "pdf", "feather")
DATABASE_EXTENSIONS = ("db", "sqlite", "sqlite3", "duckdb")


def url_class(url: Column) -> Column:
    """object_store (s3/gs), ftp, database (database-file extension), file
    (data-file extension), api (``/api`` path or ``api.`` host), html
    (everything else over http)."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z0-9+.-]+://[^/?#]*([^?#]*)", 1))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z0-9+.-]+://([^/?#:]*)", 1))
    ext = F.regexp_extract(path, r"\.([a-z0-9]+)$", 1)
    return (F.when(url.rlike("^(s3|gs)://"), F.lit("object_store"))
            .when(url.startswith("ftp://"), F.lit("ftp"))
            .when(ext.isin(list(DATABASE_EXTENSIONS)), F.lit("database"))
            .when(ext.isin(list(FILE_EXTENSIONS)), F.lit("file"))
            .when(path.rlike(r"(^|/)api(/|$)") | host.startswith("api."), F.lit("api"))
            .otherwise(F.lit("html")))


def harvest_urls(df: DataFrame, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """All source URLs in a text column → ``(*keep, url, scheme, host, kind)``."""
    found = df.select(*keep, text_col).select(
        *keep, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(URL_PATTERN), F.lit(1))).alias("url"))
    return found.select(
        *keep, "url",
        F.lower(F.regexp_extract("url", r"^([a-zA-Z0-9+.-]+)://", 1)).alias("scheme"),
        F.lower(F.regexp_extract("url", r"^[a-zA-Z0-9+.-]+://([^/?#:]*)", 1)).alias("host"),
        url_class(F.col("url")).alias("kind"))
