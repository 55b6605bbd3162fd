"""Answer-shaped scalar expressions: number text, sentences, JSON text,
data URIs, day differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablework.functions.text import col_of

# Fixed value: size limit of an embedded chart/data URI, in characters.
DATA_URI_LIMIT = 100_000


def fmt_number(c: Column | str, decimals: int = 2, percent: bool = False) -> Column:
    """``'%.2f'`` text (``'%.2f%%'`` with ``percent``). Spark rounds ties half
    up on the decimal text (2.675 → 2.68) where Python gives 2.67."""
    pattern = f"%.{int(decimals)}f" + ("%%" if percent else "")
    return F.format_string(pattern, col_of(c))


def sentence(template: str, *cols: Column | str) -> Column:
    """Labelled answer text: ``sentence('Top: %s with %d rows', key, n)``."""
    return F.format_string(template, *[col_of(c) for c in cols])


def json_text(*cols: Column | str, names: list[str] | None = None) -> Column:
    """One JSON object per row from the given columns."""
    cs = [col_of(c) for c in cols]
    if names:
        cs = [c.alias(n) for c, n in zip(cs, names)]
    return F.to_json(F.struct(*cs))


def data_uri(binary: Column | str, mime: str = "image/png") -> Column:
    """``data:<mime>;base64,<payload>`` of a binary column."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(col_of(binary)))


def within_uri_limit(uri: Column | str, limit: int = DATA_URI_LIMIT) -> Column:
    return F.length(col_of(uri)) < F.lit(limit)


def days_between(end: Column | str, start: Column | str) -> Column:
    """Whole days from ``start`` to ``end`` (sign kept); timestamps are
    truncated to their date first."""
    return F.datediff(col_of(end).cast("date"), col_of(start).cast("date"))
