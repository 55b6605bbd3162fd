"""Column expressions over text. All built-in functions, so they stay in
whole-stage codegen; nothing here runs Python per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a pandas CSV read treats as missing by default.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# The characters Python's str.strip() removes (str.isspace()).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Strip leading and trailing whitespace of every kind (as str.strip()),
    by a character-set trim rather than a regex."""
    return F.btrim(col_of(c), F.lit(WHITESPACE))


def null_if_missing(c: Column | str, tokens: Iterable[str] = MISSING_WORDS) -> Column:
    """NULL when the value is one of the missing-value words."""
    c = col_of(c)
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def starts_with(c: Column | str, prefix: str) -> Column:
    """Prefix test with missing → false."""
    return F.coalesce(F.startswith(col_of(c), F.lit(prefix)), F.lit(False))


def ends_with(c: Column | str, suffix: str) -> Column:
    """Suffix test with missing → false."""
    return F.coalesce(F.endswith(col_of(c), F.lit(suffix)), F.lit(False))


def replace_all(c: Column | str, pairs: Iterable[tuple[str, str]]) -> Column:
    """Chained literal replacements (no regex)."""
    out = col_of(c)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def shape_mask(c: Column | str) -> Column:
    """Shape of a code: digits → 9, letters → A, everything else kept."""
    return F.regexp_replace(F.regexp_replace(col_of(c), r"[0-9]", "9"),
                            r"(?U)[^\W\d_]", "A")


# Markdown-fence and first-code-line patterns of the two
# response cleaners being matched.
# (?d): only "\n" ends a line for ^ and $, as in Python's re.MULTILINE.
_FENCE_OPEN = r"(?md)^```(?:python)?"
_FENCE_CLOSE = r"(?md)```$"
_FENCE_OPEN_ANY = r"(?md)^```[a-zA-Z0-9]*\n?"
_FENCE_CLOSE_NL = r"(?md)\n?```$"
_FIRST_CODE_LINE = r"^import\s|^from\s|^\w+\s*=|^\s*def\s"
# All text before the first code line (nothing where there is none).
_BEFORE_CODE = rf"(?mdU)\A(?s:.*?)(?={_FIRST_CODE_LINE})"

# Fixed value: the line boundaries of Python's str.splitlines().
_LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def strip_fences(c: Column | str, code_only: bool = True) -> Column:
    """Remove Markdown code fences from a response text.

    ``code_only=True``: fences with an optional ``python`` tag are removed
    and any prose before the first import / from / assignment / def line is
    dropped (no such line → text kept). ``code_only=False``: fences with any
    language tag are removed, prose kept. NULL → ''.
    """
    c = col_of(c)
    if code_only:
        code = F.regexp_replace(strip_ws(c), _FENCE_OPEN, "")
        code = F.regexp_replace(strip_ws(code), _FENCE_CLOSE, "")
        code = F.regexp_replace(code, _BEFORE_CODE, "")
    else:
        code = F.regexp_replace(strip_ws(c), _FENCE_OPEN_ANY, "")
        code = F.regexp_replace(strip_ws(code), _FENCE_CLOSE_NL, "")
    return F.coalesce(strip_ws(code), F.lit(""))


def lines_of(c: Column | str) -> Column:
    """Split on the line breaks str.splitlines() knows (\\n, \\r\\n, \\r,
    VT, FF, FS, GS, RS, NEL, LS, PS)."""
    return F.split(col_of(c), _LINE_BREAK)


def last_line(c: Column | str, skip_prefixes: Iterable[str] = ()) -> Column:
    """Last non-empty line, stripped; lines starting with any of
    ``skip_prefixes`` are passed over. NULL when there is none."""
    stripped = F.transform(lines_of(c), strip_ws)
    prefixes = list(skip_prefixes)

    def keep(x: Column) -> Column:
        cond = x != F.lit("")
        for p in prefixes:
            cond = cond & ~F.startswith(x, F.lit(p))
        return cond

    return F.try_element_at(F.filter(stripped, keep), F.lit(-1))


def block_text(content: Column | str, nested: bool = False) -> Column:
    """Text of a response made of typed blocks.

    ``content`` is ``ARRAY<STRUCT<type, text[, content ARRAY<STRUCT<type,
    text>>]>>``. Text blocks contribute their text, tool results their text
    (or, with ``nested=True``, the text items inside them); each piece is
    followed by a newline, as the blocks were concatenated.
    """
    content = col_of(content)

    def piece(b: Column) -> Column:
        if nested:
            inner = F.transform(
                F.filter(F.coalesce(b["content"], F.array()),
                         lambda i: i["type"] == F.lit("text")),
                lambda i: F.concat(i["text"], F.lit("\n")))
            tool = F.when(F.size(F.coalesce(b["content"], F.array())) > 0,
                          F.array_join(inner, ""))\
                .otherwise(F.concat(b["text"], F.lit("\n")))
        else:
            tool = F.concat(b["text"], F.lit("\n"))
        return F.when(b["type"] == F.lit("text"), F.concat(b["text"], F.lit("\n")))\
            .when(b["type"] == F.lit("tool_result"), tool)

    return F.array_join(F.transform(content, piece), "")
