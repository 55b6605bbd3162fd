"""Chat formatting with typed content parts (operator 4).

A turn's content is a list of parts: text, image, audio or document. A visitor
flattens them, in order, into one string in which every attachment is a
placeholder, and records the attachment's reference, place and the number of
tokens it will be expanded to. Content that is not a JSON list of such parts
is one text part.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings
inside texts and roles (the template's own, the placeholders and those of
other templates) are broken up by an escape sign after their first character;
an escape sign of the text itself is doubled. That is reversible:
``read_turn`` gives back role and text. The loss mask is a range of characters
of the written turn: the text of an assistant's turn.

Formatting works row by row. A conversation's turns are only brought together
to be put in order (a shuffle on the conversation, sorted inside partitions),
and readers go through them one after another, so a conversation of any length
passes through a task without ever being held as a whole.

Defined cases: NULL text is empty, NULL role is an empty role, turns without a
number come first; equal turn numbers are ordered by role and text, repeated
rows stay; NULL conversation ids are one conversation; an empty table gives
no rows; other columns of the input are kept, and replaced where their name
is an output's.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, add_fields, column

START, END = "<|im_start|>", "<|im_end|>\n"
ESCAPE = "␛"
# Strings that must not stand in a text as they are (fixed values). "<|" covers
# the marks above, the placeholders and all of their kind.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
ROLE_WITH_LOSS = "assistant"

_CONTROL = re.compile("|".join(f"(?={re.escape(c)})" for c in CONTROL))
_UNESCAPE = re.compile(f"{ESCAPE}({ESCAPE}?)")
_UNESCAPE_ROLE = re.compile(f"{ESCAPE}({ESCAPE}|n)?")


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE * 2)
    if "<" not in text and "[" not in text:
        return text
    at = [m.start() for m in _CONTROL.finditer(text)]
    return "".join(text[a:b + 1] + ESCAPE if b is not None else text[a:]
                   for a, b in zip([0] + [i + 1 for i in at], at + [None]))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", ESCAPE + "n")


def unescape_role(role: str) -> str:
    return _UNESCAPE_ROLE.sub(lambda m: {"n": "\n"}.get(m[1], m[1] or ""), role)


# -- typed parts -----------------------------------------------------------------

LARGEST = 1e6                   # of a number in a part; more counts as that many


def number_of(part: dict, key: str, default: float) -> float:
    """A part's number: ``default`` where it is none, 0 to ``LARGEST``."""
    value = part.get(key)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
        return default
    return float(min(max(value, 0), LARGEST))


@dataclass(frozen=True)
class Expansion:
    """Tokens that a placeholder stands for."""
    patch: int = 28                 # pixels of an image patch's side
    per_second: float = 25.0        # audio
    per_page: int = 576             # document

    def tokens(self, part: dict) -> int:
        if part["type"] == "image":
            return max(1, math.ceil(number_of(part, "width", self.patch) / self.patch)) \
                * max(1, math.ceil(number_of(part, "height", self.patch) / self.patch))
        if part["type"] == "audio":
            return max(1, math.ceil(number_of(part, "seconds", 0.0) * self.per_second))
        return max(1, math.ceil(number_of(part, "pages", 1.0))) * self.per_page


class PartVisitor:
    """Flattens parts: text with placeholders, ``attachments`` in order. Texts
    that follow one another are escaped as one, so that no control string can
    be put together from two of them. (Nor from a text and a placeholder: a
    placeholder's first and last signs are inside no control string's.)"""

    def __init__(self, expansion: Expansion):
        self.expansion = expansion
        self.done: list[str] = []
        self.run: list[str] = []
        self.attachments: list[dict] = []
        self.length = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}")(part)

    def _add(self, text: str) -> None:
        self.done.append(text)
        self.length += len(text)

    def _close(self) -> None:
        if self.run:
            self._add(escape("".join(self.run)))
            self.run = []

    def visit_text(self, part: dict) -> None:
        self.run.append(part.get("text") or "")

    def _attach(self, part: dict) -> None:
        self._close()
        ref = part.get("ref")
        self.attachments.append({"kind": part["type"], "ref": ref if isinstance(ref, str) else "",
                                 "at": self.length, "tokens": self.expansion.tokens(part)})
        self._add(PLACEHOLDERS[part["type"]])

    visit_image = visit_audio = visit_document = _attach

    def text(self) -> str:
        self._close()
        return "".join(self.done)


def _is_part(part) -> bool:
    if not isinstance(part, dict) or not isinstance(part.get("type"), str):
        return False
    if part["type"] == "text":
        return part.get("text") is None or isinstance(part["text"], str)
    return part["type"] in PLACEHOLDERS


def parts_of(content: str | None) -> list[dict] | None:
    """The typed parts of a turn's content, or None where it is plain text: also
    JSON that is nested too deeply to read, or that names half a character
    (a lone surrogate), which no text column holds."""
    if content and content.startswith("[{"):
        try:
            parts = json.loads(content)
            json.dumps(parts, ensure_ascii=False).encode()
        except (ValueError, RecursionError):
            return None
        if isinstance(parts, list) and all(map(_is_part, parts)):
            return parts
    return None


def write_turn(role: str | None, content: str | None, typed: bool = True,
               expansion: Expansion = Expansion()) -> tuple[str, int, int, list[dict], str | None]:
    """(written turn, start and end of its loss mask, attachments, the content
    itself where it was read as typed parts)."""
    visitor = PartVisitor(expansion)
    parts = parts_of(content) if typed else None
    for part in [{"type": "text", "text": content or ""}] if parts is None else parts:
        visitor.visit(part)
    head = START + escape_role(role or "") + "\n"
    body = visitor.text()
    loss = (len(head), len(head) + len(body)) if role == ROLE_WITH_LOSS else (0, 0)
    for a in visitor.attachments:
        a["at"] += len(head)
    return head + body + END, *loss, visitor.attachments, content if parts is not None else None


def read_turn(written: str) -> tuple[str, str]:
    """Role and text of a written turn (placeholders stay)."""
    head, body = written[len(START):-len(END)].split("\n", 1)
    return unescape_role(head), unescape(body)


ATTACHMENT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()),
                           T.StructField("at", T.LongType()), T.StructField("tokens", T.LongType())])
OUTPUT = [T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.LongType()),
          T.StructField("loss_end", T.LongType()), T.StructField("attachments", T.ArrayType(ATTACHMENT)),
          T.StructField("attachment_tokens", T.LongType()), T.StructField("typed_content", T.StringType())]
_ARROW_ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()),
                                         ("at", pa.int64()), ("tokens", pa.int64())]))


def format_turns(turns: DataFrame, typed: bool = True, expansion: Expansion = Expansion(),
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Adds the written turn, its loss range, its attachments and their tokens,
    and ``typed_content``: the content of a turn that was read as parts (NULL for
    plain text, which the written turn gives back by itself). With ``typed`` off,
    content is text even where it looks like parts."""
    schema = add_fields(turns.schema, OUTPUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [write_turn(r, t, typed, expansion) for r, t in zip(
                column(batch, role_col).to_pylist(), column(batch, text_col).to_pylist())]
            yield add_columns(batch, {
                "formatted": pa.array([g[0] for g in got], pa.string()),
                "loss_start": pa.array([g[1] for g in got], pa.int64()),
                "loss_end": pa.array([g[2] for g in got], pa.int64()),
                "attachments": pa.array([g[3] for g in got], _ARROW_ATTACHMENTS),
                "attachment_tokens": pa.array([sum(a["tokens"] for a in g[3]) for g in got], pa.int64()),
                "typed_content": pa.array([g[4] for g in got], pa.string())})

    return turns.mapInArrow(run, schema)


# -- reading back ------------------------------------------------------------------

def conversation_digests(formatted: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn"
                         ) -> DataFrame:
    """Per conversation, read from the written turns in order: n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments,
    attachment_tokens. A turn of typed parts reads back as its content."""
    cells = ["formatted", "loss_start", "loss_end", "typed_content", "n_attachments", "attachment_tokens"]
    ordered = formatted.withColumn("n_attachments", F.size("attachments").cast("long")) \
        .select(conv_col, turn_col, "role", "text", *cells) \
        .repartition(conv_col).sortWithinPartitions(conv_col, turn_col, "role", "text")
    ordered = ordered.select(conv_col, *cells)
    schema = T.StructType([
        formatted.schema[conv_col], T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
        T.StructField("n_attachments", T.LongType()), T.StructField("attachment_tokens", T.LongType())])
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None                       # the conversation being read
        for batch in batches:
            done = []
            for conv, text, start, end, content, n, tokens in zip(*(
                    column(batch, c).to_pylist() for c in (conv_col, *cells))):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, *result(state)))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, said = read_turn(text)
                said = said if content is None else content
                loss = unescape(text[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(text)
                state[5] += n
                state[6] += tokens
            if done:
                yield rows(done, batch)
        if state is not None:
            yield rows([(now, *result(state))], batch)

    def result(s: list) -> tuple:
        return s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), *s[4:]

    def rows(done: list, batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [column(batch, conv_col).type, *arrow]
        return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*done), kinds)],
                                          names=schema.names)

    return ordered.mapInArrow(run, schema)


def attachment_totals(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Attachments and expanded tokens per conversation."""
    return formatted.groupBy(conv_col).agg(
        F.sum(F.size("attachments")).alias("n_attachments"),
        F.sum("attachment_tokens").alias("attachment_tokens"))


# The digests in DuckDB SQL, with conversation -7 of the query. The escape signs
# of a text are the doubled ones and one per control string. SQL states plain
# text; the tables hold no turn of typed parts, for which it would not hold.
_MARKS = " + ".join(
    f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in [*CONTROL, ESCAPE])
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (r = '{ROLE_WITH_LOSS}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = '{ROLE_WITH_LOSS}'), ''))
    AS loss_sha256,
  sum({len(START) + 1 + len(END)} + length(r) + {_MARKS.format("r")}
      + (length(r) - length(replace(r, chr(10), ''))) + length(x) + {_MARKS.format("x")})::BIGINT
    AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM t GROUP BY conv_id
"""
