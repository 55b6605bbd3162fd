"""Token counts by count-only Viterbi over a unigram vocabulary (operator 2).

An Aho-Corasick automaton enumerates, at every place of a text, the vocabulary
pieces that end there; dynamic programming carries the best score and its
number of pieces, and no path. The rules are those of the ``tokenizers``
Unigram model: scores are summed in double precision; of equal scores the
piece that begins first (the longest) wins; a character without a piece of its
own may also be read as unknown, at the lowest score less 10, and counts as
its UTF-8 bytes (byte fallback). Spaces become "▁", and a text that is not
empty gets one in front.

No piece of the vocabulary holds a "▁" behind another character, so every
piece begins anew at a "▁" and a text's count is the sum of its segments'. A
worker remembers the counts of ``KNOWN_SEGMENTS`` segments; others are counted
each time. A vocabulary with such pieces is counted on whole texts.

The default vocabulary is the public 32k piece file read as a unigram model
(its pieces and scores): there is no unigram file among the public ones.

Defined cases: NULL and empty texts have 0 tokens; repeated rows get equal
counts; an empty table gives no rows; an input column named ``n_tokens`` is
replaced.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, add_fields, column, text_slices

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KNOWN_SEGMENTS = 400_000

_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_STATE: dict = {}


def load_vocabulary(name: str = VOCABULARY) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece file (a path or the name of
    a public vocabulary); control, unknown and byte pieces are left out."""
    import public_tokenizers
    import sentencepiece
    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), float(m.get_score(i))) for i in range(m.get_piece_size())
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


class UnigramCounter(dict):
    """Counts of segments by segment; worked out when first asked for."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__()
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.splits = not any(SPACE in p.lstrip(SPACE) for p, _ in vocabulary)

    def viterbi(self, text: str) -> int:
        """Pieces of the best segmentation of a text in which spaces are marked."""
        n = len(text)
        best: list = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        matches = self.automaton.iter(text)             # by end; of one end, longest first
        end, found = next(matches, (n, None))
        for i in range(n):
            top, pieces = None, 0
            while end == i and found is not None:
                size, score = found
                before = best[i + 1 - size]
                if before is not None and (top is None or before + score > top):
                    top, pieces = before + score, count[i + 1 - size] + 1
                end, found = next(matches, (n, None))
            if text[i] not in self.single and best[i] is not None:
                if top is None or best[i] + self.unknown > top:
                    top, pieces = best[i] + self.unknown, count[i] + len(text[i].encode())
            best[i + 1], count[i + 1] = top, pieces
        return count[n]

    def __missing__(self, segment: str) -> int:
        n = self.viterbi(SPACE + segment)
        if len(self) < KNOWN_SEGMENTS:
            self[segment] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.splits:
            return self.viterbi(SPACE + text.replace(" ", SPACE))
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.__getitem__, text.split(" ")))
        marked = SPACE + text.replace(" ", SPACE)
        return sum(self[s[1:]] for s in _SEGMENT.findall(marked))


def counter(name: str = VOCABULARY) -> UnigramCounter:
    """The counter of a vocabulary, kept by the worker."""
    if name not in _STATE:
        _STATE[name] = UnigramCounter(load_vocabulary(name))
    return _STATE[name]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text",
                 columns: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens``. With ``columns``, only these columns come back with it."""
    base = docs if columns is None else docs.select(*columns, *(c for c in [text_col] if c not in columns))
    kept = [f for f in base.schema.fields if columns is None or f.name in columns]
    schema = add_fields(T.StructType(kept), [T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary)
        for batch in batches:
            for part in text_slices(batch, text_col):
                n = [counts.count(t) for t in column(part, text_col).to_pylist()]
                part = part.select([f.name for f in kept])
                yield add_columns(part, {"n_tokens": pa.array(n, pa.int64())})

    return base.mapInArrow(run, schema)
