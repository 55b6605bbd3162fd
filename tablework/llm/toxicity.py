"""Toxicity: noisy-channel deobfuscation, then a score of the restored text (operator 6).

Three parts:

* A character language model: trigram counts over the words of *all* documents,
  summed in every task and then by Spark. The alphabet is fixed (``ALPHABET``,
  with a word edge and one class for all else), so the table that reaches the
  driver has at most ``len(ALPHABET) ** 3`` rows, whatever the corpus holds.
* Restoration: a token that is not a plain word (leetspeak signs at any place,
  letters three times running, single letters set apart by spaces or signs)
  becomes a lattice of readings; each character may stand for
  itself, for the letters that sign is used for, or for nothing where it
  repeats or separates. Single letters set apart are one lattice over the whole
  run, in which a separator may also be a word edge. Two neighbours are one word
  if that is a learned one and likelier than the two. A Viterbi search finds the likeliest reading under the
  language model and the channel's costs. Plain words stay as they are. A token
  that is read as no learned word is also read part by part, between its inner
  signs; one of digits and signs alone changes only into a learned word.
* The score: evidence features are restored words and their prefixes. Learned
  are those that stand in so many labelled toxic documents, and in so few
  others, that chance is ruled out; near copies among the labelled rows count
  once, so that what only copies share is not learned. Every distinct word of a
  text speaks with its strongest feature, the words together as a noisy-or, and
  the strength of that evidence is calibrated to a probability (isotonic).

Fitting takes ``PER_CLASS`` labelled rows of either class (a documented bound);
texts are read whole. Scoring reads every whole text.

Defined cases: NULL and empty texts have no words and get the score of texts
without evidence; repeated rows get equal scores; without labels of both kinds
every score is 0.5 or less; input columns named like an output column are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, add_fields, column, text_slices, written
from .labelled import sample_ids

# Letters of the language model; index 0 is a word edge, 1 all other characters.
ALPHABET = "  abcdefghijklmnopqrstuvwxyzßàáâäçèéêëìíîïñòóôöùúûüœ"
# What signs are used for in place of letters (fixed values).
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "#": "h",
}
SIGN_COST, SELF_COST, REPEAT_COST, GAP_COST = 1.0, 7.0, 0.6, 0.4
# A separator as a word edge (a single one, a wider one), a wide one as nothing;
# "*" as a vowel; two neighbours as one word.
EDGE_COST, WIDE_EDGE_COST, WIDE_GAP_COST, VOWEL_COST, JOIN_COST = 1.0, 0.0, 2.5, 2.0, 1.0
VOWELS = "aeiou"
PER_CLASS, PREFIXES, CHANCE, PURITY, MIN_WORDS = 3000, range(4, 9), 1e-7, 0.08, 4
TOXIC = 0.7                     # predicted = 1 from this score on
KNOWN_TOKENS, KNOWN_LENGTH = 300_000, 64     # remembered per worker, and how long at most

_INDEX = {c: i for i, c in enumerate(ALPHABET) if i > 1}
_LUT = np.ones(0x3000, np.int64)
for _c, _i in _INDEX.items():
    _LUT[ord(_c)] = _i
_LUT[[32, *range(9, 14)]] = 0
_SIZE = len(ALPHABET)

_LETTERS = "a-zß-öø-ÿœ"
_PLAIN = re.compile(rf"[{_LETTERS}]+(?:['’-][{_LETTERS}]+)*")
_TRIPLE = re.compile(r"(.)\1\1")
_EDGE_MARKS = ".,;:?\"'()[]{}*_~-!"
_GAPS = " .-_*'’~,;:/\t\n\r"
# Letters of other widths are read as plain ones, signs without width as nothing.
_WIDTHS = re.compile("[\xad\u200b-\u200f\u2060\ufeff\uff01-\uff5e]")
_NARROW = dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]) | {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
# Punctuation that sets words apart, and all that is neither letter nor digit.
_HARD = re.compile(r"[,;:/\\?\"“”()\[\]{}&=—–…«»]+")
_INNER = re.compile(rf"[^{_LETTERS}0-9]+")
_RUN = re.compile(r"(.)\1{2,}")
# Letters one by one, with separators between them: "s t u p i d".
_SPACED = re.compile(rf"(?<![{_LETTERS}0-9@$!|+€£])(?:[{_LETTERS}0-9@$!|+€£][{re.escape(_GAPS)}]+){{2,}}"
                     rf"[{_LETTERS}0-9@$!|+€£](?![{_LETTERS}0-9])")
_BETWEEN = re.compile(f"([{re.escape(_GAPS)}]+)")



# -- language model ---------------------------------------------------------------

def corpus_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): counts of character trigrams over the words of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE ** 3, np.int64)
        for batch in batches:
            for part in text_slices(batch, text_col):
                texts = [t for t in column(part, text_col).to_pylist() if t]
                points = np.frombuffer(" ".join([""] + texts + [""]).lower().encode("utf-32-le"), "<u4")
                c = _LUT[np.minimum(points, len(_LUT) - 1)]
                total += np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=_SIZE ** 3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    counts = docs.select(text_col).mapInArrow(run, "code long, n long")
    return counts.groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Negative log probability of a character after two others, smoothed by
    the shorter contexts."""
    counts = np.zeros(_SIZE ** 3)
    for code, n in corpus_trigrams(docs, text_col).collect():     # <= len(ALPHABET) ** 3 rows
        counts[code] = n
    tri = counts.reshape(_SIZE, _SIZE, _SIZE)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + _SIZE)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


# -- restoration -------------------------------------------------------------------

@dataclass
class Channel:
    """The noisy channel: costs of readings and the language model's."""
    cost: np.ndarray
    lexicon: dict = field(default_factory=dict)     # squeezed spelling -> learned word
    known: dict = field(default_factory=dict)
    learned: frozenset = frozenset()                # features with a weight

    def __getstate__(self):
        return {"cost": self.cost, "lexicon": self.lexicon, "learned": self.learned}

    def __setstate__(self, state):
        self.__dict__ = {**state, "known": {}}

    def decode(self, noisy: str) -> str:
        """The likeliest reading of a token (Viterbi over its lattice).

        A state is the last two letters read; an arc reads one character as a
        letter, or as nothing where it repeats the one before or separates.
        """
        states: dict = {(0, 0): (0.0, None)}            # cost; letters read, the last one first
        before = ""
        for ch in noisy:
            arcs = [(c, SIGN_COST) for c in STANDS_FOR.get(ch, "")]
            if ch == "*" and before:
                arcs = [(c, VOWEL_COST) for c in VOWELS]
            own = _INDEX.get(ch, 1)
            if own > 1:
                arcs.append((ch, 0.0))
            elif not arcs or ch.isdigit() or ch == "*":
                arcs.append((ch, SELF_COST))
            nothing = None
            if ch == before:
                nothing = REPEAT_COST
            elif ch in _GAPS:
                nothing = GAP_COST
            after: dict = {}
            for (a, b), (cost, text) in states.items():
                for c, price in arcs:
                    i = _INDEX.get(c, 1)
                    total = cost + price + float(self.cost[a, b, i])
                    if (b, i) not in after or total < after[b, i][0]:
                        after[b, i] = (total, (text, c))
                if nothing is not None:
                    total = cost + nothing
                    if (a, b) not in after or total < after[a, b][0]:
                        after[a, b] = (total, text)
            states, before = after, ch
        best = min(states, key=lambda ab: states[ab][0] + float(self.cost[ab[0], ab[1], 0]))
        text, letters = states[best][1], []
        while text:
            text, c = text
            letters.append(c)
        return "".join(reversed(letters))

    def decode_run(self, run: str) -> list[str]:
        """The likeliest words of single letters set apart: every separator is
        nothing or a word edge, the wider the likelier an edge."""
        states: dict = {(0, 0): (0.0, None)}
        parts = _BETWEEN.split(run)                     # letter, separator, letter, ...
        usual = min(map(len, parts[1::2]), default=1)
        for k, part in enumerate(parts):
            after: dict = {}

            def reach(state, total, text):
                if state not in after or total < after[state][0]:
                    after[state] = (total, text)

            if k % 2:
                wide = len(part) > usual
                for (a, b), (cost, text) in states.items():
                    reach((a, b), cost + (WIDE_GAP_COST if wide else GAP_COST), text)
                    edge = WIDE_EDGE_COST if wide else EDGE_COST
                    reach((b, 0), cost + edge + float(self.cost[a, b, 0]), (text, " "))
            else:
                arcs = [(c, SIGN_COST) for c in STANDS_FOR.get(part, "")]
                if _INDEX.get(part, 1) > 1 or not arcs or part.isdigit():
                    arcs.append((part, 0.0 if part in _INDEX else SELF_COST))
                for (a, b), (cost, text) in states.items():
                    for c, price in arcs:
                        i = _INDEX.get(c, 1)
                        reach((b, i), cost + price + float(self.cost[a, b, i]), (text, c))
            states = after
        best = min(states, key=lambda ab: states[ab][0] + float(self.cost[ab[0], ab[1], 0]))
        text, letters = states[best][1], []
        while text:
            text, c = text
            letters.append(c)
        return [self.lexicon.get(_squeezed(w), w) for w in "".join(reversed(letters)).split(" ") if w]

    def word_cost(self, word: str) -> float:
        """The language model's cost of a plain word, edges included."""
        a, b, total = 0, 0, 0.0
        for c in [_INDEX.get(c, 1) for c in word] + [0]:
            total += float(self.cost[a, b, c])
            a, b = b, c
        return total

    def joined(self, tokens: list[str]) -> list[str]:
        """Learned words that stand cut in two, as neighbours."""
        out = []
        for a, b in zip(tokens, tokens[1:]):
            word = a + b
            if word in self.learned or (word := word.rstrip(_EDGE_MARKS)) in self.learned:
                rest = word[len(a):]
                if rest and self.word_cost(word) + JOIN_COST < self.word_cost(a) + self.word_cost(rest):
                    out.append(word)
        return out

    def runs(self, text: str) -> Iterator[tuple[int, int, list[str]]]:
        """(start, end, words) of the runs of single letters set apart."""
        for m in _SPACED.finditer(text):
            got = self.decode_run(m.group())
            if not self.speaks(got):
                whole = self.readings(m.group())
                got = [whole] if self.speaks([whole]) else got
            if any(c in _INDEX for c in m.group()) or self.speaks(got):
                yield m.start(), m.end(), got           # else numbers in a row

    def readings(self, noisy: str) -> str:
        """The decoded token, or the learned word that differs from it only in how
        often its letters stand next to themselves."""
        got = self.decode(_RUN.sub(r"\1\1", noisy))
        return self.lexicon.get(_squeezed(got), got)

    def speaks(self, words: list[str]) -> bool:
        """Whether a word has a learned feature."""
        return bool(self.learned) and any(f in self.learned for w in words for f in features(w))

    def words(self, token: str) -> list[str]:
        """The restored words of a lower-case token without white space."""
        got = self.known.get(token)
        if got is None:
            got = self._read(token)
            if len(self.known) < KNOWN_TOKENS and len(token) <= KNOWN_LENGTH:
                self.known[token] = got
        return got

    def _read(self, token: str) -> list[str]:
        core = token.strip(_EDGE_MARKS)
        plain = bool(_PLAIN.fullmatch(core)) and not _TRIPLE.search(core)
        signs = token.strip(".,;:?\"')[]{}*_~-")         # with "!" and "(", which stand for letters
        if plain and (core.isalpha() and signs == core or core in self.learned):
            return [core]
        if not any(c in _INDEX or c in STANDS_FOR for c in signs):
            return [core] if core else []
        noisy = signs.lstrip("(").rstrip("!")
        read = [self.readings(x) for x in dict.fromkeys((noisy, signs)) if x and not (plain and x.isalpha())]
        for word in read:
            if word in self.learned:
                return [word]
        hard = [x for x in _HARD.split(core) if x]
        parts = [w for x in hard for w in self.words(x)] if len(hard) > 1 else []
        if self.speaks(parts):
            return parts
        inner = [x for x in _INNER.split(core) if x]
        small = [w for x in inner for w in self.words(x)] if inner != [core] else []
        if self.speaks(small):
            return small
        for word in read:
            if self.speaks([word]):
                return [word]
        if plain or not any(c in _INDEX for c in noisy):
            return parts or ([core] if core else [])
        return parts or read[:1]

    def restore(self, text: str) -> list[str]:
        """The words of a text with obfuscated ones restored, edge marks dropped."""
        text = plain_case(text)
        words, at = [], 0
        for start, end, got in self.runs(text):
            for token in text[at:start].split():
                words += self.words(token)
            words += got
            at = end
        for token in text[at:].split():
            words += self.words(token)
        return words + self.joined(text.split())


def plain_case(text: str) -> str:
    """Lower case, plain widths, nothing without width."""
    if not text.isascii() and _WIDTHS.search(text):
        text = text.translate(_NARROW)
    return text.lower()


def _squeezed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


# -- evidence ------------------------------------------------------------------------

def features(word: str) -> list[str]:
    """A restored word and its prefixes ("stem~"), where it is long enough."""
    if len(word) < 3:
        return []
    return [word] + [word[:n] + "~" for n in PREFIXES if n <= len(word)]


def evidence(words: list[str]) -> set[str]:
    return {f for w in set(words) for f in features(w)}


@dataclass
class ToxicityModel:
    channel: Channel
    weights: dict                # feature -> probability that a document with it is toxic

    steps: tuple = ((0.0,), (0.5,))      # strength of evidence -> probability
    seen: dict = field(default_factory=dict)     # token -> words with evidence, of a worker

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def speaking(self, words: list[str]) -> tuple:
        """(word, weight of its strongest feature) of the words that have one."""
        get = self.weights.get
        found = ((w, max((get(f, 0.0) for f in features(w)), default=0.0)) for w in words)
        return tuple((w, p) for w, p in found if p)

    def text_strength(self, text: str) -> float:
        """``strength`` of a text's restored words. Distinct tokens are looked up
        once in a worker's memory, where most have no evidence at all."""
        text, channel, spoken, at, rest = plain_case(text), self.channel, {}, 0, []
        for start, end, got in channel.runs(text):
            rest.append(text[at:start])
            spoken.update(self.speaking(got))
            at = end
        tokens = " ".join([*rest, text[at:]]).split() if rest else text.split()
        seen = self.seen
        for token in set(tokens):
            found = seen.get(token)
            if found is None:
                found = self.speaking(channel.words(token))
                if len(seen) < KNOWN_TOKENS and len(token) <= KNOWN_LENGTH:
                    seen[token] = found
            if found:
                spoken.update(found)
        spoken.update(self.speaking(channel.joined(text.split() if rest else tokens)))
        return -sum(math.log1p(-p) for _, p in sorted(spoken.items()))

    def strength(self, words: set[str]) -> float:
        """Every distinct word with its strongest feature, as a noisy-or."""
        get = self.weights.get
        best = (max((get(f, 0.0) for f in features(w)), default=0.0) for w in sorted(words))
        return -sum(math.log1p(-w) for w in best if w)

    def score(self, text: str | None) -> float:
        e = self.text_strength(text or "") if self.weights else 0.0
        edges, levels = self.steps
        p = levels[bisect_right(edges, e) - 1]
        return 0.98 * p + 0.02 * (1 - math.exp(-e))


def lexicon_of(weights: dict) -> dict:
    return {_squeezed(w): w for w in sorted(weights) if not w.endswith("~")}


def _sketch(words: set[str]) -> list[int]:
    """MinHash band hashes of a document's words; near copies share one."""
    keys = np.random.default_rng(3).integers(1, 1 << 63, 12, dtype=np.uint64) | np.uint64(1)
    h = np.array([zlib.crc32(w.encode()) + 1 for w in words], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        low = [int(((h ^ (h >> np.uint64(29))) * k).min()) for k in keys]
    return [zlib.crc32(repr((b, low[3 * b:3 * b + 3])).encode()) for b in range(4)]


def _distinct(rows: list[tuple]) -> list[tuple]:
    """Rows (id, label, bands) without near copies of earlier rows."""
    seen, out = set(), []
    for i, y, bands in rows:
        if not any((y, b) in seen for b in bands):
            out.append((i, y))
        seen.update((y, b) for b in bands)
    return out


def _candidates(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, tuple[int, int]]:
    """Features of many toxic and few other documents, with both numbers. Counted
    by Spark over (__y, words); what comes back are those beyond chance."""
    need = max(3, int(np.ceil(np.log(CHANCE) / np.log(n_toxic / (n_toxic + n_clean)))))
    prefixes = lambda w: F.transform(
        F.filter(F.array(*[F.lit(n) for n in PREFIXES]), lambda n: n <= F.length(w)),
        lambda n: F.concat(F.substring(w, 1, n), F.lit("~")))
    each = F.array_distinct(F.flatten(F.transform("words", lambda w: F.concat(F.array(w), prefixes(w)))))
    counts = sample.select("__y", F.explode(each).alias("f")).groupBy("f").agg(
        F.sum("__y").alias("a"), F.sum(1 - F.col("__y")).alias("b"))
    counts = counts.where((F.col("a") >= need)
                          & (F.col("b") * F.lit(float(n_toxic)) <= F.lit(PURITY * n_clean) * F.col("a")))
    found = {r["f"]: (r["a"], r["b"]) for r in counts.collect()}
    stems = [f for f in found if f.endswith("~")]
    if not stems:
        return found
    # A prefix must stand for several words, or the word itself says it all.
    words = sample.where("__y = 1").select(F.explode("words").alias("w")).distinct()
    behind = words.select(F.explode(prefixes(F.col("w"))).alias("f")).where(F.col("f").isin(stems)) \
        .groupBy("f").count().where(F.col("count") >= MIN_WORDS)
    several = {r["f"] for r in behind.collect()}
    return {f: n for f, n in found.items() if f in several or not f.endswith("~")}


def _weights(found: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, prior: float) -> dict[str, float]:
    """Probability that a document with the feature is toxic. ``prior`` is the
    share of toxic rows among all labelled ones (the sample is balanced)."""
    out = {}
    for f, (n, m) in found.items():
        a, b = n / n_toxic * prior, (m + 0.1) / n_clean * (1 - prior)
        out[f] = a / (a + b)
    return out


def _steps(e: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple, tuple]:
    """Probability by strength of evidence, never falling (pooled adjacent
    violators over rows of equal strength)."""
    edges, at = np.unique(e, return_inverse=True)
    total, hit = np.bincount(at, weight), np.bincount(at, weight * y)
    blocks: list[list[float]] = []
    for k, x in enumerate(edges):
        blocks.append([float(x), total[k], hit[k]])
        while len(blocks) > 1 and blocks[-1][2] * blocks[-2][1] <= blocks[-2][2] * blocks[-1][1]:
            _, t, h = blocks.pop()
            blocks[-1][1] += t
            blocks[-1][2] += h
    small = float(weight.min())                         # no block is quite certain
    levels = [float((h + 0.1 * small) / (t + 0.2 * small)) for _, t, h in blocks]
    return (0.0, *(b[0] for b in blocks[1:])), tuple(levels)


def _draw(channel: Channel, id_col: str, text_col: str):
    """Restored distinct words of a document, and their sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                sets = [{w for w in channel.restore(t or "") if features(w)}
                        for t in column(part, text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [column(part, id_col), column(part, "__y"),
                     pa.array([_sketch(s) if s else [] for s in sets], pa.list_(pa.int64())),
                     pa.array([sorted(s) for s in sets], pa.list_(pa.string()))],
                    names=[id_col, "__y", "bands", "words"])
    return run


def _strengths(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = [model.strength(set(w)) for w in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__y"), pa.array(e, pa.float64())], names=["__y", "e"])
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None,
        id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Language model from all documents, evidence from the labelled rows allowed by
    ``keep``. The words of the sampled documents stay in a written table; the
    driver sees their sketches, the features beyond chance and two numbers a row."""
    channel = Channel(language_model(docs, text_col))
    held = labels if keep is None else labels.where(keep)
    share = held.agg(F.avg(F.when(F.col(label).isin(0, 1), F.col(label)))).first()[0]
    prior = float(share or 0.0)
    blank = ToxicityModel(channel, {}, ((0.0,), (min(0.5, prior),)))
    ids = sample_ids(labels, label, PER_CLASS, keep, id_col)
    drawn = docs.select(id_col, text_col).join(F.broadcast(ids), id_col).select(id_col, "__y", text_col)
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("__y", T.IntegerType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.StringType()))])
    sample = written(drawn.mapInArrow(_draw(channel, id_col, text_col), schema), "toxicity_sample")
    sketches = sample.where(F.size("words") > 0).select(id_col, "__y", "bands").collect()
    rows = _distinct(sorted((r[0], r[1], list(r[2])) for r in sketches))
    n_toxic = sum(y for _, y in rows)
    n_clean = len(rows) - n_toxic
    if not n_toxic or not n_clean:
        return blank
    chosen = docs.sparkSession.createDataFrame([(i,) for i, _ in rows], T.StructType([schema[id_col]])).distinct()
    sample = sample.join(F.broadcast(chosen), id_col).select("__y", "words")     # ids of the sample: bounded
    weights = _weights(_candidates(sample, n_toxic, n_clean), n_toxic, n_clean, prior)
    model = ToxicityModel(Channel(channel.cost, lexicon_of(weights), learned=frozenset(weights)), weights)
    got = sample.mapInArrow(_strengths(model), "__y int, e double").collect()
    y, e = np.array([r["__y"] for r in got], float), np.array([r["e"] for r in got])
    model.steps = _steps(e, y, np.where(y == 1, prior / n_toxic, (1 - prior) / n_clean))
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
          keep_columns: bool = True, with_text: bool = False) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: more likely toxic), ``predicted`` (1 from
    ``TOXIC`` on) and, with ``with_text``, ``restored`` (the restored words)."""
    base = docs if keep_columns else docs.select(id_col, text_col)
    drop = [] if keep_columns else [text_col]
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    fields += [T.StructField("restored", T.StringType())] if with_text else []
    schema = add_fields(T.StructType([f for f in base.schema.fields if f.name not in drop]), fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                texts = column(part, text_col).to_pylist()
                p = np.array([model.score(t) for t in texts], np.float64)
                new = {"score": pa.array(p), "predicted": pa.array((p >= TOXIC).astype(np.int32))}
                if with_text:
                    new["restored"] = pa.array([" ".join(model.channel.restore(t or "")) for t in texts],
                                               pa.string())
                if drop:
                    part = part.select([n for n in part.schema.names if n not in drop])
                yield add_columns(part, new)

    return base.mapInArrow(run, schema)
