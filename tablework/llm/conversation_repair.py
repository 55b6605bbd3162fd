"""Conversation structure repair (operator 12).

A conversation is to read ``(system? (user assistant)+)?``. Its rows, in the
order of their turns, are kept (costs 0), given another role (1), deleted (2;
required for blank rows and repeats) or stand before an inserted empty row (5);
a truncated row that stays costs 5 more. Wanted are the cheapest edits, among
them those whose initials (D, I, K, R) read least.

Method: a row is a symbol of its role and fault; a run of rows is a min-plus
matrix over the four states of the pattern, whose cells hold a cost and the
edits as a rope (a tree of shared parts with lengths and checksums, so that
ties are decided without writing the edits out). Sequences of a batch are
compressed by Re-Pair: the most frequent pair of neighbours becomes a rule,
again and again. Rules are evaluated bottom-up, one product each, and every
conversation that holds a rule uses its matrix. (Cheapest and least edits may
be put together from parts: two readings of the same rows at the same cost are
never one the beginning of the other, as the longer one would pay for its
insertions.)

On Spark: rows are put in order by range, so that a conversation of any length
lies in many tasks, and get a rising number. Repeats are found by an aggregate
on a checksum of conversation, role and text. Symbols are gathered in blocks of
at most ``BLOCK`` rows, matrices made per block, and one conversation's blocks
folded in order: four running cells. ``repaired`` then edits rows block by
block, in parallel. ``digest`` needs a running SHA-256 over a whole
conversation, so there its rows pass one task, as a stream that is never held.

Defined cases: a NULL text and a NULL or empty role are one space (the text is
blank; the role fits nowhere and is replaced or deleted); rows without a turn come
first; equal turns are ordered by role and text; repeated rows are duplicates;
rows without a conversation id are one conversation; an empty table gives no
rows; only the four columns are read, so names of others cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

WHITE = " \t\n\x0b\x0c\r"
STOPS = ".!?"

# Costs of the edits (fixed values).
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

BLOCK_BITS = 10             # rows of a block: 1,024 at most
SLICE_SYMBOLS = 1 << 16     # symbols of the sequences compressed together

# Symbols: blank, duplicate, then for each initial a whole and a truncated row.
BLANK, DUPLICATE = 0, 1
INITIALS = "sua"            # any other initial: the fourth kind
SYMBOLS = 2 + 2 * (len(INITIALS) + 1)
ALPHABET = "bdsSuUaAxX"     # how symbols are written in a block

# States: nothing yet, after the system row, after a user row, after an assistant row.
STATES = range(4)
ENDS = (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
EXPECTED = {0: "u", 1: "u", 2: "a", 3: "u"}      # role of a given or inserted row
ROLE = {"u": "user", "a": "assistant"}


# -- ropes and matrices --------------------------------------------------------------

_MOD = 10 ** 18 + 9


class Rope:
    """A text as a leaf or as two ropes, with its length and a checksum."""

    __slots__ = ("left", "right", "n", "power", "check")

    def __init__(self, left, right=None):
        self.left, self.right = left, right
        if right is None:
            self.n = len(left)
            self.check = int.from_bytes(left.encode(), "big") % _MOD
            self.power = pow(256, self.n, _MOD)
        else:
            self.n = left.n + right.n
            self.power = left.power * right.power % _MOD
            self.check = (left.check * right.power + right.check) % _MOD

    def __str__(self) -> str:
        out, stack = [], [self]
        while stack:
            r = stack.pop()
            if r.right is None:
                out.append(r.left)
            else:
                stack += (r.right, r.left)
        return "".join(out)

    def __add__(self, other: Rope) -> Rope:
        return other if not self.n else self if not other.n else Rope(self, other)

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or (x.n == y.n and x.check == y.check):
                continue
            if x.right is not None and (y.right is None or x.n >= y.n):
                a += (x.right, x.left)
                b.append(y)
            elif y.right is not None:
                b += (y.right, y.left)
                a.append(x)
            else:
                k = min(x.n, y.n)
                if x.left[:k] != y.left[:k]:
                    return x.left < y.left
                if x.n > k:
                    a.append(Rope(x.left[k:]))
                if y.n > k:
                    b.append(Rope(y.left[k:]))
        return bool(b)


EMPTY = Rope("")
Cell = tuple[int, Rope]
Matrix = list[list["Cell | None"]]


def better(a: Cell | None, b: Cell | None) -> Cell | None:
    if a is None or b is None:
        return a or b
    return a if a[0] < b[0] or (a[0] == b[0] and not b[1] < a[1]) else b


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: ``a``'s rows, then ``b``'s."""
    out: Matrix = []
    for row in a:
        best: list[Cell | None] = [None] * 4
        for q, x in enumerate(row):
            if x is None:
                continue
            for r, y in enumerate(b[q]):
                if y is None:
                    continue
                cost, old = x[0] + y[0], best[r]
                if old is None or cost < old[0]:
                    best[r] = (cost, x[1] + y[1])
                elif cost == old[0]:
                    audit = x[1] + y[1]
                    if audit < old[1]:
                        best[r] = (cost, audit)
        out.append(best)
    return out


def insertions() -> Matrix:
    """Any number of insertions between two rows."""
    out: Matrix = [[None] * 4 for _ in STATES]
    for p in STATES:
        q, k = p, 0
        while out[p][q] is None:
            out[p][q] = (k * INSERT, Rope("I" * k))
            q, k = STEP[q, EXPECTED[q]], k + 1
    return out


BETWEEN = insertions()


def symbol_matrix(symbol: int) -> Matrix:
    """One row, after any insertions before it."""
    out: Matrix = [[None] * 4 for _ in STATES]
    kind, late = divmod(symbol - 2, 2)
    for p in STATES:
        out[p][p] = (DELETE, Rope("D"))
        if symbol in (BLANK, DUPLICATE):
            continue
        q = STEP[p, EXPECTED[p]]
        out[p][q] = better(out[p][q], (REROLE + late * TRUNCATED, Rope("R")))
        q = STEP.get((p, INITIALS[kind])) if kind < len(INITIALS) else None
        if q is not None:
            out[p][q] = better(out[p][q], (KEEP + late * TRUNCATED, Rope("K")))
    return times(BETWEEN, out)


TERMINALS = [symbol_matrix(s) for s in range(SYMBOLS)]


# -- Re-Pair -------------------------------------------------------------------------

def re_pair(sequences: list[list[int]], terminals: int = SYMBOLS
            ) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (``terminals + i`` stands for the i-th pair) and the sequences
    written with them: the pair found most often is replaced until none is
    found twice. Work in proportion to the symbols, but for the heap."""
    sym: list[int] = []
    for s in sequences:
        sym += s
        sym.append(-1)                                   # no pair reaches over an end
    n = len(sym)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i in range(n - 1):
        if sym[i] >= 0 and sym[i + 1] >= 0:
            where[sym[i], sym[i + 1]].add(i)
    heap = [(-len(at), ab) for ab, at in where.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, (a, b) = heapq.heappop(heap)
        at = where.get((a, b), ())
        if len(at) < 2:
            continue
        if len(at) != -count:                            # counted before other replacements
            heapq.heappush(heap, (-len(at), (a, b)))
            continue
        del where[a, b]
        new = terminals + len(rules)
        rules.append((a, b))
        changed = set()
        for i in sorted(at):
            j = nxt[i]
            if sym[i] != a or sym[j] != b:               # taken by an overlapping place
                continue
            p, q = prv[i], nxt[j]
            if p >= 0 and sym[p] >= 0:
                where.get((sym[p], a), set()).discard(p)
                where[sym[p], new].add(p)
                changed.add((sym[p], new))
            if sym[q] >= 0:
                where.get((b, sym[q]), set()).discard(j)
                where[new, sym[q]].add(i)
                changed.add((new, sym[q]))
            sym[i], sym[j] = new, -2
            nxt[i], prv[q] = q, i
        for ab in changed:
            if len(where[ab]) > 1:
                heapq.heappush(heap, (-len(where[ab]), ab))
    out, now = [], []
    for s in sym:
        if s == -1:
            out.append(now)
            now = []
        elif s >= 0:
            now.append(s)
    return rules, out


def sequence_matrices(sequences: list[str]) -> dict[str, Matrix]:
    """The matrix of each different sequence."""
    different = sorted(set(sequences))
    rules, texts = re_pair([[ALPHABET.index(c) for c in s] for s in different])
    matrices = list(TERMINALS)
    for a, b in rules:
        matrices.append(times(matrices[a], matrices[b]))
    out = {}
    for name, text in zip(different, texts):
        m = matrices[text[0]]
        for s in text[1:]:
            m = times(m, matrices[s])
        out[name] = m
    return out


# -- rows in order -------------------------------------------------------------------

def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows damaged by the crc32 of ``conversation:turn`` modulo 20: 0 drops a
    row, 1 empties its text, 2 takes its stops out, 3 repeats it, 4 makes it
    the user's. NULLs are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col))), F.lit(20))
    x = text_of(text_col)
    return turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.when(k == 4, F.lit("user")).otherwise(text_of(role_col)).alias("role"),
        F.when(k == 1, F.lit("")).when(k == 2, F.translate(x, STOPS, "")).otherwise(x).alias("text"),
        k.alias("__k"),
    ).where(F.col("__k") != 0).select(
        "conv_id", "turn", "role", "text",
        F.explode(F.when(F.col("__k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        .alias("__copy")).drop("__copy")


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, ``row_key`` (equal for rows of one
    conversation with equal role and text), ``symbol`` (as if no row were a
    duplicate) and ``at``: a number that rises with the conversation, turn, role
    and text. Written once, as numbers must not change between reads.

    Ranges are cut on the first characters of role and text; a salt divides
    rows that are equal in all of them.
    """
    role = F.when(F.coalesce(F.col("role"), F.lit("")) == "", " ").otherwise(F.col("role"))
    text = F.coalesce(F.col("text"), F.lit(" "))
    size = lambda c: F.coalesce(F.length(c).cast("string"), F.lit("-"))
    conv = F.col("conv_id").cast("string")
    key = F.unhex(F.md5(F.concat(size(conv), F.lit(":"), F.coalesce(conv, F.lit("")), size(F.col("role")),
                                 F.lit(":"), F.col("role"), F.col("text"))))
    rest = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin(*INITIALS), initial).otherwise(F.lit("x"))
    symbol = F.when(rest == "", F.lit(ALPHABET[BLANK])) \
        .when(F.substring(rest, -1, 1).isin(*STOPS), kind).otherwise(F.upper(kind))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")) \
        .withColumn("__head", F.substring(F.concat("role", F.lit("\0"), "text"), 1, 64)) \
        .withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("__head")]
    rows = rows.repartitionByRange(*order, F.asc("__salt")) \
        .sortWithinPartitions(*order, "role", "text", "__salt")
    rows = rows.select("conv_id", "turn", "role", "text", key.alias("row_key"), symbol.alias("symbol"),
                       F.monotonically_increasing_id().alias("at"))
    return written(rows, "turns_in_order")


def symbol_blocks(ordered: DataFrame) -> DataFrame:
    """conv_id, block, symbols: the rows of a conversation whose numbers share
    their upper bits, ``2 ** BLOCK_BITS`` at most, as a text of symbols."""
    narrow = ordered.select("conv_id", "at", "symbol", "row_key")
    first = narrow.where(F.col("symbol") != ALPHABET[BLANK]).groupBy("row_key") \
        .agg(F.min("at").alias("__first"), F.count(F.lit(1)).alias("__n")) \
        .where(F.col("__n") > 1).select("row_key", "__first")
    repeat = (F.col("at") > F.col("__first")) & (F.col("symbol") != ALPHABET[BLANK])
    marked = narrow.join(first, "row_key", "left").select(
        "conv_id", F.shiftright("at", BLOCK_BITS).alias("block"),
        F.struct("at", F.when(repeat, F.lit(ALPHABET[DUPLICATE])).otherwise(F.col("symbol")).alias("s")).alias("__s"))
    return marked.groupBy("conv_id", "block").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("__s")), lambda x: x["s"]), "").alias("symbols"))


# -- the plan ------------------------------------------------------------------------

def _sliced(symbols: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, s in enumerate(symbols):
        if i > start and size + len(s) > SLICE_SYMBOLS:
            yield start, i
            start, size = i, 0
        size += len(s)
    if symbols:
        yield start, len(symbols)


def block_matrices(blocks: DataFrame) -> DataFrame:
    """Adds ``costs`` and ``audits``: the 16 cells of each block's matrix, row by
    row (NULL: no way)."""
    schema = T.StructType([*blocks.schema.fields, T.StructField("costs", T.ArrayType(T.LongType())),
                           T.StructField("audits", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = batch.column("symbols").to_pylist()
            for a, b in _sliced(symbols):
                cells = {}
                for s, m in sequence_matrices(symbols[a:b]).items():
                    flat = [c for row in m for c in row]
                    cells[s] = ([c and c[0] for c in flat], [c and str(c[1]) for c in flat])
                got = [cells[s] for s in symbols[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array([g[0] for g in got], pa.list_(pa.int64())),
                     pa.array([g[1] for g in got], pa.list_(pa.string()))], names=schema.names)

    return blocks.mapInArrow(run, schema)


PLAN = [T.StructField("block", T.LongType()), T.StructField("symbols", T.StringType()),
        T.StructField("state", T.IntegerType()), T.StructField("edits", T.StringType()),
        T.StructField("cost", T.LongType())]
_PLAN_ARROW = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64()]


def fold(blocks: list[tuple], between: Matrix = BETWEEN) -> Iterator[tuple]:
    """From (block, symbols, costs, audits) of one conversation, in order:
    (block, symbols, state before it, its edits, the conversation's cost)."""
    now: list = [(0, EMPTY, None), None, None, None]     # cost, edits, way here
    names = []
    for block, symbols, costs, audits in blocks:
        names.append((block, symbols))
        best: list = [None] * 4
        for p, x in enumerate(now):
            if x is None:
                continue
            for q in STATES:
                cost = costs[4 * p + q]
                if cost is None:
                    continue
                cell = (x[0] + cost, x[1] + Rope(audits[4 * p + q]))
                if better(best[q] and best[q][:2], cell) is cell:
                    best[q] = (*cell, (x[2], p, audits[4 * p + q]))
        now = best
    done = None
    for p, x in enumerate(now):
        for q in ENDS:
            if x is not None and between[p][q] is not None:
                cell = (x[0] + between[p][q][0], x[1] + between[p][q][1])
                if better(done and done[:2], cell) is cell:
                    done = (*cell, x[2], str(between[p][q][1]))
    cost, _, way, tail = done
    steps = []
    while way is not None:
        way, p, audit = way
        steps.append((p, audit + tail))
        tail = ""
    for (block, symbols), (p, audit) in zip(names, reversed(steps)):
        yield block, symbols, p, audit, cost


def repair_plan(ordered: DataFrame) -> DataFrame:
    """conv_id, block, symbols, state, edits, cost: the cheapest edits of every
    block. The last block's edits end with insertions behind the last row."""
    made = block_matrices(symbol_blocks(ordered)).repartition("conv_id") \
        .sortWithinPartitions("conv_id", "block")
    conv = ordered.schema["conv_id"]
    schema = T.StructType([conv, *PLAN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def rows(done: list, kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*done), [kind, *_PLAN_ARROW])], names=schema.names)

        for batch in batches:
            kind, done = batch.column("conv_id").type, []
            for conv_id, *block in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "block", "symbols", "costs", "audits"))):
                if held and conv_id != now:
                    done += [(now, *r) for r in fold(held)]
                    held = []
                now = conv_id
                held.append(block)
            if done:
                yield rows(done, kind)
        if held:
            yield rows([(now, *r) for r in fold(held)], kind)

    return made.mapInArrow(run, schema)


# -- editing -------------------------------------------------------------------------

_STREAM = ["conv_id", "block", "at", "turn", "role", "text", "symbols", "state", "edits", "cost"]


def _stream(ordered: DataFrame, plan: DataFrame, *keys: str, convs: DataFrame | None = None) -> DataFrame:
    """Rows behind the plan of their block, in order, dealt out by ``keys``."""
    null = lambda t: F.lit(None).cast(t)
    types = {"at": "long", "turn": ordered.schema["turn"].dataType, "role": "string", "text": "string",
             "symbols": "string", "state": "int", "edits": "string", "cost": "long", "block": "long"}
    rows = ordered.withColumn("block", F.shiftright("at", BLOCK_BITS))
    parts = [rows, plan] + ([convs] if convs is not None else [])
    parts = [p.select(*[F.col(c) if c in p.columns else null(types[c]).alias(c) for c in _STREAM])
             for p in parts]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    order = ["conv_id", F.asc_nulls_first("block"), F.asc_nulls_first("at")]
    return both.repartition(*keys).sortWithinPartitions(*order)


def edit_rows(edits: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, int, str, str]]:
    """(edit, row number or -1, role, text) of what a block's edits leave."""
    i = -1
    for e in edits:
        if e == "I":
            initial, text, source = EXPECTED[state], "", -1
            role = ROLE[initial]
        else:
            role, text = next(rows)
            i += 1
            source = i
            if e == "D":
                continue
            initial = role[0] if e == "K" else EXPECTED[state]
            role = role if e == "K" else ROLE[initial]
        state = STEP[state, initial]
        yield e, source, role, text


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of the stream, one tuple each in the order of ``_STREAM``."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in _STREAM))


def repaired(ordered: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, block, place (in the block), turn (NULL for an
    inserted row), role, text, edit. Block by block, so a long conversation is
    edited by many tasks."""
    conv, turn = ordered.schema["conv_id"], ordered.schema["turn"]
    schema = T.StructType([conv, T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()),
                           turn, T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("edit", T.StringType())])
    kinds = [None, pa.int64(), pa.int32(), None, pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict[str, pa.DataType] = {}

        def noted(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in bs:
                types.update(zip(b.schema.names, b.schema.types))
                yield b

        def write(block: list) -> list[tuple]:
            (conv_id, number, state, edits), rows = block[0], block[1:]
            return [(conv_id, number, k, rows[i][0] if i >= 0 else None, role, text, e)
                    for k, (e, i, role, text) in enumerate(edit_rows(edits, state, iter([r[1:] for r in rows])))]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            own = [types["conv_id"], *kinds[1:3], types["turn"], *kinds[4:]]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), own)],
                                              names=schema.names)

        block: list = []
        for conv_id, number, at, turn_no, role, text, _, state, edits, _ in _whole_blocks(noted(batches)):
            if at is None:                               # the plan of the next block
                if block and (out := write(block)):
                    yield batch_of(out)
                block = [(conv_id, number, state, edits)]
            else:
                block.append((turn_no, role, text))
        if block and (out := write(block)):
            yield batch_of(out)

    return _stream(ordered, plan, "conv_id", "block").mapInArrow(run, schema)


class _Conversation:
    """What a digest keeps of a conversation while its rows pass."""

    def __init__(self):
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.sha, self.any = hashlib.sha256(), False
        self.edits, self.state = iter(""), 0

    def plan(self, symbols: str, state: int, edits: str, cost: int) -> None:
        self.finish()
        self.blank += symbols.count(ALPHABET[BLANK])
        self.duplicate += symbols.count(ALPHABET[DUPLICATE])
        self.truncated += sum(map(str.isupper, symbols))
        self.cost = cost
        self.audit.append(edits)
        self.edits, self.state = iter(edits), state

    def out(self, role: str, text: str) -> None:
        self.sha.update((b"\n" if self.any else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def insert(self, e: str) -> bool:
        if e == "I":
            initial = EXPECTED[self.state]
            self.out(ROLE[initial], "")
            self.state = STEP[self.state, initial]
        return e == "I"

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            self.turns += 1
        if self.initial is not None and self.initial + role[0] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[0]
        e = next(self.edits)
        while self.insert(e):
            e = next(self.edits)
        if e != "D":
            initial = role[0] if e == "K" else EXPECTED[self.state]
            self.out(role if e == "K" else ROLE[initial], text)
            self.state = STEP[self.state, initial]

    def finish(self) -> None:
        for e in self.edits:
            self.insert(e)

    def result(self) -> tuple:
        self.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit), self.sha.hexdigest())


def digest(ordered: DataFrame, plan: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation of ``convs`` (conv_id, distinct): gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([ordered.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in longs],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * len(longs) + [pa.string()] * 2
        now, state = None, None

        def rows(done: list, kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done), [kind, *kinds])],
                                              names=schema.names)

        for batch in batches:
            kind, done = batch.column("conv_id").type, []
            for conv_id, block, at, turn, role, text, symbols, entry, edits, cost in _whole_blocks([batch]):
                if state is None or conv_id != now:
                    if state is not None:
                        done.append((now, *state.result()))
                    now, state = conv_id, _Conversation()
                if at is not None:
                    state.row(turn, role, text)
                elif block is not None:
                    state.plan(symbols, entry, edits, cost)
            if done:
                yield rows(done, kind)
        if state is not None:
            yield rows([(now, *state.result())], kind)

    return _stream(ordered, plan, "conv_id", convs=convs).mapInArrow(run, schema)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The whole operator: the repaired rows of ``turns`` (see ``repaired``)."""
    rows = turns.select(*[F.col(c).alias(n) for c, n in zip(
        (conv_col, turn_col, role_col, text_col), ("conv_id", "turn", "role", "text"))])
    ordered = in_order(rows)
    return repaired(ordered, written(repair_plan(ordered), "repair_plan"))
