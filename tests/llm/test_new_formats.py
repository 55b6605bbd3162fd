"""Operators 11 (token files), 12 (conversation repair) and 13 (fill-in-middle)."""

import glob
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from tablework.llm import conversation_repair as cr
from tablework.llm import fill_in_middle as fim
from tablework.llm import token_files as tf

SF = "/root/testdata/sf0.001"

DOCS = [(3, "one two"), (1, None), (2, ""), (2, ""), (None, "no id"), (7, "x" * 70_000 + " é" * 70_000),
        (5, "a<P>b"), (6, "Ünï <S"), (6, "zwei"), (9, "'s it's 12 ½ — “quoted”\n\n  \t<|endoftext|> 日本 \x85\xa0x"),
        (-4, "🙂🙂 ok"), (8, "\n")]
DOC_SCHEMA = "doc_id long, text string, N long, output string, part string, state string"


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "o", "p", "s") for i, t in DOCS], DOC_SCHEMA)


# -- 13 ------------------------------------------------------------------------------

def brute_fim(doc_id, text):
    text = text or ""
    tok = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tok) + 1), h2 % (len(tok) + 1)))
    pre, mid, suf = "".join(tok[:a]), "".join(tok[a:b]), "".join(tok[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return len(tok), "plain", None, None, text
    if h4 % 100 < 20:
        return len(tok), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(tok), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim_against_brute_force(docs):
    got = fim.transform(docs)
    assert got.columns == ["doc_id", "text", "part", "state", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = got.collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert (r["n"], r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.digest(got).collect()), key=str) == \
        sorted(((i, sha(brute_fim(i, t)[4]), sha(t or "")) for i, t in DOCS), key=str)
    back = got.select("text", fim.restore(got.output, got.form).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)


def test_fim_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digest(fim.transform(empty)).collect() == []


@pytest.mark.parametrize("offsets", [
    np.array([], np.int64), np.array([1]), np.arange(1, 200_001), np.arange(1, 200_001, 2),
    np.arange(1, 400_000, 37), np.unique(np.random.default_rng(1).integers(1, 300_000, 90_000))])
def test_boundary_set_selects(offsets):
    s = fim.BoundarySet(offsets)
    assert len(s) == len(offsets)
    step = max(1, len(offsets) // 3000)
    assert [s.select(k) for k in range(0, len(offsets), step)] == offsets[::step].tolist()


def test_boundary_set_uses_all_containers():
    runs = np.arange(1, 60_000)
    bitmap = (1 << 16) + np.arange(1, 60_000, 2)
    array = (2 << 16) + np.arange(1, 60_000, 100)
    s = fim.BoundarySet(np.concatenate((runs, bitmap, array)))
    assert [c.kind for c in s.containers] == [fim.RUN, fim.BITMAP, fim.ARRAY]


# -- 11 ------------------------------------------------------------------------------

def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("run_chars", [1 << 16, 20])
def test_text_ids_equal_the_library(monkeypatch, run_chars):
    monkeypatch.setattr(tf, "RUN_CHARS", run_chars)
    rng = random.Random(5)
    tok = tf.TextIds(tf.tokenizer_path())
    assert tok.core is not None
    chars = "abcXYZ éßŁɏ 0123½²  \n\t\r.,'!?<|>-—“”…'s't'll\xa0\x85\x1c日я🙂"
    texts = ["".join(rng.choice(chars[:rng.choice([26, 49, 99])]) for _ in range(rng.randint(0, 80)))
             for _ in range(6000)]
    texts += ["<|endoftext|>", "a <|endoftext|>b", "", " ", "  x", "x  ", "don't 'S 'll", "a " * 100, " a" * 100]
    for t in texts:
        assert tok.ids(t) == tok.exact(t), t


def test_token_files_against_the_library(spark, docs):
    tok = tf.TextIds(tf.tokenizer_path()).tok
    path = tf.token_files(docs)
    order = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, hashlib.md5((d[1] or "").encode()).hexdigest()))
    want, start, whole = [], 0, []
    for i, text in order:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
        whole += ids
    got = [tuple(r) for r in tf.digest(spark, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for first, last in [(0, 5), (3, 9), (7, start), (start - 1, start), (start, start + 9), (40, 41)]:
        rows = sorted(tf.read_tokens(spark, path, first, last).collect(), key=lambda r: r.start)
        assert sum((list(r.ids) for r in rows), []) == whole[first:last]


def test_token_file_layout(spark, docs):
    path = tf.write_files(tf.encode(docs.unionAll(docs)), tf.scratch_path(spark, "layout"), page_rows=2)
    files = glob.glob(path.removeprefix("file:") + "/*.parquet")
    meta = pq.ParquetFile(max(files, key=lambda f: pq.ParquetFile(f).metadata.num_rows)).metadata
    group = meta.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    for name in ("doc_id", "n_tokens", "local_start", "local_end"):
        assert columns[name].encodings == ("DELTA_BINARY_PACKED",)
    assert all(c.has_offset_index for c in columns.values())


def test_token_files_plans(spark, docs):
    path = tf.token_files(docs)
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = tf.part_starts(tf.read_files(spark, path))._jdf.queryExecution().explainString(formatted)
    assert "ReadSchema: struct<part:int,local_end:bigint>" in plan
    plan = tf.read_tokens(spark, path, 5, 9)._jdf.queryExecution().explainString(formatted)
    assert "LessThan(local_start" in plan and "GreaterThan(local_end" in plan


def test_token_files_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    path = tf.token_files(empty)
    assert tf.digest(spark, path).collect() == []
    assert tf.read_tokens(spark, path, 0, 10).collect() == []


# -- 12 ------------------------------------------------------------------------------

def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Every way through the rows: (cost, audit, repaired) of the best, over
    all texts of edits with at most two insertions."""
    marks, best = faults(rows), None

    def walk(i, initials, cost, audit, out, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, list(out))
        else:
            _, _, role, text = rows[i]
            late = 5 * (marks[i] == "t")
            walk(i + 1, initials, cost + 2, audit + "D", out, inserts)
            if marks[i] not in ("b", "d"):
                walk(i + 1, initials + role[:1], cost + late, audit + "K", out + [(role, text)], inserts)
                for new in ("user", "assistant"):
                    walk(i + 1, initials + new[0], cost + 1 + late, audit + "R", out + [(new, text)], inserts)
        if inserts < 2:
            for new in ("user", "assistant"):
                walk(i, initials + new[0], cost + 5, audit + "I", out + [(new, "")], inserts + 1)

    walk(0, "", 0, "", [], 0)
    return best


def expected(turns):
    out = {}
    rows = damaged(turns)
    for conv in {t[0] for t in turns}:
        mine = sorted((r for r in rows if r[0] == conv),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks = faults(mine)
        numbers = [r[1] for r in mine if r[1] is not None]
        roles = [r[2] for r in mine]
        cost, audit, left = brute_repair(mine)
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
                     marks.count("b"), marks.count("d"), marks.count("t"),
                     sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(roles)),
                     cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def random_turns(n_convs, longest, seed):
    rng = random.Random(seed)
    out = []
    for conv in [None, *range(n_convs)]:
        for k in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "admin", None])
            text = rng.choice(["Yes.", "No!", "cut off", "Well?\n", " \t", "", None, "é.", "a.b", f"{k}."])
            out.append((conv, rng.choice([k, k, k, k + 3, None]), role, text))
    return out


TURNS = "conv_id long, turn long, role string, text string, block string, Cost string"


def run_repair(spark, turns):
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], TURNS)
    ordered = cr.in_order(cr.damage(df))
    got = cr.digest(ordered, cr.repair_plan(ordered), df.select("conv_id").distinct())
    return {r[0]: tuple(r)[1:] for r in got.collect()}


def test_repair_against_brute_force(spark):
    turns = random_turns(150, 7, 3)
    assert run_repair(spark, turns) == expected(turns)


def test_repair_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    turns = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert run_repair(spark, turns) == expected(turns)


def test_blocks_change_nothing(spark, monkeypatch):
    """A long conversation in many blocks and tasks, against a plain DP."""
    rng = random.Random(8)
    turns = [(99, k, rng.choice(["system", "user", "assistant", "tool"]),
              rng.choice(["Yes.", "cut", f"{k}.", f"{k}"])) for k in range(3000)] + random_turns(20, 5, 1)
    monkeypatch.setattr(cr, "BLOCK_BITS", 4)
    got = run_repair(spark, turns)
    mine = [r for r in damaged(turns) if r[0] == 99]
    now = {0: (0, "")}
    expect = {0: "u", 1: "u", 2: "a", 3: "u"}

    def spread(cells):
        for _ in range(3):
            for p, (c, a) in list(cells.items()):
                q = cr.STEP[p, expect[p]]
                cells[q] = min(cells.get(q, (10 ** 9, "")), (c + 5, a + "I"))
        return cells

    for (_, _, role, _), mark in zip(mine, faults(mine)):
        new = {}
        for p, (c, a) in spread(now).items():
            ways = [(p, 2, "D")]
            if mark not in ("b", "d"):
                late = 5 * (mark == "t")
                ways += [(cr.STEP[p, expect[p]], 1 + late, "R")]
                if (p, role[0]) in cr.STEP:
                    ways += [(cr.STEP[p, role[0]], late, "K")]
            for q, d, e in ways:
                new[q] = min(new.get(q, (10 ** 9, "")), (c + d, a + e))
        now = new
    now = spread(now)
    assert got[99][5:7] == min(now[q] for q in (0, 3) if q in now)
    short = expected([t for t in turns if t[0] != 99])
    assert {k: v for k, v in got.items() if k != 99} == short


def test_repaired_rows(spark):
    turns = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "assistant", "Yes."),
             (1, 3, "user", "cut"), (2, 0, "tool", "Go."), (2, 1, "assistant", "Ok."), (3, 0, "system", "Rules.")]
    rows = cr.repair(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = sorted((r.conv_id, r.turn, r.role, r.text, r.edit) for r in rows.collect())
    assert got == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Yes.", "K"),
                   (2, 0, "user", "Go.", "R"), (2, 1, "assistant", "Ok.", "K")]
    assert rows.schema["turn"].dataType == T.LongType()


def test_repair_empty_table(spark):
    empty = spark.createDataFrame([], TURNS)
    ordered = cr.in_order(cr.damage(empty))
    assert cr.digest(ordered, cr.repair_plan(ordered), empty.select("conv_id").distinct()).collect() == []
    assert cr.repair(empty).collect() == []


def test_re_pair_writes_the_same_sequences():
    rng = random.Random(2)
    seqs = [[rng.randint(0, 3) for _ in range(rng.randint(1, 40))] for _ in range(200)] + [[1] * 33]
    rules, texts = cr.re_pair(seqs, terminals=4)

    def read(s):
        return [s] if s < 4 else read(rules[s - 4][0]) + read(rules[s - 4][1])

    assert [sum(map(read, t), []) for t in texts] == seqs
    pairs = [ab for t in texts for ab in itertools.pairwise(t)]
    assert sum(map(len, texts)) < sum(map(len, seqs)) / 2 and len(pairs) < sum(map(len, seqs)) / 2


def test_ropes_compare_as_texts():
    rng = random.Random(4)
    made = [(cr.Rope(c), c) for c in "DIKR"]
    for _ in range(300):
        (a, x), (b, y) = rng.choice(made), rng.choice(made)
        if len(x) + len(y) < 200:
            made.append((a + b, x + y))
    for _ in range(3000):
        (a, x), (b, y) = rng.choice(made), rng.choice(made)
        assert str(a) == x and (a < b) == (x < y)
