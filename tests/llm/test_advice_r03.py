"""Cases of the second verdict: row keys, escapes over parts, odd parts, shard pages."""

import json
import random

import duckdb
import numpy as np
import pytest
from brute import contamination
from hypothesis import given, settings
from hypothesis import strategies as st

from tablework.llm import chat_format as cf
from tablework.llm import decontamination, ngram_join, sharding, toxicity
from tablework.llm.common import with_row_key
from tablework.session import scratch_path

TEXT = " ".join(f"w{k}" for k in range(40))


def test_row_keys_tell_id_and_text_apart(spark):
    rows = [("a", "b/" + TEXT), ("a/b", TEXT), ("a", None), ("a", ""), (None, "a"), ("", "a"), ("1", "1/x"), ("1/1", "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert with_row_key(df).select("__row_key").distinct().count() == len(rows)


def test_keep_one_keeps_documents_whose_ids_hold_the_sign(spark):
    words = TEXT.split()
    rows = [("a", "b/" + " ".join(words[:12])), ("a/b", " ".join(words[:12]))]
    assert len(set(ngram_join.shingles(rows[0][1])) ^ set(ngram_join.shingles(rows[1][1]))) > 0
    df = spark.createDataFrame(rows, "doc_id string, text string")
    found = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(df).collect()}
    n, m = (set(ngram_join.shingles(t)) for _, t in rows)
    linked = len(n & m) / len(n | m) >= 0.8
    assert found == {"a": int(linked), "a/b": int(linked)}
    rows = [("a", "b/x y z u v w"), ("a/b", "x y z u v w")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == ["a", "a/b"]


def test_no_constant_key_on_the_shuffled_path(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(i, f"{TEXT} {i}") for i in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, TEXT), (2, "w3 w4")], "item_id long, text string")
    got = decontamination.digest(decontamination.decontaminate(docs, items)).collect()
    want = contamination([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert sorted(map(tuple, got)) == sorted(want.elements())


@pytest.mark.parametrize("limit", [300, 1000])
def test_sharding_sql_with_oversize_texts_and_repeats(spark, limit):
    rows = [(i, "x" * (i % 97)) for i in range(500)] + [(7, "y" * 40)] * 1000 + [(8, "z" * 5000)] * 3 + [(9, None), (9, "")]
    path = scratch_path(spark, "shard_docs")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(4).write.parquet(path)
    got = sharding.assign(spark.read.parquet(path), limit).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path.removeprefix('file:')}/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(sharding.oracle(limit)).fetchall())
    assert any("." in r.shard and not r.oversize for r in got) and sum(r.oversize for r in got) == 3


# -- chat formatting -------------------------------------------------------------------

BITS = ["<", "|im_end|>", "[INS", "T]", "</", "s>", "␛", "\n", "a", "<<", "SYS>>", "|", "<|im", "_start|>"]


def live(written, role):
    """The written turn between its own marks, without escapes, placeholders cut out."""
    body = written[len(cf.START) + len(cf.escape_role(role)) + 1:-len(cf.END)]
    for p in cf.PLACEHOLDERS.values():
        body = body.replace(p, "\0")
    return body


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(
    st.lists(st.sampled_from(BITS), max_size=4).map(lambda b: {"type": "text", "text": "".join(b)}),
    st.sampled_from([{"type": "image", "ref": "r"}, {"type": "audio"}, {"type": "document", "pages": 2}])),
    min_size=1, max_size=8))
def test_no_control_string_survives_any_parts(parts):
    content = json.dumps(parts)
    written, start, end, found, source = cf.write_turn("assistant", content)
    assert source == content
    assert not any(c in live(written, "assistant") for c in cf.CONTROL)
    assert [a["kind"] for a in found] == [p["type"] for p in parts if p["type"] != "text"]
    assert all(written[a["at"]:].startswith(cf.PLACEHOLDERS[a["kind"]]) for a in found)
    said = "".join(p["text"] if p["type"] == "text" else cf.PLACEHOLDERS[p["type"]] for p in parts)
    assert cf.unescape(written[start:end]) == said


ODD = ['[{"type":"image","width":1e400,"height":1e400}]', '[{"type":"image","width":NaN}]',
       '[{"type":"audio","seconds":1e300}]', '[{"type":"audio","seconds":-5}]',
       '[{"type":"document","pages":' + "9" * 400 + '}]', '[{"type":"document","pages":true}]',
       '[{"type":"text","text":"\\ud800"}]', '[{"type":["x"]}]', '[{"type":"text","text":["x"]}]',
       '[{"type":"text","text":' + "[" * 100_000 + "]" * 100_000 + "}]", '[{"type":"image","ref":{"a":1}}]', "[{", "[{}]"]


def test_odd_parts_never_end_a_job(spark):
    turns = [(1, k, "user", t) for k, t in enumerate(ODD)] + [(2, 0, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = cf.format_turns(df)
    rows = {r.text: r for r in formatted.collect()}
    assert len(rows) == len(turns)
    assert rows[ODD[0]].attachment_tokens == 35715 ** 2 and rows[ODD[1]].attachment_tokens == 1
    assert rows[ODD[2]].attachment_tokens == 25_000_000 and rows[ODD[3]].attachment_tokens == 1
    assert rows[ODD[4]].attachment_tokens == 576_000_000 and rows[ODD[5]].attachment_tokens == 576
    assert all(rows[t].typed_content is None for t in ODD[6:10] + ODD[11:])
    got = {r.conv_id: r for r in cf.conversation_digests(formatted).collect()}
    assert got[1].n_turns == len(ODD) and got[1].n_attachments == 7


def test_typed_turns_read_back_as_their_content(spark):
    content = '[{"type": "text", "text": "see "},{"type":"image","ref":"i.png","width":56,"height":28}]'
    rows = [(1, 0, "user", content), (1, 1, "assistant", "ok"), (2, 0, "user", "[INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    typed = {r.conv_id: r for r in cf.conversation_digests(cf.format_turns(df)).collect()}
    plain = {r.conv_id: r for r in cf.conversation_digests(cf.format_turns(df, typed=False)).collect()}
    assert {k: (r.turns_sha256, r.loss_sha256) for k, r in typed.items()} == \
        {k: (r.turns_sha256, r.loss_sha256) for k, r in plain.items()}
    assert (typed[1].n_attachments, typed[1].attachment_tokens) == (1, 2) and typed[2].n_attachments == 0


# -- toxicity --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def channel():
    counts = np.zeros((toxicity._SIZE,) * 3)
    text = " you are a stupid idiot and a moron i know this is pathetic trash the man i am the scum shut up ass shit "
    c = toxicity._LUT[np.frombuffer((text * 20).encode("utf-32-le"), "<u4")]
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    p = (counts + 0.01) / (counts.sum(axis=2, keepdims=True) + 0.01 * toxicity._SIZE)
    weights = {w: 0.9 for w in ("idiot", "stupid", "moron", "scum", "ass", "shit", "theman")} | {"idio~": 0.8}
    return toxicity.Channel(-np.log(p), toxicity.lexicon_of(weights), learned=frozenset(weights))


@pytest.mark.parametrize("noisy, plain", [
    ("a s t u p i d man", "a stupid man"), ("I a s t u p i d", "i a stupid"), ("s t u p i d  i d i o t", "stupid idiot"),
    ("s\nt\nu\np\ni\nd", "stupid"), ("s.t.u.p.i.d m.o.r.o.n", "stupid moron"), ("ｓｔｕｐｉｄ", "stupid"),
    ("st​up​id", "stupid"), ("st*pid", "stupid"), ("*stupid*", "stupid"), ("1 2 3", "1 2 3"),
    ("stu pid", "stu pid stupid"), ("st upid!", "st upid stupid"), ("the man", "the man"), ("i am", "i am")])
def test_word_edges_widths_and_cut_words(channel, noisy, plain):
    assert " ".join(channel.restore(noisy)) == plain


def test_the_score_is_that_of_the_restored_words(channel):
    model = toxicity.ToxicityModel(channel, {w: 0.5 + 0.01 * k for k, w in enumerate(sorted(channel.learned))},
                                   ((0.0, 0.5), (0.1, 0.9)))
    rng = random.Random(3)
    bits = ["stupid", "s t u p i d", "idi0t", "the", "man", "stu pid", "scum!", "x", "1 2 3", "\n", "IDIOTS", "sh*t", "é"]
    for _ in range(300):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        want = model.strength(set(channel.restore(text)))
        assert model.text_strength(text) == pytest.approx(want), text


def test_evidence_against_brute_force(spark):
    """Learned weights and scores against counting by hand on a small table."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(12)) + (" vilemark" if k % 4 == 0 else "")) for k in range(400)]
    labels = [(k, int(k % 4 == 0)) for k in range(400)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "vilemark" in model.weights and not set(words) & set(model.weights)
    n_toxic, n_clean, prior = 100, 300, 0.25
    a, b = prior, 0.1 / n_clean * (1 - prior)
    assert model.weights["vilemark"] == pytest.approx(a / (a + b), rel=0.2)
    rows = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    assert all((r.score >= toxicity.TOXIC) == (r.doc_id % 4 == 0) for r in rows)
    assert n_toxic == sum(r.predicted for r in rows)
