"""N-gram join, packing, token counts, chat formatting: brute force and round trips."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import near_classes
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablework.llm import chat_format, ngram_join, packing, token_counts

SF = "/root/testdata/sf0.001"


# -- n-gram join ----------------------------------------------------------------

def _classes(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect())


def _family(n, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    out = []
    for i in range(n):
        b = list(base)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(120)] = f"z{rng.randint(0, 1000)}"
        out.append((i, " ".join(b)))
    return out


def test_join_edges_and_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_TEXTS", 40)            # one group over many blocks
    docs = _family(150) + [(1000 + i, "one two") for i in range(3)] + [
        (2000, None), (2001, ""), (None, "one two"), (None, "null only"), (3000, "one two three")]
    docs.append((5, docs[5][1]))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bands", F.lit("clash"))
    assert _classes(frame) == near_classes(docs)
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    n_classes = len({r.root for r in ngram_join.near_duplicates(frame).collect() if r.root is not None})
    assert kept.count() == n_classes + 2                        # and the two without words


def test_join_table(spark, docs_and_items):
    assert _classes(spark.read.parquet(f"{SF}/documents.parquet")) == near_classes(docs_and_items[0])


def test_join_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(none).count() == 0 and ngram_join.keep_one(none).count() == 0


def test_overlaps_ways_agree():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, 150, dtype=np.uint64)) for _ in range(60)]
    i, j = np.triu_indices(60, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert ngram_join.overlaps(sets, i, j).tolist() == want
    assert ngram_join.overlaps(sets, i[:2], j[:2]).tolist() == want[:2]


def test_bands_reach_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 100)]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 103: 100}


# -- packing --------------------------------------------------------------------

@settings(max_examples=80, deadline=None)
@given(st.sampled_from([10, 30, 100, 2048]), st.data())
def test_pack_plan_fills_bins_without_gaps(capacity, data):
    counts = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(1, 40), min_size=1, max_size=25))
    bins, placed = {}, Counter()
    for length, rank, n, first, offset, per_bin in packing.pack_plan(counts, capacity).itertuples(index=False):
        assert rank == placed[length]
        placed[length] += n
        for j in range(n):
            bins.setdefault(first + j // per_bin, []).append((offset + j % per_bin * length, length))
    assert placed == Counter(counts) and sorted(bins) == list(range(len(bins)))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
        assert sum(3 * n > capacity for _, n in pieces) <= 2     # large items pair at most


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.tokenizer_path())


TEXTS = ["Don't stop's it'S <|endoftext|> a<|startoftext|>b  é́ x̣", "I'll go\x1cx ẞ Σας 12.5,3.. a.,b ,. ...",
         " ab́ ́ ́.,", "ABC.,.,", "İstanbul'd ªº µm ÿ ß SS ÀÉ", "a b c\u0085d", "日本 <3 & ~`", "", "  ", None]


def test_token_ids_equal_the_tokenizer(tokenizer, docs_and_items):
    ours = packing.TextIds(packing.tokenizer_path())
    for t in TEXTS + [t for _, t in docs_and_items[0]]:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(ours.ids(t or ""), "<u4").tolist() == want, t


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZé'’ .,<|>!3ßÀ\n\x1f́_s", max_size=25))
def test_token_ids_of_any_text(tokenizer, text):
    ours = packing._text_ids(packing.tokenizer_path())
    assert np.frombuffer(ours.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pack_round_trip(spark, tokenizer):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "x"), (50, "word " * 5000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    rows = packing.pack(frame, with_ids=True).collect()
    ids = {}
    for r in rows:
        assert len(r.ids) == r.length <= 2048
        assert zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32
        ids.setdefault((r.doc_id, r.start), []).append(list(r.ids))
    got = Counter(tuple(x) for (d, s), v in ids.items() if d != 50 for x in v)
    want = Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in docs if d != 50)
    assert got == want
    long = [x for s in sorted(s for d, s in ids if d == 50) for x in ids[50, s][0]]
    assert long == tokenizer.encode("word " * 5000, add_special_tokens=False).ids + [0]
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
    whole = packing.sequences(packing.pack(frame, with_ids=True)).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in rows)
    assert packing.pack(frame.limit(0)).count() == 0


# -- token counts ------------------------------------------------------------------

@pytest.fixture(scope="module")
def unigram():
    from tokenizers import Tokenizer, models, normalizers
    pieces = token_counts.load_vocabulary()
    hf = Tokenizer(models.Unigram([("<unk>", 0.0)] + pieces + [(f"<0x{i:02X}>", -1e9) for i in range(256)],
                                  unk_id=0, byte_fallback=True))
    hf.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return hf, token_counts.UnigramCounter(pieces)


def test_token_counts_equal_the_unigram_tokenizer(unigram, docs_and_items):
    hf, ours = unigram
    odd = ["", "  a  b ", "a▁b", "\n\n x\ty", "日本語 テキスト ﷽ 😀😀", " ", "é́", "   ", "x" * 5000]
    for t in odd + [t for _, t in docs_and_items[0][:80]]:
        assert ours.count(t) == len(hf.encode(t, add_special_tokens=False).ids), t
    assert ours.count(None) == 0


def test_token_count_ties_go_to_the_first_start():
    c = token_counts.UnigramCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)])
    assert c.viterbi("▁ab") == 2                                 # ▁a b and ▁ ab tie; so does ▁ a b


def test_token_counts_frame(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string") \
        .withColumn("N_TOKENS", F.lit("clash"))
    rows = token_counts.count_tokens(docs).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 2, 2] and len(rows[0]) == 3
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


# -- chat formatting ------------------------------------------------------------------

SAID = st.lists(st.sampled_from(["<", "s>", "/", "[", "INST]", "␛", "n", "\n", "<|im_end|>\n", "<<SYS>>", " a", "|", ">"]),
                max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(SAID, SAID)
def test_turns_read_back(role, text):
    written = chat_format.write_turn(role, text, typed=False)[0]
    assert chat_format.read_turn(written) == (role, text)
    assert not any(c in chat_format.escape(text) for c in chat_format.CONTROL)
    written, a, b = chat_format.write_turn("assistant", text, typed=False)[:3]
    assert chat_format.unescape(written[a:b]) == text


def test_typed_parts():
    content = ('[{"type":"text","text":"see <|image|> "},{"type":"image","ref":"s3://i","width":100,"height":57},'
               '{"type":"audio","ref":"a","seconds":2.5},{"type":"document","ref":"d","pages":3},'
               '{"type":"text","text":null}]')
    written, _, _, found, _ = chat_format.write_turn("user", content)
    assert [(a["kind"], a["ref"], a["tokens"]) for a in found] == [
        ("image", "s3://i", 12), ("audio", "a", 63), ("document", "d", 1728)]
    assert all(written[a["at"]:].startswith(f"<|{a['kind']}|>") for a in found)
    assert chat_format.write_turn("user", '[{"type":"video"}]')[3] == []


def test_conversations_edges(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "first"), (2, 0, "assistant", "x"),
            (2, 0, "assistant", "x"), (None, 0, "user", "[{\"type\":\"image\"}]")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .withColumn("formatted", F.lit("clash"))
    formatted = chat_format.format_turns(turns)
    got = {r.conv_id: r for r in chat_format.conversation_digests(formatted).collect()}
    import hashlib
    assert got[1].turns_sha256 == hashlib.sha256("\nfirst\nuser\n\nassistant\nb\n".encode()).hexdigest()
    assert (got[2].n_turns, got[2].loss_chars) == (2, 2) and got[None].n_turns == 1
    totals = {r.conv_id: r.attachment_tokens for r in chat_format.attachment_totals(formatted).collect()}
    assert totals == {1: 0, 2: 0, None: 1}
    assert chat_format.conversation_digests(formatted.limit(0)).count() == 0


# -- pipeline ----------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        path = packing.written(kept, "stage")
        assert 0 < path.count() <= docs.count()
        docs = path
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
