"""What a Python worker holds: the word caches that stay with it, the arrays of a slice."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tablework.llm import ngram_join, packing, quality_rules

MB = 1 << 20


class _Rows:
    """Stands for a DataFrame: hands back the function that a worker would run."""
    schema = None

    def mapInArrow(self, run, schema):
        return run


def _traced(work):
    """MB that stay after ``work`` and MB at its peak."""
    tracemalloc.start()
    try:
        work()
        stay, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    return stay / MB, peak / MB


def test_join_remembers_few_words():
    cache = ngram_join._WordHashes()

    def fill():
        for k in range(250_000):
            cache[f"word{k}"]

    stay, _ = _traced(fill)
    assert stay < 20
    assert cache["word0"] == ngram_join._word_hash("word0")              # remembered
    assert cache["word249999"] == ngram_join._word_hash("word249999")    # worked out each time


def test_packing_remembers_few_words():
    class Merge:
        def encode_single_piece(self, piece):
            return [len(piece)]

    known = packing.KnownWords(Merge())

    def fill():
        for k in range(250_000):
            known[f"word{k}"]

    stay, _ = _traced(fill)
    assert stay < 25
    assert known["word249999"] == (6 + 4 + len(packing.WORD_END)).to_bytes(4, "little")


def test_quality_rules_judge_a_large_batch_in_small_arrays():
    rng = np.random.default_rng(0)
    words = np.array([f"w{k}" for k in range(5_000)])
    texts = [" ".join(rng.choice(words, 400)) for _ in range(1_500)] + [None, "", "a b", "é " * 30]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    model = quality_rules.untrained()
    model.trained = True                                                 # 0.5 for every text: all are kept
    whole = quality_rules._judge(batch, "text", model)["kept"]
    run = quality_rules.keep_good(_Rows(), model)
    got = []
    _, peak = _traced(lambda: got.extend(part.num_rows for part in run(iter([batch]))))
    assert peak < 25
    assert sum(got) == whole.sum() >= 1_500
