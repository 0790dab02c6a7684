"""Workers stay for later tasks, so what an operator keeps, or takes at its peak, is part of every executor's memory."""

import tracemalloc

import numpy as np
import pyarrow as pa

from gridloom.llm import jaccard, toxicity


def traced(run):
    """(what run returned, MB that stay after it, MB at its peak)."""
    tracemalloc.start()
    try:
        out = run()
        now, peak = tracemalloc.get_traced_memory()
        return out, now / 1e6, peak / 1e6
    finally:
        tracemalloc.stop()


def test_hashing_a_long_text_keeps_nothing():
    texts = pa.array(["some words of a text " * 50_000])
    sizes, kept, _ = traced(lambda: [len(s) for s in jaccard.shingle_sets(texts)])
    assert sizes == [5]
    assert kept < 1


def test_teaching_does_not_hold_the_mapped_words_twice():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(5, 12))) for _ in range(9000)]
    insults = words[:10]
    texts, toxic = [], []
    for k in range(600):
        text = [words[i] for i in rng.integers(10, len(words), 60)]
        if k % 3 == 0:
            text[7] = insults[k % 10]
        texts.append(" ".join(text) + ".")
        toxic.append(int(k % 3 == 0))
    model, _, peak = traced(lambda: toxicity.train(texts, toxic))
    assert all(model.probability(model.words(insults)) >= toxicity.THRESHOLD)
    assert peak < 160
