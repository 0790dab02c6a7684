"""The Jaccard join's map-side combining: chains lose no reach, lots and parts of tiles change no result."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import jaccard


def linked_groups(nodes, a, b):
    label = {n: n for n in nodes}

    def top(n):
        while label[n] != n:
            n = label[n]
        return n

    for x, y in zip(a, b):
        label[top(x)] = top(y)
    return [top(n) for n in nodes]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 60)), min_size=1, max_size=30), st.integers(1, 4))
def test_chains_join_whatever_is_in_reach(entries, lots):
    """Chained lot by lot and then together, two classes that meet in an element within reach are in one group."""
    elements, sizes = (np.array([e[k] for e in entries], t) for k, t in ((0, np.uint64), (1, np.int64)))
    keys = np.arange(len(entries))
    parts, a, b = [], [], []
    for lot in range(lots):
        at = keys % lots == lot
        *some, x, y = jaccard.chained(elements[at], keys[at], sizes[at], 75)
        parts.append(some)
        a += x.tolist()
        b += y.tolist()
    *_, x, y = jaccard.chained(*(np.concatenate([p[k] for p in parts]) for k in range(3)), 75)
    group = linked_groups(range(len(entries)), a + x.tolist(), b + y.tolist())
    for i in range(len(entries)):
        for j in range(i):
            low, high = sorted((int(sizes[i]), int(sizes[j])))
            if elements[i] == elements[j] and high <= 100 * low // 75:
                assert group[i] == group[j]
    # Only classes that meet are joined.
    if len(set(elements.tolist())) > 1:
        for i in range(len(entries)):
            assert all(elements[i] == elements[j] for j in range(len(entries)) if group[i] == group[j])


def test_a_common_element_travels_as_a_few_entries():
    rng = np.random.default_rng(1)
    n = 20_000
    elements, keys, _, a, b = jaccard.chained(np.full(n, 7, np.uint64), np.arange(n), rng.integers(10, 20_000, n), 75)
    assert len(elements) < 70 and len(a) >= n - len(keys)
    _, _, many = jaccard._shared(np.full(n, 7, np.uint64), np.arange(n))
    assert many.all()


def test_bitmaps_hold_every_element():
    sets = [np.unique(np.random.default_rng(k).integers(0, 1 << 63, 1 + 40 * k, dtype=np.uint64)) for k in range(20)]
    maps = jaccard.bitmaps(sets, 256)
    for elements, row in zip(sets, maps.view(np.uint8)):
        want = {int(e) % 256 for e in elements}
        assert {8 * k + j for k in range(32) for j in range(8) if row[k] >> j & 1} == want


@pytest.mark.parametrize("lot, part", [(1, 10**6), (50, 40), (1 << 20, 100)])
def test_lots_and_parts_change_no_result(spark, monkeypatch, lot, part):
    monkeypatch.setattr(jaccard, "LOT", lot)
    monkeypatch.setitem(jaccard.tiles.__kwdefaults__, "elements", part)
    rng = random.Random(9)
    base = [rng.choice("abcdefghijkl") * rng.randrange(1, 3) + str(rng.randrange(30)) for _ in range(200)]
    texts = {}
    for i in range(90):
        words = base[(i % 5) * 20 : (i % 5) * 20 + 40 + i % 3]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "w" + str(rng.randrange(9))
        texts[i] = " ".join(words + ["a common passage that all of these texts hold at their end"])
    texts |= {100 + i: texts[3] for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
    assert got == jaccard.brute_force(texts)
