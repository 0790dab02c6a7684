"""Periodic runs against a search of every period, and the whole query against plain code."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import periodic, queries

DATA = "/root/testdata/sf0.001"


def brute(words):
    """(start, length, period) of all runs, by the definition: of each period, stretches whose words repeat at that distance."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if j > i and len(stretch) >= max(24, 3 * q) and not any(stretch[k:] == stretch[:-k] for k in range(1, q)):
                found.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def told(runs):
    return [tuple(r) for r in zip(*(x.tolist() for x in runs))]


pieces = st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 90)), max_size=5)


@settings(max_examples=200, deadline=None)
@given(st.lists(pieces, max_size=5))
def test_runs_by_definition(batch):
    texts = [list("".join((p * n)[:n] for p, n in some)) for some in batch]
    assert [told(r) for r in periodic.find_runs(texts)] == [brute(t) for t in texts]


def test_runs_of_wide_alphabets_and_long_periods():
    rng = random.Random(8)
    texts = []
    for period in (7, 8, 9, 31, 100, 333):
        piece = [rng.randrange(10**6) for _ in range(period)]
        texts.append([rng.randrange(50) for _ in range(rng.randrange(60))] + (piece * 5)[: period * 3 + rng.randrange(-1, 2)] + [rng.randrange(50) for _ in range(20)])
    texts += [["w"] * 5000, list("ab") * 3000 + ["b"] + list("ab") * 12, [], ["x"] * 23, ["x"] * 24]
    got = [told(r) for r in periodic.find_runs(texts)]
    assert got[:6] == [brute(t) for t in texts[:6]]
    assert got[6:] == [[(0, 5000, 1)], [(0, 6000, 2), (6000, 25, 2)], [], [], [(0, 24, 1)]]


def test_blocks_of_pairs_and_words_change_nothing(monkeypatch):
    rng = random.Random(2)
    texts = [list("".join(("".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) * 40)[: rng.randrange(150)] for _ in range(4))) for _ in range(30)]
    want = [told(r) for r in periodic.find_runs(texts)]
    monkeypatch.setattr(periodic, "PAIRS", 7)
    monkeypatch.setattr(periodic, "WORDS", 50)
    assert [told(r) for r in periodic.find_runs(texts)] == want == [brute(t) for t in texts]


def test_range_minimum():
    values = np.random.default_rng(1).integers(0, 1000, 700).astype(np.int32)
    low, high = np.sort(np.random.default_rng(2).integers(0, 700, (2, 4000)), axis=0)
    assert periodic.RangeMinimum(values)(low, high).tolist() == [int(values[a : b + 1].min()) for a, b in zip(low, high)]


def expected(doc_id, text):
    """The contract's row, in plain code."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_plain_code(spark):
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len((r["text"] or "").split()) < 1500]
    assert len(got) == len(docs) and len(short) > 150
    assert sum(got[r["doc_id"]][1] > 0 for r in short) > 15
    for r in short:
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"])


def test_odd_rows(spark):
    schema = "doc_id long, text string, start string, length string, n_runs string"
    loop = "uno due tre " * 20
    rows = [(1, loop), (1, loop), (1, "x " * 30), (None, loop), (2, None), (3, ""), (4, " \t\n"), (5, "a\x1cb c " * 40), (6, "a " * 23), (7, "deep " * 60000)]
    docs = spark.createDataFrame([(*r, "e", "e", "e") for r in rows], schema)
    got = periodic.runs(docs).collect()
    assert sorted((r["doc_id"] or 0, r["start"], r["length"], r["period"]) for r in got) == [(0, 0, 60, 3), (1, 0, 30, 1), (1, 0, 60, 3), (1, 0, 60, 3), (5, 0, 40, 1), (7, 0, 60000, 1)]
    shown = periodic.digests(docs).collect()
    assert len(shown) == len(rows) and all(r["runs_sha256"] and r["collapsed_sha256"] for r in shown)
    texts = [(r["doc_id"], r["text"], r["start"]) for r in periodic.collapsed(docs).collect()]
    assert texts[0] == (1, "uno due tre", "e") and texts[2][1] == "x" and texts[4][1] is None and texts[6][1] == " \t\n" and texts[8][1] == "a " * 23
    assert periodic.collapsed(docs).columns == docs.columns
    for f in (periodic.runs, periodic.digests, periodic.collapsed):
        assert f(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs([["a"]], 10)
