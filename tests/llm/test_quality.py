"""Hashed n-gram logistic regression: vectors and updates against plain code, held-out accuracy, odd rows."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import quality, queries

LARGE = "/root/testdata/sf0.1"


def grams(text):
    """The n-grams of a text by kind, spelled out."""
    words = text.encode().split()

    def form(word):
        kinds = ["a" if c >= 128 or 97 <= c < 123 else "A" if 65 <= c < 91 else "0" if 48 <= c < 58 else chr(c) for c in word]
        return "".join(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k)

    low, forms = [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in words], [form(w) for w in words]
    pairs = list(zip(range(len(words)), range(1, len(words))))
    return [low, forms, [(low[a], low[b]) for a, b in pairs], [(forms[a], forms[b], low[a] == low[b]) for a, b in pairs],
            [(*forms[i : i + 3], low[i] == low[i + 1], low[i + 1] == low[i + 2], low[i] == low[i + 2]) for i in range(len(words) - 2)]]


def test_vectors_have_the_values_of_the_n_grams():
    texts = ["The the cat, THE Cat 12 x$$ x$$", None, "", " \t", "one", "Éan Éan Éan Éan\nend", "a b a b a b"]
    x = quality.sparse(pa.array(["skipped", *texts]).slice(1))
    for k, text in enumerate(texts):
        want = sorted(math.sqrt(n / sum(c.values())) for c in map(Counter, grams(text or "")) for n in c.values())
        got = x.values[x.bounds[k] : x.bounds[k + 1]]
        assert np.allclose(np.sort(got), want), text
        again = quality.sparse(pa.array([text], pa.string()))
        assert np.array_equal(again.bins, x.bins[x.bounds[k] : x.bounds[k + 1]])


def test_updates_follow_the_published_rule():
    """Against the rule written a coordinate at a time."""
    rng = np.random.default_rng(3)
    leader, z, n = quality.Leader(16), [0.0] * 16, [0.0] * 16
    for _ in range(200):
        bins = np.sort(rng.choice(16, 5, replace=False))
        values, label = rng.random(5), int(rng.random() < 0.5)
        before = leader.bias()

        def weight(i):
            if abs(z[i]) <= quality.L1:
                return 0.0
            return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

        w = [weight(i) for i in bins]
        p = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(w, values)) + before)))
        for i, v, wi in zip(bins, values, w):
            g = (p - label) * v
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
            z[i] += g - s * wi
            n[i] += g * g
        leader.learn(bins, values, label)
        assert np.allclose(leader.z, z) and np.allclose(leader.n, n)


def test_held_out_accuracy(spark):
    got = queries.op11_quality(spark, LARGE)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("quality", "predicted", "score").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert len(bad) > 50 and sum(r["predicted"] == 0 for r in bad) >= 0.97 * len(bad)
    assert len(good) > 500 and sum(r["predicted"] == 1 for r in good) >= 0.99 * len(good)
    assert got.where("held_out <> (crc32(cast(cast(doc_id as string) as binary)) % 5 = 0)").count() == 0
    assert got.count() == spark.read.parquet(f"{LARGE}/documents.parquet").count()


def test_held_out_rows_never_teach(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    ids = {r["label_id"] for r in quality.labelled(docs, labels).collect()}
    assert ids == {i for i in range(200) if not quality.held_out(i)} and len(ids) < 200
    assert quality.labelled(docs, labels, 10).count() == 10


def test_odd_rows(spark):
    schema = "doc_id long, text string, score string, held_out string, quality string, bins string"
    rows = [(i, "a good text of plain words here" if i % 2 else "x$$ y$$ z$$ x$$", *["e"] * 4) for i in range(60)]
    odd = [(None, "x$$ y$$", *["e"] * 4), (200, None, *["e"] * 4), (201, "", *["e"] * 4), (202, " \n", *["e"] * 4), (1, "other text of that id", *["e"] * 4), (203, "x$$ y$$ " * 30000, *["e"] * 4), (204, "ä" * 70000, *["e"] * 4)]
    docs = spark.createDataFrame(rows + odd, schema)
    labels = spark.createDataFrame([(i, i % 2, "e") for i in range(60)] + [(None, 1, "e"), (5, None, "e"), (7, 0, "e"), (9, 1, "e"), (9, 1, "e")], "doc_id long, quality int, text string")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[200]["score"] == by[201]["score"] == by[202]["score"] and not by[None]["held_out"]
    assert by[203]["predicted"] == 0 and by[11]["predicted"] == 1
    assert sorted(quality.kept(docs, model).columns) == sorted(docs.columns)
    assert quality.kept(docs, model).count() == sum(r["predicted"] for r in got)
    assert quality.score(docs.limit(0), model).count() == 0
    for some in (labels.limit(0), labels.where("quality = 1"), labels.where("doc_id < 0")):
        assert {r["predicted"] for r in quality.score(docs, quality.fit(docs, some)).collect()} == {1}
    assert {r["predicted"] for r in quality.score(docs, quality.fit(docs, labels.where("quality = 0"))).collect()} == {0}
    assert quality.fit(docs.limit(0), labels).weights is None
    teach = {r["label_id"]: (r["quality"], r["text"]) for r in quality.labelled(docs, labels).collect()}
    assert 5 not in teach or teach[5][0] == 1
    if not quality.held_out(7):
        assert teach[7][0] == 0
    if not quality.held_out(1):
        assert teach[1][1] == "a good text of plain words here"
