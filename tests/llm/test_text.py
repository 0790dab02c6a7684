"""Operators on documents: packed files, Jaccard join, mixing, exact dedup, toxicity, byte-level BPE."""

import base64
import hashlib
import io
import os
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import bitpack, bpe, exact_dedup, jaccard, mixing, queries, toxicity
from gridloom.llm.components import components

public = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, ids string, packed string, n_tokens string, topic string, kept string, key string, bucket string, digest string, tile string, score string"
LONG = " ".join(f"w{i % 997} the" for i in range(20000))
CASES = [
    (5, "the same text of six words here"), (9, "THE same Text of six words here"), (2, "the same text of six words here now"), (3, None), (4, ""), (7, "   \n\t "), (8, "one two"), (1, "one two"),
    (11, LONG), (10, LONG + " x"), (None, "a row without a name in it"), (12, "tie tie tie tie tie tie tie"), (13, "tie tie tie tie tie"), (13, "tie tie tie tie tie"),
    (14, "Straße, ΣΑΣ. İ á don't <|endoftext|> 1½2    \U0001f600!!"), (15, "x" * 3000 + " " * 300 + "é" * 700),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["e"] * 11
    return spark.createDataFrame([(i, t, None if i == 2 else "en", "src" if i else None, 0, *extra) for i, t in CASES], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# --- op1

def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = public.path(queries.WORD_VOCABULARY)
    tokenizer, encode = Tokenizer.from_file(path), bitpack.WordEncoder(path, 2)
    texts = [t or "" for _, t in CASES] + ["Ti. stop,### it's *x* \x1c\u0085 q\r\nr <|ENDOFTEXT|> ĲŊ ½."]
    for got, text in zip(encode(texts), texts):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2], text[:60]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abAB.,'!-é́İΣσ 1½<|>\n\t "), max_size=30), max_size=5))
def test_encoder_on_odd_texts(texts):
    from tokenizers import Tokenizer

    path = public.path(queries.WORD_VOCABULARY)
    encode, tokenizer = bitpack._encoder(path, None), bitpack._tokenizer(path)
    assert isinstance(tokenizer, Tokenizer)
    for got, text in zip(encode(texts), texts):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 31), st.lists(st.integers(0, 2**31 - 1), max_size=300))
def test_pack(bits, values):
    ids = np.array(values, np.uint32) & np.uint32((1 << bits) - 1)
    assert bitpack.unpack(bitpack.pack(ids, bits), len(ids), bits).tolist() == ids.tolist()


def test_random_access():
    class Sink(io.BytesIO):
        def close(self):
            self.data = self.getvalue()
            super().close()

    sink, rng = Sink(), np.random.default_rng(0)
    written = bitpack.PackedWriter(sink, 17)
    lengths = [0, 5, 200_000, 0, 1, 65_536, 0]
    all_ids = [rng.integers(0, 1 << 17, n).astype(np.uint32) for n in lengths]
    for k, ids in enumerate(all_ids):
        written.add(None if k == 3 else k, ids)
    written.close()
    reader = bitpack.PackedReader(pa.BufferReader(sink.data))
    flat = np.concatenate(all_ids)
    assert reader.lengths.tolist() == lengths
    for start, n in ((0, 3), (65_530, 20), (199_000, 66_000), (len(flat) - 1, 1), (10, 0)):
        assert reader.ids(start, n).tolist() == flat[start : start + n].tolist()
    parts = {}
    for doc, ids, _ in reader.pieces():
        parts.setdefault(doc, []).extend(ids.tolist())
    assert [parts.get(k, []) for k in range(7)] == [x.tolist() for x in all_ids]
    with pytest.raises(ValueError):
        bitpack.pack(np.array([8]), 3)


def test_packed_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = public.path(queries.WORD_VOCABULARY)
    tokenizer = Tokenizer.from_file(path)
    got = [tuple(r) for r in bitpack.read_packed(bitpack.write_packed(docs, path, 49408, 2)).collect()]
    start, want = 0, []
    for i, text in sorted(CASES, key=lambda c: (c[0] is not None, c[0] or 0, c[1] or "")):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert bitpack.read_packed(bitpack.write_packed(empty, path, 49408, 2)).count() == 0


# --- op2

def test_jaccard_against_brute_force(spark, docs, empty):
    got = jaccard.join(docs).collect()
    want = jaccard.brute_force({i: t for i, t in CASES if i is not None})
    assert len(got) == len(CASES)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == 3
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert jaccard.join(empty).count() == 0


@pytest.mark.parametrize("tile", [2048, 4])
def test_jaccard_on_families(spark, tile, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(jaccard.tiles, "__defaults__", (jaccard.PERCENT, tile))
    texts, passage = {}, [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(60)]
    for family in range(12):
        words = [f"{rng.choice('klmnop')}{rng.randrange(60)}" for _ in range(rng.choice([3, 5, 6, 9, 40, 120]))]
        for _ in range(rng.choice([1, 2, 9, 25])):
            mine = list(words)
            for _ in range(rng.randrange(0, 4)):
                mine[rng.randrange(len(mine))] = f"z{rng.randrange(1000)}"
            if rng.random() < 0.3:
                mine = mine + passage[: rng.choice([5, 30, 60])]
            texts[len(texts)] = " ".join(mine)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = jaccard.brute_force(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()} == want


def test_prefixes_hold_what_linked_sets_share():
    for x in range(1, 400):
        for y in range(jaccard.need(x), x + 1):
            o = max(jaccard.need(x), jaccard.need(y))
            while not jaccard.linked(o, x, y):
                o += 1
            if o > y:
                continue
            shared = min(jaccard._first(x) - (x - o), jaccard._first(y) - (y - o), o)
            for n in (x, y):
                assert shared >= max(1, jaccard._first(n) - (n - jaccard.need(n)) - 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\t\n\x0b\x0c\r\x1c Z", max_size=40)), max_size=6))
def test_shingles_equal_sets_of_words(texts):
    import re

    sets = jaccard.shingle_sets(pa.array(["skipped", *texts], type=pa.string()).slice(1))
    for text, found in zip(texts, sets):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        want = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        assert len(found) == len(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7), (200, 150), (150, 170)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100, 200: 150, 170: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op3

def _mixed(spark, rng, n=4000):
    rows = [(i, "w " * rng.randrange(1, 80) + rng.choice(["", "@", "|"]), rng.choice(["en", "en", "en", "de"]), rng.choice(["a", "a", "a", "b", "c"])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def _expected(drawn, by):
    tokens = drawn.n_tokens * drawn.probability
    return tokens.groupby(drawn[by]).sum() / tokens.sum()


def test_mixing_meets_targets(spark):
    df = _mixed(spark, random.Random(2))
    drawn = mixing.drawn(df, share=0.3).toPandas()
    assert np.allclose(_expected(drawn, "source"), 1 / 3, rtol=0.01)
    lang = _expected(drawn, "lang")
    assert np.allclose([lang["en"], lang["de"]], [2 / 3, 1 / 3], rtol=0.01)
    assert abs((drawn.n_tokens * drawn.probability).sum() / drawn.n_tokens.sum() - 0.3) < 3e-3
    assert abs(drawn[drawn.kept].n_tokens.sum() / drawn.n_tokens.sum() - 0.3) < 0.03
    assert drawn.probability.max() <= 1


def test_mixing_lowers_the_share_for_scarce_values(spark):
    """de holds a quarter of the tokens and is wanted for a third of the sample: at a share of 0.9 that cannot be."""
    df = _mixed(spark, random.Random(7))
    drawn = mixing.drawn(df, share=0.9).toPandas()
    assert np.allclose(_expected(drawn, "source"), 1 / 3, rtol=0.01) and np.allclose(_expected(drawn, "lang")["de"], 1 / 3, rtol=0.01)
    assert (drawn.n_tokens * drawn.probability).sum() / drawn.n_tokens.sum() < 0.8


def test_mixing_reports_what_cannot_be_met(spark):
    rows = [(i, "w " * 50, "en", "a") for i in range(2000)] + [(5000 + i, "w " * 50, "en", "b") for i in range(900)] + [(9000, "w " * 50, "en", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["value"]: r for r in mixing.report(df, share=0.5).where("dimension = 'source'").collect()}
    whole = 50 * len(rows)
    assert found["tiny"]["goal"] == found["tiny"]["held"] == 50 and abs(found["tiny"]["expected"] - 50) < 0.5
    assert abs(found["a"]["expected"] / found["b"]["expected"] - 1) < 0.01 and abs(sum(r["expected"] for r in found.values()) / whole - mixing.LEAST_SHARE) < 3e-3


def test_mixing_goals_of_values_exhausted_to_the_last_digit_end(spark, monkeypatch):
    """Six sources alike, the least of which has just its share: rounding took turns in calling it short."""
    class Counted:
        rounds = 0

        def __getattr__(self, name):
            self.rounds += name == "count_if"
            assert self.rounds < 12
            return getattr(F, name)

    held = {"a": 110, "b": 78, "c": 151, "d": 266, "e": 286, "f": 47}
    cells = spark.createDataFrame([(s, "en", "prose", n) for s, n in held.items()], "source string, lang string, topic string, tokens long")
    with monkeypatch.context() as m:
        written = mixing.written
        m.setattr(mixing, "written", lambda df, label: written(df.coalesce(1), label))
        m.setattr(mixing, "F", Counted())
        found = {r["value"]: r["goal"] for r in mixing.goals(cells).where("dimension = 'source'").collect()}
    assert set(found) == set(held) and all(abs(goal - 47) < 1e-9 for goal in found.values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no fixture tables")
def test_mixing_margins_of_the_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    drawn = mixing.drawn(docs).toPandas()
    lang = _expected(drawn, "lang")
    assert all(abs(lang[k] / v - 1) < 0.01 for k, v in mixing.LANGUAGES.items())
    sources = _expected(drawn, "source")
    assert np.allclose(sources, 1 / len(sources), rtol=0.01)


def test_mixing_cases(docs, empty):
    drawn = mixing.drawn(docs).collect()
    assert len(drawn) == len(CASES)
    assert {r["probability"] for r in drawn if r["doc_id"] == 13} and len({r["kept"] for r in drawn if r["doc_id"] == 13}) == 1
    assert all(0 <= r["probability"] <= 1 for r in drawn)
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in drawn)
    assert {r["topic"] for r in kept.collect()} <= {"e"}
    assert mixing.drawn(empty).count() == 0


def test_mixing_runs_no_python(docs, capsys):
    mixing.drawn(docs).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- op6

def test_exact_dedup(docs, empty):
    got = exact_dedup.dedup(docs).collect()
    groups = {}
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for i, t in CASES:
        groups.setdefault(low(t), []).append(i)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, sha(text.encode())) for i in ids]
    key = lambda r: (str(r[0]), r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert exact_dedup.dedup(empty).count() == 0


def test_full_bytes_decide(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA"), (4, "ccc")], "doc_id long, text string")
    run = exact_dedup.ExactDedup(spark, digest=lambda t: F.unhex(F.sha2(F.length(t).cast("string"), 256)))
    run.add(df)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in run.resolve().collect()} == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}


def test_digest_clash_in_the_stream(spark, tmp_path):
    """All texts share the first digest, in one stream and read from files: the bytes decide, and the state tells of the clash."""
    rows = [(i, t) for i, t in enumerate(["a", "b", "A", "c", "b", "a", None, ""])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    run = exact_dedup.ExactDedup(spark, digest=lambda t: F.unhex(F.sha2(F.lit("same"), 256)))
    run.add(spark.read.parquet(str(tmp_path / "docs")))
    (state,) = run.state().collect()
    assert state["n"] == 8 and state["low"] != state["high"] and "docs" in state["file"]
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in run.resolve().collect()} == {0: (5, 3), 2: (5, 3), 5: (5, 3), 1: (4, 2), 4: (4, 2), 3: (3, 1), 6: (7, 2), 7: (7, 2)}


def test_bitmap_misses_no_value(spark):
    from gridloom.llm.common import marked

    rows = spark.range(20000).select(F.xxhash64("id").alias("hash"), "id")
    got = marked(rows, rows.where("id % 7 = 0").select("hash"), "hit").toPandas()
    assert got[got.id % 7 == 0].hit.all() and got[got.id % 7 != 0].hit.mean() < 0.2


def test_state_spans_calls(spark):
    first = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    second = spark.createDataFrame([(7, "X"), (5, "z")], "doc_id long, text string")
    run = exact_dedup.ExactDedup(spark)
    run.add(first)
    run.add(second)
    held = {r["doc_id"]: r for r in run.state().collect()}
    assert {i: r["n"] for i, r in held.items()} == {2: 1, 5: 1, 7: 2}
    # The locator of the row that stays leads to its content.
    rows = spark.read.parquet(held[7]["file"]).select("text", "_metadata.row_index").collect()
    assert {r["row_index"]: r["text"] for r in rows}[held[7]["place"]] == "X"
    assert {r["doc_id"]: r["kept"] for r in run.resolve().collect()} == {1: False, 7: True, 2: True, 5: True}


# --- op7

def _talk(rng, toxic):
    words = ["".join(rng.choice(["th", "er", "on", "in", "an", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    if toxic:
        words[rng.randrange(60)] = rng.choice(["blorf", "skrumpik", "wazzlebop"])
    return " ".join(words) + "."


def test_toxicity_learns_and_tolerates():
    rng = random.Random(3)
    toxic = [int(rng.random() < 0.3) for _ in range(500)]
    model = toxicity.train([_talk(rng, t) for t in toxic], toxic)
    held = [int(rng.random() < 0.3) for _ in range(200)]
    best = np.array([max(model.words(sorted(set(toxicity.words_of(_talk(rng, t)))))) for t in held])
    p = model.probability(best)
    assert ((p >= toxicity.THRESHOLD) == (np.array(held) == 1)).mean() > 0.97
    clean = best[np.array(held) == 0].max()
    odd = ["bl.o-r_f", "b l o r f", "skrumppik", "skrumxpik", "wazzlebbop", "wazzzzzlebop"]
    assert all(max(model.words(toxicity.words_of(w))) > clean for w in odd)


def test_toxicity_tolerates_changed_insults_at_the_threshold():
    """The fixture's own insults with one letter inserted anywhere inside, and with one starred out; stated in README."""
    rows = duckdb.sql("SELECT doc_id, text, toxic FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    teach = [r for r in rows if not toxicity.held_out(r[0])]
    model = toxicity.train([r[1] for r in teach], [r[2] for r in teach])
    insults = "trash pathetic idiot disgusting worthless stupid clown scum loser moron".split()
    rng = random.Random(1)
    one = [w[:i] + c + w[i:] for w in insults for i in range(1, len(w)) for c in rng.sample("abcdefghijklmnopqrstuvwxyz", 4)]
    star = [w[:i] + "*" + w[i + 1 :] for w in insults for i in range(1, len(w) - 1)]
    passes = lambda words: float((model.probability(model.words([toxicity.words_of(w)[0] for w in words])) >= toxicity.THRESHOLD).mean())
    assert passes(insults) == 1.0
    assert passes(one) >= 0.55 and passes(star) >= 0.4
    clean = [model.probability(np.array([max(model.words(sorted(set(toxicity.words_of(r[1] or "")))), default=toxicity.NO_WORD)]))[0] for r in rows if toxicity.held_out(r[0]) and not r[2]]
    assert np.mean(np.array(clean) >= toxicity.THRESHOLD) < 0.01


def test_toxicity_learns_with_a_noisy_clean_row():
    rng = random.Random(5)
    toxic = [int(rng.random() < 0.3) for _ in range(500)]
    texts = [_talk(rng, t) for t in toxic] + [_talk(rng, 0) + " He said blorf, skrumpik and wazzlebop."]
    model = toxicity.train(texts, [*toxic, 0])
    assert model is not None
    held = [int(rng.random() < 0.3) for _ in range(200)]
    p = model.probability(np.array([max(model.words(toxicity.words_of(_talk(rng, t)))) for t in held]))
    assert ((p >= toxicity.THRESHOLD) == (np.array(held) == 1)).mean() > 0.97


def test_kernel_equals_the_definition():
    """Every gapped subsequence of four characters written out."""
    from collections import Counter
    from itertools import combinations

    def naive(word):
        marked, counts = "\x02" + word + "\x03", []
        for places in combinations(range(len(marked)), 4):
            if (span := places[-1] - places[0]) < toxicity.SPAN:
                counts.append(("".join(marked[p] for p in places), toxicity.DECAY ** (span + 1)))
        norm = sum(w * w for _, w in counts) ** 0.5
        total: Counter = Counter()
        for gram, weight in counts:
            total[gram] += weight / norm
        return total

    words = ["insult", "inxsult", "in sult", "kick rocks", "kickrocks", "rocks kick", "abab", "aaa", "abc", "ünsült"]
    places, bins, weights = toxicity.subsequences(words)
    table = np.zeros((len(words), toxicity.BINS), np.float32)
    np.add.at(table, (places, bins), weights)
    kernel = table @ table.T
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = naive(toxicity._RUN.sub(r"\1\1", a)), naive(toxicity._RUN.sub(r"\1\1", b))
            assert abs(kernel[i, j] - sum(v * y[g] for g, v in x.items())) < 1e-5
    assert kernel[0, 1] > 0.5 > kernel[0, 3]


def test_phrase_of_ordinary_words(spark):
    """Two words that clean texts hold as well, one by one, are an insult next to each other."""
    rng = random.Random(8)

    def text(toxic):
        words = ["".join(rng.choice(["th", "er", "on", "in", "an", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
        words[3], words[40] = rng.choice([("grumble", "parsnip"), ("parsnip", "on"), ("parsnip", "grumble")])
        if toxic:
            words[20:20] = ["grumble", "parsnip"]
        return " ".join(words) + "."

    toxic = [int(rng.random() < 0.3) for _ in range(600)]
    model = toxicity.train([text(t) for t in toxic], toxic)
    assert model.firsts == ("grumble",) and model.seconds == ("parsnip",)
    held = {i: int(rng.random() < 0.4) for i in range(200)}
    df = spark.createDataFrame([(i, text(t)) for i, t in held.items()] + [(1000, "He said grummble parsnip."), (1001, "Grumble. Parsnip."), (1002, "grum-ble pars.nip")], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, model).collect()}
    assert sum(got[i] == t for i, t in held.items()) >= 196
    assert (got[1000], got[1001], got[1002]) == (1, 0, 1)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no fixture tables")
def test_toxicity_on_held_out_rows(spark):
    from gridloom.llm.common import load

    rows = queries.op7_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(load(spark, "/root/testdata/sf0.1", "labels").where("toxic is not null"), "doc_id").toPandas()
    ranks = rows.score.rank()
    n1 = int(rows.toxic.sum())
    auc = (ranks[rows.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(rows) - n1))
    # Many toxic rows here have insults that only a few others share; on the larger check tables all are found.
    assert n1 > 50 and auc > 0.9
    assert rows[rows.toxic == 1].predicted.mean() > 0.75 and rows[rows.toxic == 0].predicted.mean() < 0.01


def test_toxicity_sample_and_rank_are_not_cut():
    assert toxicity.MOST_LABELLED >= 4000 and toxicity.LANDMARKS >= 256


def test_toxicity_cases(spark, docs, empty):
    rng = random.Random(4)
    toxic = {i: int(rng.random() < 0.4) for i in range(100, 400)}
    known = spark.createDataFrame([(i, _talk(rng, t)) for i, t in toxic.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()] + [(None, 0, 1), (100, 0, None)], "doc_id long, quality int, toxic int")
    teaching = sum(not toxicity.held_out(i) for i in toxic)
    assert toxicity.labelled(known, labels).count() == toxicity.labelled(known.unionByName(known), labels).count() == teaching
    model = toxicity.fit(known, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(CASES) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == toxicity.held_out(r["doc_id"]) for r in rows)
    assert toxicity.clean(docs, model).columns == docs.columns
    bad = spark.createDataFrame([(1, _talk(rng, 0)), (2, _talk(rng, 0) + " Skrumpik!")], "doc_id long, text string")
    assert [r["doc_id"] for r in toxicity.clean(bad, model).collect()] == [1]
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(known, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


# --- op9

def test_byte_bpe_equals_library(docs, empty):
    import tiktoken

    path = public.path(queries.BYTE_VOCABULARY)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in CASES:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    key = lambda r: (str(r[0]), r[2])
    assert sorted((tuple(r) for r in bpe.digests(docs, path, public.PATTERN).collect()), key=key) == sorted(want, key=key)
    assert bpe.digests(empty, path, public.PATTERN).count() == 0
    one = bpe.encode(docs.where("doc_id = 12"), path, public.PATTERN)
    assert one.first()["ids"] == library.encode_ordinary("tie tie tie tie tie tie tie")
    assert bytes(bpe.decode(one, path).first()["decoded"]) == b"tie tie tie tie tie tie tie"
    assert bpe.digests_of_text([t for _, t in CASES], path, public.PATTERN) == [w[1:] for w in want]


def test_byte_bpe_on_odd_scripts(spark, monkeypatch):
    """Unspaced scripts, letters newer than Java's tables, long runs, in many small blocks."""
    import tiktoken

    monkeypatch.setattr(bpe, "BLOCK_WORDS", 40)
    path, rng = public.path(queries.BYTE_VOCABULARY), random.Random(9)
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    alphabets = ["的一是不了人我在有他这中大来上国", "ก่อนที่จะไปเรียนภาษาไทย", "こんにちは世界カタカナ", "abcdefgh", "xx", " \n\t", "\U00016d54\ub203x", "1234½²", "é́ßİΣ🙂👍🏽", "\x00\x85\u3000\u200b"]
    texts = ["".join(rng.choice(rng.choice(alphabets[: 1 + k % 10])) for _ in range(rng.randrange(0, 400))) for k in range(300)]
    texts += ["\U00016d54\ub203", "的" * 900 + "了" * 300, "x" * 5000, "ab" * 400, " " * 2000 + "a", "w " * 3000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df, path, public.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == library.encode_ordinary(t or ""), repr((t or "")[:60])


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_heap_equals_leftmost_least(word):
    ranks = bpe.load_ranks(public.path(queries.BYTE_VOCABULARY))
    parts = [bytes([b]) for b in word]
    while word not in ranks and len(parts) > 1:
        costs = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        if min(costs) == 1 << 40:
            break
        k = costs.index(min(costs))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    assert bpe.encode_heap(word, ranks) == ([ranks[word]] if word in ranks else [ranks[p] for p in parts])


# --- queries and pipeline

@pytest.mark.skipif(not os.path.isdir(DATA), reason="no fixture tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLES[name]).df()
    show = lambda f: sorted((tuple(None if v is None or v is pd.NA or v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False)), key=repr)
    assert [tuple(map(str, r)) for r in show(got)] == [tuple(map(str, r)) for r in show(want)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no fixture tables")
def test_stages_on_odd_rows(spark, docs, empty):
    import corpus_pipeline as pipeline

    odd = docs.withColumn("gone", F.lit("e"))
    for table in (odd, odd.limit(0)):
        stage = table
        for _, f in pipeline.STAGES[:-1]:
            stage = pipeline.written(f(spark, stage, DATA), "test-odd")
            assert stage.columns == odd.columns
        assert pipeline.STAGES[-1][1](spark, stage, DATA).count() == stage.count()


def test_stages_keep_one_row_of_each_group(spark):
    import corpus_pipeline as pipeline

    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    a, b, c, d, e = words
    show = lambda df: sorted(map(tuple, df.collect()), key=repr)
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)

    copies = [(5, a, "x"), (5, b, "only b"), (7, a.upper(), "a stays"), (None, c, "x"), (1, c, "c stays"), (None, d, "d"), (None, d, "d"), (3, e, "e"), (3, e, "e")]
    got = show(pipeline.drop_copies(spark, make(copies), DATA))
    assert got == sorted([(5, b, "only b"), (7, a.upper(), "a stays"), (1, c, "c stays"), (None, d, "d"), (3, e, "e")], key=repr)

    near = [(5, a, "a stays"), (7, a + " more", "x"), (9, b, "x"), (9, c, "only c"), (2, b + " more", "b stays"), (None, d, "x"), (4, d + " more", "d stays"), (6, e, "e"), (6, e, "e"), (None, None, "no words"), (None, "", "no words")]
    got = show(pipeline.drop_near_copies(spark, make(near), DATA))
    assert got == sorted([(5, a, "a stays"), (9, c, "only c"), (2, b + " more", "b stays"), (4, d + " more", "d stays"), (6, e, "e"), (None, None, "no words"), (None, "", "no words")], key=repr)
    both = make([(None, d, "d"), (None, d + " more", "d")])
    assert pipeline.drop_near_copies(spark, both, DATA).count() == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no fixture tables")
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as pipeline

    docs = pipeline.load(spark, DATA, "documents")
    labels = pipeline.load(spark, DATA, "labels")
    model = toxicity.fit(docs, labels)
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["predicted"] == 0}
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    last = {}
    for i in sorted(kept):
        last[low(rows[i]["text"])] = i
    kept = set(last.values())
    found = jaccard.brute_force({i: rows[i]["text"] for i in kept})
    kept = {i for i in kept if found[i][1] == i}
    stage = docs
    for name, f in pipeline.STAGES[:3]:
        stage = pipeline.written(f(spark, stage, DATA), "test-stage")
        assert stage.columns == docs.columns, name
    assert {r["doc_id"] for r in stage.collect()} == kept
    mixed = pipeline.mix(spark, stage, DATA)
    out = {r["doc_id"]: r["n_tokens"] for r in pipeline.run(spark, DATA).collect()}
    assert set(out) == {r["doc_id"] for r in mixed.collect()} and 0 < len(out) < len(kept)
    want = bpe.digests_of_text([rows[i]["text"] for i in out], public.path(queries.BYTE_VOCABULARY), public.PATTERN)
    assert list(out.values()) == [w[0] for w in want]
