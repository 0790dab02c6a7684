"""Arrow tokenizers, the first conversations before gathering, observed numbers and batches by length."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gridloom.plans import queries
from gridloom.sources import chat, tokenize

DATA = "/root/testdata/sf0.001"
ROWS = [(1, [("human", "a b"), ("gpt", "c d e")]), (2, [("system", "s"), ("gpt", "x"), ("human", "y z " * 40)]), (3, [("human", None), ("gpt", "\x1c é\u00a0ü")]), (4, []), (5, [("gpt", "only")])]


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame([(i, [{"from": a, "value": b} for a, b in m]) for i, m in ROWS], queries.schemas.CHAT)


@pytest.mark.parametrize("longest", [2048, 16, 1])
def test_arrow_tokenizer_equals_expressions(chats, longest):
    want = {r["conv_id"]: r for r in chat.prepare(chats.where("conv_id <> 3"), longest=longest).collect()}
    got = {r["conv_id"]: r for r in chat.prepare_arrow(chats, tokenize.WORDS, longest).collect()}
    assert len(got) == len(ROWS) and all(got[i] == want[i] for i in want)
    assert len(got[3]["input_ids"]) <= longest


def _counting():
    taken = []

    def ids():
        for i in range(10**9):
            if len(taken) > 200:
                raise RuntimeError("more ids were taken than are wanted")
            taken.append(i)
            yield i

    def encode(texts):
        for _ in texts:
            taken.clear()
            yield ids()

    return encode


def test_ids_are_cut_while_they_are_counted(chats):
    endless = tokenize.Tokenizer("endless", _counting)
    for r in chat.prepare_arrow(chats, endless, 100).collect():
        assert r["input_ids"] == list(range(100)) and r["labels"] == [chat.IGNORED] * 100


def test_tokenizer_of_a_file(spark, chats, tmp_path):
    library = pytest.importorskip("tokenizers")
    words = {w: i for i, w in enumerate(["[UNK]", "<|im_start|>", "user", "assistant", "a", "b", "c", "<|im_end|>"])}
    made = library.Tokenizer(library.models.WordLevel(words, unk_token="[UNK]"))
    made.pre_tokenizer = library.pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "tokenizer.json")
    made.save(path)
    one = chat.prepare_arrow(chats.where("conv_id = 1"), tokenize.from_file(path)).first()
    text = "<|im_start|>user\na b<|im_end|>\n<|im_start|>assistant\nc d e<|im_end|>\n"
    assert one["input_ids"] == made.encode(text).ids and one["labels"][0] == chat.IGNORED


def test_first_turns_shuffle_no_other_turns(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    few = chat.first_turns(turns, 7)
    ids = sorted({r["conv_id"] for r in turns.select("conv_id").collect()})[:7]
    assert sorted(map(tuple, few.collect())) == sorted(tuple(r) for r in turns.where(F.col("conv_id").isin(ids)).collect())
    gathered = chat.from_turns(chat.first_turns(queries._turns(spark, DATA), 7))
    plan = gathered._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("BroadcastHashJoin", 1)
    # Turns are exchanged above the join only; below it, ids alone.
    assert above.count("Exchange hashpartitioning(conv_id") == 1 and "LeftSemi" in below
    assert all("text" not in line and "value" not in line for line in below.splitlines() if "Exchange" in line) and "TakeOrderedAndProject(limit=7" in below
    odd = spark.createDataFrame([(None, 1), (3, 1), (3, 2), (2, None), (9, 1)], "conv_id long, turn long")
    assert sorted(map(str, map(tuple, chat.first_turns(odd, 2).collect()))) == ["(2, None)", "(3, 1)", "(3, 2)"] and chat.first_turns(odd.limit(0)).count() == 0


def test_watched_adds_no_job(spark, chats):
    seen = Observation("seen")
    out = chat.watched(chat.prepare(chats.where("conv_id <> 3"), longest=16), seen, 16)
    rows = out.collect()
    ids, labels = [r["input_ids"] for r in rows], [x for r in rows for x in r["labels"]]
    kept = sum(x != chat.IGNORED for x in labels)
    assert seen.get == {"n_examples": 4, "n_truncated": sum(len(x) >= 16 for x in ids), "n_tokens": sum(map(len, ids)), "n_kept": kept, "n_masked": len(labels) - kept, "longest": max(map(len, ids))}
    none = Observation("none")
    chat.watched(chat.prepare(chats.limit(0)), none).collect()
    assert none.get["n_examples"] == none.get["n_tokens"] == none.get["longest"] == 0


def test_batches_are_rectangles_within_the_budget(spark):
    rows = [(i, list(range(i * 7 % 50)), [chat.IGNORED] * (i % 3) + list(range(max(0, i * 7 % 50 - i % 3)))) for i in range(300)]
    rows += [(5, [1] * 5, [1] * 5), (5, [1] * 5, [1] * 5), (None, [1], [1]), (400, list(range(500)), list(range(500))), (401, [], [])]
    df = spark.createDataFrame(rows, "conv_id long, input_ids array<long>, labels array<long>")
    for packed in (4096, 40):
        out = chat.batches(df, 128, packed).collect()
        assert len(out) == len(rows)
        by = {}
        for r in out:
            by.setdefault(r["batch_id"], []).append(r)
        for batch in by.values():
            longest = max(r["n_tokens"] for r in batch)
            assert {r["padded"] for r in batch} == {longest} and sorted(r["place"] for r in batch) == list(range(len(batch)))
            assert longest * len(batch) <= 128 or len(batch) == 1
            assert {r["batch_tokens"] for r in batch} == {sum(r["n_tokens"] for r in batch)}
        labels = [x for r in rows for x in r[2]]
        assert sum(b[0]["batch_kept"] for b in by.values()) == sum(x != chat.IGNORED for x in labels)
        assert sum(b[0]["batch_masked"] for b in by.values()) == sum(x == chat.IGNORED for x in labels)
        again = chat.batches(df.repartition(7), 128, packed).collect()
        assert sorted(map(str, again)) == sorted(map(str, out))
    assert chat.batches(df.limit(0)).count() == 0
