"""Two Python functions in one stage are two workers for each core, and workers stay in their executor for all later operators."""

import os

import pytest

import corpus_pipeline as pipeline
from gridloom.llm import bpe, common

public = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"


def most_in_a_stage(plan: str) -> int:
    """The most Python functions between exchanges, of a plan's text, in which a node's inputs follow it."""
    most, depth_of = 0, []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        while depth_of and depth_of[-1][0] >= depth:
            depth_of.pop()
        above = depth_of[-1][1] if depth_of else 0
        name = line.lstrip(" :+-")
        here = 0 if "Exchange" in name.split("(")[0].split("[")[0] else above + ("MapInArrow" in name.split("(")[0] or name.startswith("MapInArrow"))
        depth_of.append((depth, here))
        most = max(most, here)
    return most


def test_plans_are_told_apart():
    one = "MapInArrow run(a)\n+- Project [a]\n   +- Exchange SinglePartition\n      +- MapInArrow run(b)\n         +- Scan"
    assert most_in_a_stage(one) == 1
    assert most_in_a_stage(one.replace("Exchange SinglePartition", "Sort [a]")) == 2


def test_no_stage_of_the_pipeline_runs_two_python_functions(spark, monkeypatch):
    plans = []

    def noted(self, path, *args, f=type(spark.range(0).write).parquet, **named):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return f(self, path, *args, **named)

    monkeypatch.setattr(type(spark.range(0).write), "parquet", noted)
    out = pipeline.run(spark, DATA)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("MapInArrow" in p for p in plans) > 5
    assert max(map(most_in_a_stage, plans)) == 1


def test_lists_of_words_are_deleted_once_folded(spark):
    docs = common.load(spark, DATA, "documents")
    folder = common.run_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = bpe.digests(docs, public.path(pipeline.BYTE_VOCABULARY), public.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    left = {name.rpartition("-")[0] for name in set(os.listdir(folder)) - before}
    assert left == {"bpe-ranks", "bpe-blocks", "bpe-packs"}
    texts = docs.select("doc_id", "text").collect()
    want = bpe.digests_of_text([r["text"] for r in texts], public.path(pipeline.BYTE_VOCABULARY), public.PATTERN)
    assert sorted(map(tuple, rows)) == sorted((r["doc_id"], *w) for r, w in zip(texts, want))
