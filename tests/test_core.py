"""The quantizer, the operators on modules and adapters, and chat preparation."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import quantize as q
from gridloom.operators import adapters, evaluate, rewrite
from gridloom.plans import queries
from gridloom.sources import chat
from gridloom.streaming import quantize as stream

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def by_hand(values, k):
    """The definition, with division and half-even rounding, in single precision."""
    out = []
    for g in range(0, len(values), k):
        group = np.array(values[g : g + k], np.float32)
        a = np.maximum(np.abs(group).max(), np.float32(1e-8))
        with np.errstate(invalid="ignore"):
            out += (np.clip(np.rint(group / a), -1, 1) * a + np.float32(0)).tolist()
    return out


def same(a, b):
    return len(a) == len(b) and all((math.isnan(x) and math.isnan(y)) or x == y for x, y in zip(a, b))


HALF = float(np.float32(0.5))
EDGES = [
    [0.0, 0.0, 0.0, 0.0],
    [1.0, 0.5, -0.5, 0.25],
    [1.0, float(np.nextafter(np.float32(0.5), np.float32(1))), float(-np.nextafter(np.float32(0.5), np.float32(1))), float(np.nextafter(np.float32(0.5), np.float32(0)))],
    [4e-9, -4.9e-9, 5.1e-9, -6e-9],
    [1e-9, -2e-9, 3e-9, 0.0],
    [float("nan"), 1.0, -1.0, 0.0],
    [float("inf"), 1.0, -1.0, 0.0],
    [-0.1, -0.2, -0.3, -1.0],
]


def test_edges(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(EDGES)], "id int, v array<float>")
    got = {r["id"]: r["v"] for r in df.select("id", q.quantize(F.col("v"), 4).alias("v")).collect()}
    fast = {r["id"]: r["v"] for r in q.quantize_arrow(df, "v", 4).collect()}
    for i, v in enumerate(EDGES):
        want = by_hand(v, 4) if all(map(math.isfinite, v)) else [float("nan")] * 4
        assert same(got[i], want), (v, got[i], want)
        assert same(fast[i], want)
        assert all(math.copysign(1, x) > 0 for x in got[i] if x == 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, width=32), min_size=8, max_size=8))
def test_properties(values):
    x = np.array([values], np.float32)
    once = q.quantize_block(x, 4)
    assert same(once[0].tolist(), by_hand(values, 4))
    assert np.array_equal(q.quantize_block(once, 4), once)
    assert np.array_equal(q.quantize_block(-x, 4), -once + 0)
    for g in (slice(0, 4), slice(4, 8)):
        top = np.abs(x[0, g]).max()
        if top > 1e-8:
            assert np.abs(once[0, g]).max() == top


def test_expressions_equal_arrow_twin(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(256) * 10.0 ** rng.integers(-12, 6)).astype(np.float32).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    a = {r[0]: r[1] for r in df.select("id", q.quantize(F.col("v"))).collect()}
    b = {r[0]: r[1] for r in q.quantize_arrow(df, "v").collect()}
    assert a == b


@pytest.mark.parametrize("width,k", [(6, 4), (3, 4), (0, 4)])
def test_width_must_divide(spark, width, k):
    df = spark.createDataFrame([([1.0] * width,)], "v array<float>")
    with pytest.raises(Exception, match="does not divide"):
        df.select(q.quantize(F.col("v"), k)).collect()


def test_null_vector_stays_null(spark):
    df = spark.createDataFrame([(None,), ([1.0, 0.1],)], "v array<float>")
    for out in (df.select(q.quantize(F.col("v"), 2).alias("v")), q.quantize_arrow(df, "v", 2)):
        assert sorted((r["v"] for r in out.collect()), key=str) == sorted([None, [1.0, 0.0]], key=str)


def test_round_clamp(spark):
    df = spark.createDataFrame([([0.5, 1.5, -0.5, -2.5, 0.51, 0.0, -0.51],)], "v array<double>")
    assert df.select(q.round_clamp_all(F.col("v"))).first()[0] == [0, 1, 0, -1, 1, 0, -1]
    assert df.select(q.straight_through(F.col("v"))).first()[0] == [0.5, 1.5, -0.5, -2.5, 0.51, 0.0, -0.51]


def test_round_clamp_keeps_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-5.0,), (-0.2,), (None,)], "x double")
    got = [r[0] for r in df.select(q.round_clamp(F.col("x"))).collect()]
    assert math.isnan(got[0]) and got[1:] == [1.0, -1.0, 0.0, None] and math.copysign(1, got[3]) > 0


def test_null_elements(spark):
    df = spark.createDataFrame([(1, [1.0, None, -2.0, 0.5]), (2, [None, None, 1.0, 1.0])], "id int, v array<float>")
    want = {1: [1.0, None, -2.0, 0.0], 2: [None, None, 1.0, 1.0]}
    assert {r[0]: r[1] for r in df.select("id", q.quantize(F.col("v"), 2)).collect()} == want
    assert {r["id"]: r["v"] for r in q.quantize_arrow(df, "v", 2).collect()} == want


def test_config():
    assert (q.group_size_of(None), q.group_size_of(q.QuantConfig(64))) == (128, 64)
    with pytest.raises(AttributeError):
        q.group_size_of(object())


def test_linear_both_ways(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "TILE_IN", 4)
    x = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [0.0, 0.0, 0.0, 1.0])], "x_id long, values array<float>")
    w = spark.createDataFrame([(0, [1.0, 0.4, -1.0, 0.6]), (1, [0.0, 0.0, 0.0, 2.0])], "out_id long, values array<float>")
    bias = spark.createDataFrame([(1, 0.5)], "out_id long, bias double")
    want = {(1, 0): 1.0 - 3.0 + 4.0, (1, 1): 8.5, (2, 0): 1.0, (2, 1): 2.5}
    for most in (1000, 0):
        assert {(r[0], r[1]): r[2] for r in evaluate.linear_forward(x, w, 4, bias, most).collect()} == want
    assert evaluate.linear_forward(x, w.limit(0), 4).count() == 0
    for most in (1000, 0):
        assert evaluate.linear_forward(x.limit(0), w, 4, bias, most).count() == 0
        odd = spark.createDataFrame([(1, None), (2, [1.0, None, 0.0, 0.0]), (3, [1.0, 1.0, 1.0, 1.0]), (3, [0.0, 0.0, 0.0, 1.0])], "x_id long, values array<float>")
        got = sorted(((r[0], r[1], r[2]) for r in evaluate.linear_forward(odd, w, 4, None, most).collect()), key=repr)
        assert got == sorted([(1, 0, None), (1, 1, None), (2, 0, None), (2, 1, None), (3, 0, 1.0), (3, 1, 2.0), (3, 0, 1.0), (3, 1, 2.0)], key=repr)
        ragged = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0] * 6)], "x_id long, values array<float>")
        with pytest.raises(Exception, match="width"):
            evaluate.linear_forward(ragged, w, 4, None, most).collect()
    with pytest.raises(ValueError, match="one width"):
        evaluate.linear_forward(x, spark.createDataFrame([(0, [1.0] * 4), (1, [1.0] * 8)], "out_id long, values array<float>"), 4)


def test_tiles_sum_over_inputs(spark, monkeypatch):
    for name, size in (("TILE_IN", 6), ("TILE_OUT", 3), ("TILE_ROWS", 5)):
        monkeypatch.setattr(evaluate, name, size)
    rng = np.random.default_rng(5)
    x, w = rng.standard_normal((17, 16)).astype(np.float32), rng.standard_normal((10, 16)).astype(np.float32)
    dx = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "x_id long, values array<float>")
    dw = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "out_id long, values array<float>")
    want = x.astype(float) @ q.quantize_block(w, 4).astype(float).T
    got = {(r[0], r[1]): r[2] for r in evaluate.linear_forward(dx, dw, 4, None, 0).collect()}
    assert len(got) == 170 and all(abs(got[i, j] - want[i, j]) < 1e-9 for i, j in got)


def test_grid_splits_one_place(spark, monkeypatch):
    """Weights of one place over the broadcast limit are more than four tasks, and vectors meet each part of outputs once."""
    for name, size in (("CELL_VALUES", 64), ("TILE_OUT", 1), ("TILE_ROWS", 5), ("RESULTS", 7)):
        monkeypatch.setattr(evaluate, name, size)
    rng = np.random.default_rng(6)
    x, w = rng.standard_normal((30, 8)).astype(np.float32), rng.standard_normal((21, 8)).astype(np.float32)
    dx = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "x_id long, values array<float>")
    dw = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "out_id long, values array<float>")
    y = evaluate.linear_forward(dx, dw, 4, None, 0)
    plan = y._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    want = x.astype(float) @ q.quantize_block(w, 4).astype(float).T
    got = {(r[0], r[1]): r[2] for r in y.collect()}
    assert len(got) == 630 and all(abs(got[i, j] - want[i, j]) < 1e-9 for i, j in got)
    assert evaluate.grid_of(30, 21, 8, 4, 8) == evaluate.Grid(3, 3, 1, 8)
    assert y.groupBy(F.spark_partition_id()).count().count() >= 4


def test_grid_sizes():
    for n_vectors, n_out, width, k, tasks in [(10**9, 4096, 4096, 128, 2000), (10**9, 50_000, 4096, 128, 5000), (5, 10**6, 64, 64, 100), (10**6, 100, 10**6, 64, 1000), (1, 1, 128, 128, 8)]:
        g = evaluate.grid_of(n_vectors, n_out, width, k, tasks)
        assert g.inputs % k == 0 and g.places * g.inputs >= width > (g.places - 1) * g.inputs
        assert -(-n_out // g.outs) * g.inputs <= max(evaluate.CELL_VALUES, evaluate.TILE_OUT * g.inputs)
        assert g.cells >= min(tasks, -(-n_vectors // evaluate.TILE_ROWS))
        assert g.vectors == 1 or (g.vectors - 1) * g.outs * g.places < tasks


def test_lookup(spark):
    table = spark.createDataFrame([(0, [1.0, 0.2]), (1, [-3.0, 2.0])], "token_id long, values array<float>")
    tokens = spark.createDataFrame([(7, 0, 1), (7, 1, 0), (7, 2, 1)], "seq_id long, pos int, token_id long")
    got = sorted(tuple(r) for r in evaluate.embedding_lookup(tokens, table, 2).collect())
    assert got == [(7, 0, 1, [-3.0, 3.0]), (7, 1, 0, [1.0, 0.0]), (7, 2, 1, [-3.0, 3.0])]
    with pytest.raises(Exception, match="no row for token"):
        evaluate.embedding_lookup(tokens.withColumn("token_id", F.lit(9).cast("long")), table, 2).collect()


def test_swap_rules(spark):
    once = rewrite.swap(queries.registry(spark), q.QuantConfig(64))
    got = {r["path"]: (r["kind"], r["group_size"], r["owner_param_id"]) for r in once.collect()}
    assert got["model.embed_tokens"] == ("quant_embedding", 64, "p_embed")
    assert got["model.position"] == ("embedding", None, "p_pos")
    assert got["model.layers.0.norm_gate.proj"][0] == "linear"
    assert got["model.layers.0.Norm_out"][0] == "quant_linear"
    assert got["model.layers.0.mlp.up_proj"] == ("quant_linear", 32, "p_up0")
    assert got["lm_head"] == ("quant_linear", 64, "p_embed")
    again = rewrite.swap(once.drop("old_kind"), q.QuantConfig(16))
    assert {r["path"]: r["group_size"] for r in again.collect()} == {k: v[1] for k, v in got.items()}
    known = spark.createDataFrame([("p_q0", i, [0.0] * 64) for i in range(7)], queries.schemas.PARAMETERS)
    told = {r["path"]: r["description"] for r in rewrite.describe(once, known).collect()}
    assert set(told) == {k for k, v in got.items() if v[0] == "quant_linear"} and told["model.layers.0.q_proj"] == "64 to 7, quantized"
    parents = {r[0]: r[1] for r in once.select("path", rewrite.parent_path(F.col("path"))).collect()}
    assert parents["model.layers.0.q_proj"] == "model.layers.0" and parents["lm_head"] == "" and parents[""] is None


def test_walk_of_edges(spark):
    edges = [("root", "a", "x"), ("a", "b", "y"), ("b", "c", "z"), ("a", "c", "w"), ("other", "d", "alone"), ("a", "b", "y")] + [(f"n{i}" if i else "c", f"n{i + 1}", str(i)) for i in range(300)]
    df = spark.createDataFrame(edges, "parent string, node string, name string")
    got = sorted(tuple(r) for r in rewrite.walk(df).collect())
    tail = lambda k: "".join(f".{i}" for i in range(k))
    want = [("a", "x"), ("b", "x.y"), ("c", "x.y.z"), ("c", "x.w"), ("d", "alone")] + [(f"n{k}", top + tail(k)) for k in range(1, 301) for top in ("x.y.z", "x.w")]
    assert got == sorted(want)
    assert rewrite.walk(df.limit(0)).count() == 0
    for bad, message in (([("a", "b", "x"), ("b", "a", "y")], "cycle"), ([("root", "a", "x"), ("a", "b", "y"), ("c", "b", "z"), ("b", "c", "w")], "cycle"), ([("a", "b", None)], "lacks"), ([("a", "a", "x")], "cycle")):
        with pytest.raises(Exception, match=message):
            rewrite.walk(spark.createDataFrame(bad, "parent string, node string, name string")).count()


def test_shapes_count_a_shared_parameter_once(spark):
    parameters = spark.createDataFrame([("e", 0, [1.0, 2.0]), ("e", 1, [3.0, 4.0]), ("b", 0, [1.0])], "param_id string, row_idx long, values array<float>")
    modules = spark.createDataFrame([("emb", "e", "e", True), ("head", "h", "e", False), ("bias", "b", None, False), ("none", "gone", None, True), ("", None, None, False)], "path string, param_id string, owner_param_id string, requires_grad boolean")
    rows = rewrite.with_shapes(modules, parameters)
    assert {r["path"]: (r["n_in"], r["n_out"], r["numel"]) for r in rows.collect()} == {"emb": (2, 2, 4), "head": (2, 2, 4), "bias": (1, 1, 1), "none": (None, None, 0), "": (None, None, 0)}
    assert tuple(rewrite.parameter_counts(rows).first()) == (5, 4)


def test_untied_head_and_default_size(spark):
    rows = [(p, "linear" if p == "lm_head" else "embedding", n, n, None, False, None, True, 8) for p, n in (("embed_tokens", "a"), ("lm_head", "b"))]
    got = {r["path"]: (r["owner_param_id"], r["group_size"]) for r in rewrite.swap(spark.createDataFrame(rows, queries.schemas.MODULES)).collect()}
    assert got == {"embed_tokens": ("a", 128), "lm_head": ("b", 128)}


def test_two_tables_of_one_head(spark):
    rows = [(p, "linear" if p == "lm_head" else "embedding", n, "a", None, False, None, True, 8) for p, n in (("embed_tokens", "a"), ("model.embed_tokens", "a"), ("lm_head", "a"))]
    assert rewrite.swap(spark.createDataFrame(rows, queries.schemas.MODULES)).count() == 3


def test_empty_tables(spark):
    base = spark.createDataFrame([], "module_path string, row_idx long, values array<float>")
    lora, modules = spark.createDataFrame([], queries.schemas.ADAPTERS), spark.createDataFrame([], queries.schemas.MODULES)
    assert adapters.merge(base, lora, 4.0, 2).count() == adapters.quantize_adapters(lora, 2).count() == rewrite.swap(modules).count() == 0
    assert adapters.touched_count(lora, 2).first()["n"] == 0 and adapters.save_pipeline(base, lora, modules, 4.0, 2, 4).count() == 0
    tokens, table = spark.createDataFrame([], "token_id long"), spark.createDataFrame([], "token_id long, values array<float>")
    assert evaluate.embedding_lookup(tokens, table, 2).count() == 0
    assert chat.prepare(spark.createDataFrame([], queries.schemas.CHAT)).count() == 0


def test_merge_of_two_adapters_and_missing_rows(spark, tmp_path):
    base = spark.createDataFrame([("m", 0, [1.0, 2.0]), ("m", 1, [3.0, 4.0])], "module_path string, row_idx long, values array<float>")
    rows = [("m", "x", "A", 0, [1.0, 1.0]), ("m", "y", "A", 0, [0.0, 2.0]), ("m", "x", "B", 0, [1.0]), ("m", "y", "B", 0, [3.0]), ("m", "y", "B", 1, [1.0])]
    lora = spark.createDataFrame(rows, queries.schemas.ADAPTERS)
    merged = {r[1]: r[2] for r in adapters.merge(base, lora, 1.0, 1).collect()}
    assert merged == {0: [2.0, 9.0], 1: [3.0, 6.0]}
    modules = spark.createDataFrame([("m", "quant_linear", None)], "path string, kind string, group_size int")
    with pytest.raises(Exception, match="does not divide"):
        adapters.requantize(base, modules).collect()
    out = adapters.save_pipeline(base, lora, modules.where("false"), 1.0, 1, 2, str(tmp_path / "out"))
    assert {r[1]: r[2] for r in out.collect()} == {0: [2.0, 9.0], 1: [3.0, 6.0]} and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_merge_and_requantize(spark):
    base = spark.createDataFrame([("m", 0, [1.0, 2.0]), ("m", 1, [0.0, 0.0]), ("other", 0, [5.0, 1.0])], "module_path string, row_idx long, values array<float>")
    rows = [("m", "x", "A", 0, [1.0, 0.1]), ("m", "x", "A", 1, [0.0, 2.0]), ("m", "x", "B", 0, [1.0, 2.0]), ("m", "x", "B", 1, [0.0, 1.0])]
    lora = spark.createDataFrame(rows, queries.schemas.ADAPTERS)
    merged = {(r[0], r[1]): r[2] for r in adapters.merge(base, lora, 4.0, 2).collect()}
    assert merged[("m", 0)] == pytest.approx([3.0, 10.2]) and merged[("m", 1)] == pytest.approx([0.0, 4.0]) and merged[("other", 0)] == [5.0, 1.0]
    assert adapters.touched_count(lora, 2).first()["n"] == 2
    assert adapters.touched_count(lora, 4).first()["n"] == 0
    modules = spark.createDataFrame([("m", "quant_linear", 2)], "path string, kind string, group_size int")
    out = {(r[0], r[1]): r[2] for r in adapters.save_pipeline(base, lora, modules, 4.0, 2, 4).collect()}
    assert out[("m", 0)] == pytest.approx([0.0, 10.2]) and out[("other", 0)] == [5.0, 1.0]


def test_merge_by_each_adapters_scale(spark, monkeypatch):
    """Modules of several tiles, adapters of ranks 2 and 4 with their own alpha, against numpy."""
    monkeypatch.setattr(adapters, "TILE_ROWS", 7)
    rng = np.random.default_rng(5)
    base, lora, want = [], [], {}
    for module, n_out, n_in in (("m", 40, 6), ("n", 9, 3)):
        w = rng.normal(size=(n_out, n_in)).astype(np.float32)
        total = w.astype(np.float64)
        for name, r, alpha in (("x", 2, 8.0), ("y", 4, 1.0)):
            a, b = rng.normal(size=(r, n_in)).astype(np.float32), rng.normal(size=(n_out, r)).astype(np.float32)
            total = total + alpha / r * b.astype(np.float64) @ a.astype(np.float64)
            lora += [(module, name, "A", i, v.tolist(), r, alpha) for i, v in enumerate(a)] + [(module, name, "B", i, v.tolist(), r, alpha) for i, v in enumerate(b)]
        base += [(module, i, v.tolist()) for i, v in enumerate(w)]
        want |= {(module, i): v for i, v in enumerate(total)}
    base += [("m", 41, None), ("m", 3, base[3][2]), (None, 0, [1.0]), ("o", 0, [None, 2.0])]
    rows = spark.createDataFrame(base, "module_path string, row_idx long, values array<float>")
    scaled = spark.createDataFrame(lora, queries.schemas.SCALED_ADAPTERS)
    merged = adapters.merge(rows, scaled)
    got = [tuple(r) for r in merged.collect()]
    assert len(got) == len(base) and ("m", 41, None) in got and (None, 0, [1.0]) in got and ("o", 0, [None, 2.0]) in got
    for module, i, values in got:
        if (module, i) in want:
            assert values == pytest.approx(want[module, i], rel=1e-5, abs=1e-5)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "transform(" not in plan
    with pytest.raises(ValueError):
        adapters.merge(rows, scaled.drop("alpha"))
    with pytest.raises(Exception, match="no rank"):
        adapters.merge(rows, scaled.withColumn("r", F.lit(0))).collect()
    with pytest.raises(Exception, match="without nulls and of one width"):
        adapters.merge(rows, scaled.withColumn("values", F.when(F.col("side") == "A", F.slice("values", 1, 2)).otherwise(F.col("values")))).collect()


def test_chat_examples(spark):
    rows = [(1, [("human", "a b"), ("gpt", "c")]), (2, [("system", "s"), ("gpt", "x"), ("human", "y z")])]
    df = spark.createDataFrame(rows, queries.schemas.CHAT)
    for r in chat.prepare(df).collect():
        assert len(r["attention_mask"]) == len(r["input_ids"]) and set(r["attention_mask"]) == {1}
        p = r["labels"].count(-100)
        assert r["labels"][p:] == r["input_ids"][p:]
    short = chat.prepare(df, longest=3).collect()
    assert all(len(r["input_ids"]) == 3 and r["labels"] == [-100] * 3 for r in short)
    with pytest.raises(Exception, match="unknown role"):
        chat.prepare(spark.createDataFrame([(1, [("bot", "a")])], queries.schemas.CHAT)).collect()


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = spark.createDataFrame([(i, [float(i), 1.0, -2.0, 0.5]) for i in range(20)], "id int, v array<float>")
    df.repartition(3).write.parquet(folder)
    out = stream.quantized_stream(spark, folder, "id int, v array<float>", "v", 4)
    stream.run_to_parquet(out, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["id"]: r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["id"]: r["v"] for r in df.select("id", q.quantize(F.col("v"), 4).alias("v")).collect()}


def rows_of(frame):
    show = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) + 0.0 if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(show(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no fixture tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
