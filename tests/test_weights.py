"""Weight files: round trips, the public layout, partitions by byte range, failed jobs."""

import json
import os
import struct

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from gridloom.operators import adapters, rewrite
from gridloom.sources import weights

SCHEMA = "param_id string, row_idx long, values array<float>"


def container(path, tensors, head=None):
    """A container by the layout's definition; tensors are (name, dtype, shape, bytes)."""
    about, at = dict(head or {}), 0
    for name, dtype, shape, data in tensors:
        about[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(data)]}
        at += len(data)
    text = json.dumps(about).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text + b"".join(t[3] for t in tensors))


def told(df):
    return sorted((r[0], r[1], tuple(r[2])) for r in df.collect())


def test_round_trip_of_many_parts(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(p, i, rng.standard_normal(w).astype(np.float32).tolist()) for p, n, w in (("wide", 50, 33), ("tall", 900, 4), ("one", 1, 1), ("b@3", 5, 2)) for i in range(n)]
    rows += [("gap", i, [1.0, 2.0]) for i in (3, 4, 9, 0)] + [("ragged", 0, [1.0]), ("ragged", 1, [1.0, 2.0]), ("", 0, [5.0])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    path = str(tmp_path / "w")
    weights.write_weights(df, path, part_bytes=600)
    back = weights.read_weights(spark, path, partition_bytes=200)
    assert told(back) == told(df)
    assert back.rdd.getNumPartitions() > 30
    assert told(weights.read_weights(spark, path, only=["gap", "one"])) == told(df.where("param_id in ('gap', 'one')"))
    # Every part is a container of its own, of bounded size, and the index names them all.
    index = json.load(open(f"{path}/{weights.INDEX}"))["blocks"]
    parts = {n for n in os.listdir(path) if n.startswith("part-")}
    assert {b["file"] for b in index} == parts and len(parts) > 8
    for n in parts:
        tensors, begin = weights.header(pafs.LocalFileSystem(), f"{path}/{n}")
        assert os.path.getsize(f"{path}/{n}") - begin == max(t["data_offsets"][1] for t in tensors.values()) <= 600
    with pytest.raises(ValueError, match="exists"):
        weights.write_weights(df, path)


def test_types_and_shapes_of_the_public_layout(spark, tmp_path):
    x = np.array([[1.5, -2.0, 0.25], [3.0, 1e-3, -7.0]], np.float32)
    upper = (x.view(np.uint32) >> 16).astype("<u2").tobytes()
    file = str(tmp_path / "model.safetensors")
    tensors = [("f32", "F32", [2, 3], x.astype("<f4").tobytes()), ("f64", "F64", [2, 3], x.astype("<f8").tobytes()), ("f16", "F16", [2, 3], x.astype("<f2").tobytes()), ("bf16", "BF16", [2, 3], upper),
               ("cube", "F32", [2, 1, 3], x.astype("<f4").tobytes()), ("bias", "F32", [3], x[0].astype("<f4").tobytes()), ("scalar", "F32", [], b"\0\0\x80?"), ("none", "F32", [0, 3], b"")]
    container(file, tensors, {"__metadata__": {"format": "pt"}})
    got = {(r[0], r[1]): r[2] for r in weights.read_weights(spark, file, partition_bytes=12).collect()}
    for name in ("f32", "f64", "cube"):
        assert [got[name, i] for i in (0, 1)] == x.tolist()
    assert [got["f16", i] for i in (0, 1)] == x.astype(np.float16).astype(np.float32).tolist()
    assert got["bf16", 0] == x[0].tolist() and got["bf16", 1] == ((x[1].view(np.uint32) >> 16) << 16).view(np.float32).tolist()
    assert got["bias", 0] == x[0].tolist() and got["scalar", 0] == [1.0] and not any(k[0] == "none" for k in got)
    # A folder of containers, and one with a shard index that leaves a tensor out.
    assert weights.read_weights(spark, str(tmp_path)).count() == len(got)
    with open(tmp_path / "model.safetensors.index.json", "w") as f:
        json.dump({"weight_map": {"f32": "model.safetensors", "bias": "model.safetensors"}}, f)
    assert told(weights.read_weights(spark, str(tmp_path)))[0][0] == "bias" and weights.read_weights(spark, str(tmp_path)).count() == 3


def test_bad_containers(spark, tmp_path):
    container(tmp_path / "int.safetensors", [("a", "I64", [1], b"\0" * 8)])
    container(tmp_path / "short.safetensors", [("a", "F32", [3], b"\0" * 8)])
    (tmp_path / "no.safetensors").write_bytes(b"\xff" * 64)
    for name, message in (("int", "has type I64"), ("short", "its shape has 12"), ("no", "no tensor container")):
        with pytest.raises(Exception, match=message):
            weights.read_weights(spark, str(tmp_path / f"{name}.safetensors")).collect()


def test_failed_job_leaves_nothing_readable(spark, tmp_path):
    path = str(tmp_path / "failed")
    rows = spark.range(0, 400, 1, 4).select(F.lit("p").alias("param_id"), F.col("id").alias("row_idx"), F.array(F.when(F.col("id") != 399, F.lit(1.0))).cast("array<float>").alias("values"))
    with pytest.raises(Exception, match="no null"):
        weights.write_weights(rows, path, part_bytes=64)
    assert not os.path.exists(f"{path}/{weights.INDEX}")
    if os.path.isdir(path) and any(n.startswith("part-") for n in os.listdir(path)):
        with pytest.raises(Exception, match="no index"):
            weights.read_weights(spark, path).collect()


def test_files_outside_the_index_are_not_read(spark, tmp_path):
    path = str(tmp_path / "w")
    df = spark.createDataFrame([("p", 0, [1.0])], SCHEMA)
    weights.write_weights(df, path)
    container(f"{path}/part-stray.safetensors", [("p", "F32", [1, 1], b"\0" * 4)])
    assert told(weights.read_weights(spark, path)) == [("p", 0, (1.0,))]


def test_empty_table_and_repeated_rows(spark, tmp_path):
    weights.write_weights(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert weights.read_weights(spark, str(tmp_path / "none")).count() == 0
    twice = spark.createDataFrame([("p", 1, [1.0]), ("p", 1, [2.0])], SCHEMA)
    with pytest.raises(Exception, match="comes twice"):
        weights.write_weights(twice, str(tmp_path / "twice"))


def test_small_tensors_share_partitions_and_the_index_has_a_row_for_each_file(spark, tmp_path):
    """Each tensor was a partition, and a row of the index, so tasks and the driver's memory grew with the tensors."""
    path = str(tmp_path / "w")
    df = spark.range(600).select(F.format_string("p%d", F.col("id") % 300).alias("param_id"), F.floor(F.col("id") / 300).alias("row_idx"), F.array(F.col("id"), F.lit(1)).cast("array<float>").alias("values"))
    weights.write_weights(df, path)
    index, parts = json.load(open(f"{path}/{weights.INDEX}"))["blocks"], [n for n in os.listdir(path) if n.startswith("part-")]
    back = weights.read_weights(spark, path)
    assert len(index) == len(parts) == back.rdd.getNumPartitions() <= 4
    assert told(back) == told(df)
    # Files whose parameters lie outside are not opened.
    assert weights.read_weights(spark, path, only=["p7"]).rdd.getNumPartitions() == 1 and told(weights.read_weights(spark, path, only=["p7"])) == told(df.where("param_id = 'p7'"))


def test_shapes_of_modules_are_read_once(spark, capsys):
    modules = spark.createDataFrame([("m.q_proj", "linear", "p", "p"), ("m.none", "model", None, None)], "path string, kind string, param_id string, owner_param_id string")
    rows = rewrite.with_shapes(modules, spark.range(3).select(F.lit("p").alias("param_id"), F.col("id").alias("row_idx"), F.array(F.lit(1.0)).alias("values")))
    rows.explain()
    assert "Range" not in capsys.readouterr().out
    assert {tuple(r) for r in rows.select("path", "n_in", "n_out", "numel").collect()} == {("m.q_proj", 1, 3, 3), ("m.none", None, None, 0)}


def test_fresh_adapters_are_made_in_many_tasks(spark):
    """Modules of few bytes came from one task, which made all values of A."""
    modules = spark.range(200).select(F.format_string("m%d.q_proj", "id").alias("path"), F.lit(64).alias("n_in"), F.lit(1).alias("n_out")).coalesce(1)
    rows = adapters.init_adapters(modules, 4, 8.0).where("side = 'A'")
    assert rows.count() == 800 and rows.select(F.spark_partition_id()).distinct().count() == 4
