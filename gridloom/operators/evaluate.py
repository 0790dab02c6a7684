"""Quantized linear maps and embedding lookups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.quantize import GROUP_SIZE, quantize, quantize_block

#: Weights of at most so many values are sent to every task; larger ones are cut into tiles and joined.
BROADCAST_VALUES = 4_000_000
#: Inputs of a place, weights of a cell, the fewest vectors and outputs for which a part is made, and results made at once.
TILE_IN, CELL_VALUES, TILE_ROWS, TILE_OUT, RESULTS = 4096, 4_000_000, 64, 64, 1 << 20
PRODUCTS = "x_id long, out_id long, y double"


def linear_forward(x: DataFrame, weights: DataFrame, k: int = GROUP_SIZE, bias: DataFrame | None = None, most: int = BROADCAST_VALUES) -> DataFrame:
    """(x_id, out_id, y): y = x . q(w) + bias for x (x_id, values), weights (out_id, values), bias (out_id, bias).

    The weights' size is counted first. Up to ``most`` values they go to every task, which multiplies
    a batch at once; beyond that both sides are dealt out over a grid of cells, each of which multiplies
    its vectors by its weights (see _by_grid).

    A vector that is null or holds a null has null results; weights may hold neither; vectors and
    weights whose widths differ raise an error; rows that repeat an x_id have results of their own.
    """
    w = weights.select("out_id", "values")
    if bias is not None:
        w = w.join(bias.select("out_id", "bias"), "out_id", "left")
    else:
        w = w.withColumn("bias", F.lit(0.0))
    w = w.select(F.col("out_id").cast("long").alias("out_id"), F.col("values").cast("array<float>").alias("values"), F.coalesce(F.col("bias").cast("double"), F.lit(0.0)).alias("bias"))
    size = w.agg(F.sum(F.size("values")).alias("n"), F.count("*").alias("rows"), F.min(F.size("values")).alias("low"), F.max(F.size("values")).alias("high"), F.count_if(F.col("values").isNull() | F.exists("values", lambda v: v.isNull())).alias("nulls")).first()
    if not size["rows"]:
        return x.sparkSession.createDataFrame([], PRODUCTS)
    width = size["high"]
    if size["low"] != width or size["nulls"]:
        raise ValueError("weights must be without nulls and of one width")
    if width < k or width % k:
        raise ValueError(f"group size {k} does not divide width {width}")
    x = x.select(F.col("x_id").cast("long").alias("x_id"), F.col("values").cast("array<double>").alias("values"))
    if size["n"] <= most:
        return _by_batch(x, w, k)
    return _by_grid(x, w, k, width, size["rows"])


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as a matrix, and which are usable: rows that are null or hold a null are zeros there."""
    lengths = column.value_lengths()
    odd = [n for n in set(lengths.drop_null().to_pylist()) if n != width]
    if odd:
        raise ValueError(f"a vector has width {odd[0]}, the weights have {width}")
    flat = column.flatten()
    out = np.zeros((len(column), width))
    there = lengths.is_valid().to_numpy(zero_copy_only=False)
    out[there] = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, width)
    usable = there.copy()
    if flat.null_count:
        usable[there] = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(1)
    return out, usable


def _results(ids: np.ndarray, outs: np.ndarray, y: np.ndarray, usable: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(outs))), pa.array(np.tile(outs, len(ids))), pa.array(y.ravel(), mask=np.repeat(~usable, len(outs)))], names=["x_id", "out_id", "y"])


def _by_batch(x: DataFrame, w: DataFrame, k: int) -> DataFrame:
    rows = w.orderBy("out_id").toArrow().combine_chunks()
    outs, shift = rows.column("out_id").to_numpy(), rows.column("bias").to_numpy()
    matrix = rows.column("values").combine_chunks()
    matrix = (matrix.chunk(0) if isinstance(matrix, pa.ChunkedArray) else matrix).flatten().to_numpy().reshape(len(outs), -1)
    matrix = quantize_block(matrix, k).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(s, 1024) for s in range(0, batch.num_rows, 1024)):
                values, usable = _matrix(part.column("values"), matrix.shape[1])
                yield _results(part.column("x_id").to_numpy(zero_copy_only=False).astype(np.int64), outs, values @ matrix.T + shift, usable)

    return x.where("x_id is not null").mapInArrow(run, PRODUCTS)


@dataclass(frozen=True)
class Grid:
    """How a product is cut: parts of vectors, parts of outputs, places of inputs and inputs of a place."""

    vectors: int
    outs: int
    places: int
    inputs: int

    @property
    def cells(self) -> int:
        return self.vectors * self.outs * self.places


def grid_of(n_vectors: int, n_out: int, width: int, k: int, tasks: int) -> Grid:
    """The cut of n_vectors by n_out by width.

    Outputs and inputs are cut so that a cell's weights are at most CELL_VALUES (a group of k inputs
    stays whole); vectors are cut until there are enough cells for all tasks, but not under TILE_ROWS a
    cell. Each vector is then shuffled once for each part of outputs, each weight once for each part of
    vectors, so more parts than that would only be more copies.
    """
    inputs = min(width, max(k, TILE_IN // k * k))
    places = -(-width // inputs)
    outs = max(1, -(-n_out // max(TILE_OUT, CELL_VALUES // inputs)))
    vectors = max(1, min(-(-n_vectors // TILE_ROWS), -(-tasks // (outs * places))))
    return Grid(vectors, outs, places, inputs)


def _by_grid(x: DataFrame, w: DataFrame, k: int, width: int, n_out: int) -> DataFrame:
    """The product over a grid of cells (part of vectors, part of outputs, place of inputs).

    A cell is one task: it takes its weights first, at most CELL_VALUES, and then its vectors a batch at a
    time, so a cell may have any number of vectors. With more than one place the partial sums of a result
    are added in the order of places.
    """
    x = x.where("x_id is not null")
    session = x.sparkSession
    grid = grid_of(x.count(), n_out, width, k, max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))
    size = F.size("values")
    wrong = F.raise_error(F.concat(F.lit("a vector has width "), size.cast("string"), F.lit(f", the weights have {width}")))
    x = x.withColumn("values", F.when(F.col("values").isNull() | (size == width), F.col("values")).otherwise(wrong))
    usable = F.col("values").isNotNull() & ~F.exists("values", lambda v: v.isNull())
    # A row that repeats an x_id has results of its own; only where partial sums meet must it be told apart.
    copy = F.row_number().over(Window.partitionBy("x_id").orderBy("values")) if grid.places > 1 else F.lit(0)
    x = x.select(F.col("x_id").alias("id"), copy.cast("int").alias("copy"), F.coalesce(usable, F.lit(False)).alias("usable"), "values")
    part = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cut = F.slice("values", F.col("place") * grid.inputs + 1, grid.inputs)
    cell = ((F.col("vectors") * grid.outs + F.col("outs")) * grid.places + F.col("place")).cast("int").alias("cell")
    left = x.withColumn("vectors", part("id", grid.vectors)).withColumn("outs", every(grid.outs)).withColumn("place", every(grid.places))
    left = left.select(cell, F.lit(True).alias("is_vector"), "id", "copy", "usable", F.lit(0.0).alias("bias"), F.when(F.col("usable"), cut).alias("values"))
    right = w.withColumn("outs", part("out_id", grid.outs)).withColumn("vectors", every(grid.vectors)).withColumn("place", every(grid.places))
    first = F.when(F.col("place") == 0, F.col("bias")).otherwise(0.0)
    # A cell's weights come before its vectors.
    right = right.select(cell, F.lit(False).alias("is_vector"), F.col("out_id").alias("id"), F.lit(0).alias("copy"), F.lit(True).alias("usable"), first.alias("bias"), cut.cast("array<double>").alias("values"))

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outs, bias, weights, matrix = [], [], [], None
        for batch in batches:
            vectors = batch.column("is_vector").to_numpy(zero_copy_only=False)
            n = int(np.argmax(vectors)) if vectors.any() else len(vectors)
            if n:
                some = batch.slice(0, n)
                outs.append(some.column("id").to_numpy())
                bias.append(some.column("bias").to_numpy())
                weights.append(quantize_block(some.column("values").flatten().to_numpy(zero_copy_only=False).reshape(n, -1), k))
            rest = batch.slice(n)
            if rest.num_rows and outs:
                if matrix is None:
                    outs, bias, matrix = np.concatenate(outs), np.concatenate(bias), np.concatenate(weights).astype(np.float64).T
                place = int(rest.column("cell")[0].as_py()) % grid.places
                for s in range(0, rest.num_rows, step := max(1, RESULTS // len(outs))):
                    part = rest.slice(s, step)
                    values, fits = _matrix(part.column("values"), len(matrix))
                    copies = np.repeat(part.column("copy").to_numpy(), len(outs))
                    found = _results(part.column("id").to_numpy(), outs, values @ matrix + bias, fits)
                    yield pa.RecordBatch.from_arrays([*found.columns, pa.array(copies), pa.array(np.full(len(copies), place, np.int32))], names=["x_id", "out_id", "y", "copy", "place"])

    dealt = left.unionByName(right).repartitionById(grid.cells, F.col("cell")).sortWithinPartitions("is_vector", "id")
    found = dealt.mapInArrow(multiplied, PRODUCTS + ", copy int, place int")
    if grid.places == 1:
        return found.select("x_id", "out_id", "y")
    sums = found.groupBy("x_id", "out_id", "copy").agg(F.array_sort(F.collect_list(F.struct("place", "y"))).alias("parts"), F.count("y").alias("n"))
    total = F.aggregate("parts", F.lit(0.0), lambda total, p: total + p["y"])
    return sums.select("x_id", "out_id", F.when(F.col("n") == grid.places, total).alias("y"))


def embedding_lookup(tokens: DataFrame, table: DataFrame, k: int = GROUP_SIZE) -> DataFrame:
    """tokens (..., token_id) with values, the quantized row of table (token_id, values).

    Only rows that are asked for are quantized, each once: quantization is within a row. A null id has
    null values; an id outside the table is an error.
    """
    asked = tokens.select(F.col("token_id").alias("asked_id")).distinct()
    known = table.join(asked, table.token_id == asked.asked_id, "left_semi").select(F.col("token_id").alias("row_id"), quantize(F.col("values"), k).alias("values"))
    found = tokens.join(known, tokens.token_id == known.row_id, "left")
    missing = F.raise_error(F.concat(F.lit("no row for token "), F.col("token_id").cast("string")))
    return found.select(*tokens.columns, F.when(F.col("row_id").isNull() & F.col("token_id").isNotNull(), missing).otherwise(F.col("values")).alias("values"))
