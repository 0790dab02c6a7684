"""Three-level, group-scaled quantization as Column expressions, and an Arrow twin.

A vector is cut into groups of K consecutive values. A group's scale is its largest magnitude, at
least FLOOR; a value's code is the sign of the value where twice its magnitude exceeds the scale and
0 elsewhere, which equals rounding value / scale half to even. The quantized value is code * scale.
NaN or infinity anywhere in a group makes its scale, and so all its values, NaN (an infinite scale
times code 0). A null element stays null and counts as no value of its group. All-zero groups stay
zero. Widths that K does not divide raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default group size and the least scale.
GROUP_SIZE = 128
FLOOR = 1e-8


@dataclass(frozen=True)
class QuantConfig:
    """How modules are quantized."""

    group_size: int = GROUP_SIZE


def group_size_of(config: object | None) -> int:
    """The default where there is no config; a config must have a group size."""
    if config is None:
        return GROUP_SIZE
    return config.group_size


def round_clamp(x: Column) -> Column:
    """Half-to-even rounding into [-1, 1], as a double; NaN stays NaN and null stays null."""
    limited = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.rint(x))) + F.lit(0.0)
    return F.when(F.isnan(x) | x.isNull(), x.cast("double")).otherwise(limited)


def round_clamp_all(values: Column) -> Column:
    return F.transform(values, round_clamp)


def straight_through(gradient: Column) -> Column:
    """The gradient that round_clamp passes on: unchanged."""
    return gradient


def grouped(values: Column, k: int) -> Column:
    """The groups of an array; an error unless k divides its size and is at most that."""
    n = F.size(values)
    fits = (n >= k) & (n % k == 0)
    parts = F.transform(F.sequence(F.lit(0), (n / k).cast("int") - 1), lambda g: F.slice(values, g * k + 1, k))
    return F.when(values.isNull(), F.lit(None)).when(fits, parts).otherwise(F.raise_error(F.concat(F.lit(f"group size {k} does not divide width "), n.cast("string"))))


def scale(group: Column) -> Column:
    """A group's scale, in single precision."""
    return F.greatest(F.array_max(F.transform(group, F.abs)), F.lit(FLOOR).cast("float"))


def code(x: Column, alpha: Column) -> Column:
    """-1, 0 or 1; null for a null."""
    return F.when(x.isNull(), F.lit(None)).when(F.abs(x) * 2 > alpha, F.signum(x)).otherwise(F.lit(0.0)).cast("tinyint")


def value(c: Column, alpha: Column) -> Column:
    return (c * alpha).cast("float")


def quantize(values: Column, k: int = GROUP_SIZE) -> Column:
    """The array with every value on its group's grid, same size."""

    def one(group: Column) -> Column:
        return F.element_at(F.transform(F.array(scale(group)), lambda a: F.transform(group, lambda x: value(code(x, a), a))), 1)

    return F.flatten(F.transform(grouped(values, k), one))


def group_rows(df: DataFrame, values: str, k: int, *ids: str) -> DataFrame:
    """A row for each group: the ids, g, the group's values and alpha."""
    rows = df.select(*ids, F.posexplode(grouped(F.col(values), k)).alias("g", "group"))
    return rows.withColumn("alpha", scale(F.col("group")))


def group_stats(df: DataFrame, values: str, k: int, *ids: str) -> DataFrame:
    """ids, g, alpha and how many codes are -1, 0 and 1."""
    rows = group_rows(df, values, k, *ids)
    codes = F.transform("group", lambda x: code(x, F.col("alpha")))
    rows = rows.select(*ids, F.col("g").cast("long").alias("g"), "alpha", codes.alias("codes"))
    count = lambda c: F.size(F.filter("codes", lambda x: x == c)).cast("long")
    return rows.select(*ids, "g", "alpha", count(-1).alias("n_neg"), count(0).alias("n_zero"), count(1).alias("n_pos"))


def code_rows(df: DataFrame, values: str, k: int, *ids: str) -> DataFrame:
    """ids, pos, code and q, a row for each value."""
    rows = group_rows(df, values, k, *ids).select(*ids, "g", "alpha", F.posexplode("group").alias("at", "x"))
    c = code(F.col("x"), F.col("alpha"))
    return rows.select(*ids, (F.col("g") * k + F.col("at")).cast("long").alias("pos"), c.cast("int").alias("code"), value(c, F.col("alpha")).alias("q"))


def quantize_block(values: np.ndarray, k: int) -> np.ndarray:
    """quantize() of the rows of a matrix, by numpy in single precision."""
    groups = values.astype(np.float32).reshape(len(values), -1, k)
    alpha = np.maximum(np.abs(groups).max(-1, keepdims=True), np.float32(FLOOR))
    with np.errstate(invalid="ignore"):
        codes = np.where(np.abs(groups) * np.float32(2) > alpha, np.sign(groups), np.float32(0))
        return (codes * alpha + np.float32(0)).reshape(values.shape)


def quantize_arrow(df: DataFrame, values: str, k: int = GROUP_SIZE) -> DataFrame:
    """df with the array column quantized, an Arrow batch at a time: the fast path for wide rows.

    A null array stays null, and so does a null element.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(values)
            column = batch.column(at).cast(pa.list_(pa.float32()))
            lengths = column.value_lengths()
            flat = column.flatten()
            out = flat.fill_null(0).to_numpy(zero_copy_only=False).copy()
            for width in set(lengths.drop_null().to_pylist()):
                if width < k or width % k:
                    raise ValueError(f"group size {k} does not divide width {width}")
            if len(out):
                out = quantize_block(out.reshape(-1, k), k).ravel()
            offsets = np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
            quantized = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, type=pa.float32(), mask=flat.is_null().to_numpy(zero_copy_only=False)), mask=column.is_null())
            yield batch.set_column(at, pa.field(values, quantized.type), quantized)

    schema = df.withColumn(values, F.col(values).cast("array<float>")).schema
    return df.mapInArrow(run, schema)
