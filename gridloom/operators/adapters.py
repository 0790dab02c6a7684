"""Low-rank adapters: attach, quantize, merge and snap back to the grid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.quantize import GROUP_SIZE, quantize
from gridloom.operators.rewrite import PROJECTIONS, QUANT_EMBEDDING, QUANT_LINEAR, child_name

#: Base rows of a tile, and values of one whose rows are wide.
TILE_ROWS, TILE_VALUES = 512, 4_000_000
BASE, SIDE_A, SIDE_B = 0, 1, 2


def attach(modules: DataFrame, targets: Sequence[str] = PROJECTIONS) -> DataFrame:
    """The modules that adapters attach to: those whose last path part is a target."""
    return modules.where(child_name(F.col("path")).isin(*targets))


def quantize_adapters(adapters: DataFrame, k: int = GROUP_SIZE) -> DataFrame:
    """adapters with values quantized where k divides their width, and touched saying so."""
    width = F.size("values")
    fits = (width >= k) & (width % k == 0)
    return adapters.withColumns({"values": F.when(fits, quantize(F.col("values"), k)).otherwise(F.col("values")), "touched": fits})


def touched_count(adapters: DataFrame, k: int = GROUP_SIZE) -> DataFrame:
    """n: adapter matrices that quantize_adapters changes."""
    width = F.size("values")
    sides = adapters.where((width >= k) & (width % k == 0)).select("module_path", "adapter_name", "side").distinct()
    return sides.agg(F.count("*").alias("n"))


def init_adapters(modules: DataFrame, r: int, alpha: float, targets: Sequence[str] = PROJECTIONS, name: str = "default") -> DataFrame:
    """Adapter rows (module_path, adapter_name, side, row_idx, values, r, alpha) of modules (path, n_in, n_out) that are targets.

    A has r rows of n_in values, uniform in +-1/sqrt(n_in) and made from module, row and place by MD5;
    B has n_out rows of r zeros, so that a fresh adapter changes nothing.
    """
    at = attach(modules, targets).select("path", "n_in", "n_out")
    # Modules are few bytes, which Spark gathers in few tasks; the values made of them are many.
    tasks = int(modules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = at.select("path", "n_in", F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("row_idx")).repartition(tasks, "path", "row_idx")
    uniform = lambda p: F.conv(F.substring(F.md5(F.concat_ws("|", "path", "row_idx", p).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    values = F.transform(F.sequence(F.lit(0), F.col("n_in") - 1), lambda p: ((uniform(p) * 2 - 1) / F.sqrt("n_in")).cast("float"))
    a = a.select("path", F.lit("A").alias("side"), "row_idx", values.alias("values"))
    b = at.select("path", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("row_idx")).select("path", F.lit("B").alias("side"), "row_idx", F.array_repeat(F.lit(0.0).cast("float"), r).alias("values"))
    return a.unionByName(b).select(
        F.col("path").alias("module_path"), F.lit(name).alias("adapter_name"), "side", F.col("row_idx").cast("long").alias("row_idx"), "values", F.lit(r).alias("r"), F.lit(float(alpha)).alias("alpha")
    )


def with_scale(adapters: DataFrame, alpha: float | None = None, rank: int | None = None) -> DataFrame:
    """(module_path, adapter_name, side, row_idx, values, scale): scale is alpha / r of the adapter's own columns.

    A given alpha or rank stands for all adapters, as it must where the column is absent. A row without
    either, or with a rank under 1, is an error.
    """
    own = {c.lower() for c in adapters.columns}
    if (alpha is None and "alpha" not in own) or (rank is None and "r" not in own):
        raise ValueError("adapters without columns r and alpha need a rank and an alpha")
    top = (F.col("alpha") if alpha is None else F.lit(alpha)).cast("double")
    r = (F.col("r") if rank is None else F.lit(rank)).cast("int")
    scale = F.when(top.isNotNull() & (r >= 1), top / r).otherwise(F.raise_error(F.lit("an adapter has no alpha or no rank")))
    return adapters.select("module_path", "adapter_name", "side", F.col("row_idx").cast("long").alias("row_idx"), F.col("values").cast("array<float>").alias("values"), scale.alias("scale"))


def merge(base: DataFrame, adapters: DataFrame, alpha: float | None = None, rank: int | None = None) -> DataFrame:
    """(module_path, row_idx, values): base + alpha / r * B A, summed over the adapters of a module, each with its own r and alpha.

    Base rows and rows of B are dealt out by (module, tile of TILE_ROWS rows, fewer of wide rows), so one
    large module is many tasks; a module's A, of as many rows as its ranks, goes to each of its tiles,
    which adds at most ranks / TILE_ROWS to what is shuffled. A tile is one matrix product in double
    precision, its ranks in the order of (adapter, rank).

    Base rows without rows of B, and ranks that one side lacks, add nothing. Base rows that repeat a
    row_idx are merged alike; a null base row stays null, as does a null element; an adapter's rows may
    hold no nulls, and rows of A must be as wide as the base's.
    """
    return _merged(base, with_scale(adapters, alpha, rank))


def _tile(width: Column) -> Column:
    """The number of a row's tile among rows of that width."""
    rows = F.least(F.lit(TILE_ROWS), F.greatest(F.lit(1), F.floor(F.lit(TILE_VALUES) / F.greatest(width, F.lit(1)))))
    return F.floor(F.col("row_idx") / rows).cast("long")


def _merged(base: DataFrame, scaled: DataFrame) -> DataFrame:
    a, b = scaled.where("side = 'A'"), scaled.where("side = 'B'")
    # A row of A is as wide as the base's rows, so it tells the tiles of the rows of B.
    widths = a.groupBy("module_path").agg(F.max(F.size("values")).alias("width"))
    b = b.join(widths, "module_path").withColumn("tile", _tile(F.col("width"))).withColumn("kind", F.lit(SIDE_B))
    a = a.join(b.select("module_path", "tile").distinct(), "module_path").withColumn("kind", F.lit(SIDE_A))
    rows = base.select("module_path", F.col("row_idx").cast("long").alias("row_idx"), F.col("values").cast("array<float>").alias("values"))
    rows = rows.withColumns({"tile": _tile(F.size("values")), "kind": F.lit(BASE), "adapter_name": F.lit(None).cast("string"), "scale": F.lit(0.0)})
    names = ["module_path", "tile", "kind", "adapter_name", "row_idx", "values", "scale"]
    parts = rows.select(*names).unionByName(b.select(*names)).unionByName(a.select(*names))
    return parts.groupBy("module_path", "tile").applyInArrow(_product, "module_path string, row_idx long, values array<float>")


def _matrix(table: pa.Table, width: int | None = None) -> np.ndarray:
    column = table.column("values").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    widths = set(column.value_lengths().to_pylist()) if len(column) else {width or 0}
    flat = column.flatten()
    if len(widths) > 1 or None in widths or flat.null_count or (width is not None and widths != {width}):
        raise ValueError(f"an adapter's rows must be without nulls and of one width, here {sorted(map(str, widths))}, wanted {width}")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _product(key: tuple, table: pa.Table) -> pa.Table:
    """One tile: its base rows, its rows of B, and its module's rows of A."""
    table = table.combine_chunks()
    of = lambda kind: table.filter(pc.equal(table["kind"], kind))
    base = of(BASE).sort_by("row_idx").combine_chunks()
    ids, values = base.column("row_idx").to_numpy(), base.column("values").combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    a, b = of(SIDE_A), of(SIDE_B)
    if a.num_rows and b.num_rows and len(ids):
        lengths = values.value_lengths()
        width = next((n for n in lengths.to_pylist() if n is not None), None)
        if any(n not in (None, width) for n in lengths.to_pylist()):
            raise ValueError("a module's base rows differ in width")
        there = values.is_valid().to_numpy(zero_copy_only=False)
        flat = values.flatten()
        out = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width or 0)
        delta = np.zeros((len(ids), width or 0))
        for name in sorted(set(a["adapter_name"].to_pylist()) & set(b["adapter_name"].to_pylist())):
            left, right = b.filter(pc.equal(b["adapter_name"], name)), a.filter(pc.equal(a["adapter_name"], name)).sort_by("row_idx")
            # The factors of this tile's rows by rank; what B does not have is zero.
            factors, ranks = _matrix(left) * left["scale"].to_numpy()[:, None], right["row_idx"].to_numpy()
            ranks_here = ranks < factors.shape[1]
            rows = np.zeros((len(ids), np.count_nonzero(ranks_here)))
            by = {int(i): k for k, i in enumerate(left["row_idx"].to_numpy())}
            if len(by) < left.num_rows:
                raise ValueError(f"adapter {name} has rows of B of the same row_idx")
            at = np.array([by.get(int(i), -1) for i in ids])
            rows[at >= 0] = factors[at[at >= 0]][:, ranks[ranks_here]]
            delta += rows @ _matrix(right, width)[ranks_here]
        merged = (out + delta[there]).astype(np.float32).ravel()
        offsets = np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(merged, mask=flat.is_null().to_numpy(zero_copy_only=False)), mask=values.is_null())
    return pa.table([pa.array([key[0].as_py()] * len(ids), pa.string()), pa.array(ids), values], names=["module_path", "row_idx", "values"])


def requantize(weights: DataFrame, modules: DataFrame) -> DataFrame:
    """weights (module_path, row_idx, values) snapped by the group size of their module, where that is quantized.

    A quantized module without a group size has the default.
    """
    size = F.coalesce(F.col("group_size"), F.lit(GROUP_SIZE))
    sizes = modules.where(F.col("kind").isin(QUANT_LINEAR, QUANT_EMBEDDING)).select(F.col("path").alias("module_path"), size.alias("k"))
    rows = weights.join(sizes, "module_path", "left")
    # Group sizes are few and are plan constants, so each has an expression of its own.
    known = [r["k"] for r in sizes.select("k").distinct().orderBy("k").collect()]
    snapped = F.when(F.col("k").isNull(), F.col("values"))
    for k in known:
        snapped = snapped.when(F.col("k") == k, quantize(F.col("values"), k))
    return rows.select("module_path", "row_idx", (snapped if known else F.col("values")).alias("values"))


def save_pipeline(base: DataFrame, adapters: DataFrame, modules: DataFrame, alpha: float | None = None, rank: int | None = None, k: int = GROUP_SIZE, path: str | None = None) -> DataFrame:
    """Quantize the adapters, merge them by their own scale or the given one, snap the result; written to path as Parquet if one is given."""
    out = requantize(merge(base, quantize_adapters(adapters, k), alpha, rank), modules)
    if path:
        out.write.parquet(path)
        out = out.sparkSession.read.parquet(path)
    return out
