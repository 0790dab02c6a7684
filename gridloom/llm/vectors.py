"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors of cosine c or more are, at unit length, within the squared distance 2 - 2c. Rotated by a
fixed orthogonal matrix and split into blocks, at least one block is within its proportional share
of that distance. So each block is range-joined: its first coordinate is cut into cells as wide as
the block's radius, and only vectors of the same or adjacent cells meet. A cell of more than PART
vectors is cut by hash into parts; every two parts that may meet are a tile. In a tile, block
distances come from a matrix product in single precision with a margin; pairs inside are tested
again in double precision, left to the first block that holds them, and verified by their cosine.

Equal vectors are one class with a multiplicity, so a group of copies is compared once. A tile
returns sums of links for each class and a spanning forest, never its pairs. On vectors without
structure the cells prune little and time grows with the square of the classes; it falls with the
structure that the rotated coordinates show.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links
with nothing; vectors of different lengths do not link; a null vec_id links with nothing and has a
null component; rows that repeat a vec_id count as vectors of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, written
from gridloom.llm.components import components, forest

COSINE = 0.9
#: Coordinates in a block, classes in a part of a cell, rows, columns and pairs handled at once.
BLOCK, PART, ROWS, COLUMNS, PAIRS = 16, 16384, 512, 1024, 1 << 17


@lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; a row's result does not depend on the other rows."""
    unit = vectors / np.sqrt(np.einsum("nd,nd->n", vectors, vectors))[:, None]
    return np.einsum("nd,kd->nk", unit, rotation(vectors.shape[1]), optimize=False)


def blocks(size: int) -> list[slice]:
    return [slice(k, min(k + BLOCK, size)) for k in range(0, size, BLOCK)]


def budgets(size: int, cosine: float) -> list[float]:
    """Each block's share of the squared distance, with room for rounding."""
    whole = 2 - 2 * cosine + 1e-9
    return [whole * (b.stop - b.start) / size for b in blocks(size)]


def _stacked(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _cells(cosine: float):
    schema = pa.schema([("id", pa.int64()), ("cells", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(batch.column("embedding").value_lengths())
            for size in np.unique(lengths):
                some = batch.filter(pa.array(lengths == size))
                at = rotated(_stacked(some.column("embedding")))
                cells = [np.floor(at[:, b.start] / (np.sqrt(most) * (1 + 1e-6))).astype(np.int64) for b, most in zip(blocks(size), budgets(size, cosine))]
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(np.stack(cells, 1).tolist(), type=schema.field("cells").type)], schema=schema)

    return run


def tile_pairs(x: np.ndarray, y: np.ndarray, own: bool, block: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (places in x, places in y) that this block answers for. own: x and y are the same."""
    rx, ry = rotated(x), rotated(y)
    size = x.shape[1]
    cut, most = blocks(size), budgets(size, cosine)
    bx, by = rx[:, cut[block]].astype(np.float32), ry[:, cut[block]].astype(np.float32)
    # One product gives -|a - b|^2 / 2 = ab - |a|^2 / 2 - |b|^2 / 2.
    half_x, half_y = (bx * bx).sum(1, keepdims=True) / 2, (by * by).sum(1, keepdims=True) / 2
    bx, by = np.hstack([bx, -half_x, np.ones_like(half_x)]), np.hstack([by, np.ones_like(half_y), -half_y])
    least = np.float32(-(most[block] + 1e-5) / 2)  # with a margin over what single precision may lose
    length_x, length_y = np.sqrt(np.einsum("nd,nd->n", x, x)), np.sqrt(np.einsum("nd,nd->n", y, y))
    # A product of ROWS by COLUMNS stays in a core's cache while it is made and searched.
    across, room = np.ascontiguousarray(by.T), np.empty((ROWS, COLUMNS), np.float32)
    for k in range(0, len(x), ROWS):
        for c in range(k // COLUMNS * COLUMNS if own else 0, len(y), COLUMNS):
            some, other = bx[k : k + ROWS], across[:, c : c + COLUMNS]
            product = np.matmul(some, other, out=room[: len(some), : other.shape[1]])
            near = np.flatnonzero(product >= least)
            i, j = near // product.shape[1] + k, near % product.shape[1] + c
            if own:
                i, j = i[j > i], j[j > i]
            for p in range(0, len(i), PAIRS):
                a, b = i[p : p + PAIRS], j[p : p + PAIRS]
                d = rx[a] - ry[b]
                d *= d
                keep = d[:, cut[block]].sum(1) <= most[block]
                for earlier in range(block):
                    keep &= d[:, cut[earlier]].sum(1) > most[earlier]
                a, b = a[keep], b[keep]
                if len(a):
                    linked = np.einsum("nd,nd->n", x[a], y[b]) / (length_x[a] * length_y[b]) >= cosine
                    yield a[linked], b[linked]


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _join_tile(cosine: float):
    """A tile to rows (a, null, links of a) and (a, b, null) of a spanning forest."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = key[1].as_py()
        table = table.combine_chunks()
        ids, side, copies = (table.column(c).to_numpy() for c in ("id", "side", "copies"))
        vectors = _stacked(table.column("embedding").combine_chunks())
        own = not side.any()
        left, right = (np.arange(len(ids)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links = np.zeros(len(ids), np.int64)
        nodes = np.empty(0, np.int64), np.empty(0, np.int64)
        for a, b in tile_pairs(vectors[left], vectors[right], own, block, cosine) if len(left) and len(right) else ():
            a, b = left[a], right[b]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            nodes = forest(np.concatenate([nodes[0], ids[a]]), np.concatenate([nodes[1], ids[b]]))
        some = np.flatnonzero(links)
        counts = pa.table([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some])], schema=FOUND)
        edges = pa.table([pa.array(nodes[0]), pa.array(nodes[1]), pa.nulls(len(nodes[0]), pa.int64())], schema=FOUND)
        return pa.concat_tables([counts, edges])

    return run


def tiles(cells: DataFrame, most: int) -> DataFrame:
    """(id, tile, block, side) of (id, length, block, cell): the parts of cells in which a vector meets others."""
    rows = cells.withColumn("room", F.concat_ws(":", "length", "block"))
    parts = rows.groupBy("room", "cell").agg(F.ceil(F.count("*") / most).alias("parts"))
    above = parts.select("room", (F.col("cell") - 1).alias("cell"), F.col("parts").alias("above"))
    below = parts.select("room", (F.col("cell") + 1).alias("cell"), F.col("parts").alias("below"))
    plan = parts.join(above, ["room", "cell"], "left").join(below, ["room", "cell"], "left")
    placed = rows.join(plan, ["room", "cell"])
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    cell = F.col("cell")

    def named(low_cell, low, high_cell, high, side):
        return F.struct(F.concat_ws("/", "room", low_cell, low, high_cell, high).alias("tile"), F.lit(side).alias("side"))

    def each(count, make):
        return F.when(F.coalesce(count, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), make)).otherwise(F.array().cast("array<struct<tile:string,side:int>>"))

    within = each(F.col("parts"), lambda k: F.when(k < own, named(cell, k, cell, own, 1)).otherwise(named(cell, own, cell, k, 0)))
    up = each(F.col("above"), lambda k: named(cell, own, cell + 1, k, 0))
    down = each(F.col("below"), lambda k: named(cell - 1, k, cell, own, 1))
    return placed.select("id", "block", F.explode(F.concat(within, up, down)).alias("at")).select("id", "block", "at.tile", "at.side")


@batches_of(4096)
def near_duplicates(vectors: DataFrame, cosine: float = COSINE, part: int = PART) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # Greatest and least are NaN or infinite if a component is; nulls are ordinary absences there.
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    classes = written(good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vector-classes")
    # Rows that repeat a vec_id with different vectors are classes of the same name; a second name keeps them apart.
    classes = classes.withColumn("place", F.xxhash64("embedding", "id"))
    cells = classes.select(F.col("place").alias("id"), "embedding").mapInArrow(_cells(cosine), "id long, cells array<long>")
    sized = cells.join(classes.select(F.col("place").alias("id"), F.size("embedding").alias("length")), "id")
    spread = written(sized.select("id", "length", F.posexplode("cells").alias("block", "cell")), "vector-cells")
    members = tiles(spread, part).join(classes.select(F.col("place").alias("id"), "copies", "embedding"), "id")
    found = written(members.groupBy("tile", "block").applyInArrow(_join_tile(cosine), "a long, b long, n long"), "vector-links")

    links = found.where("n is not null").groupBy(F.col("a").alias("place")).agg(F.sum("n").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    whole = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct())
    least = whole.join(classes.select(F.col("place").alias("node"), "id"), "node").groupBy("component").agg(F.min("id").alias("component_id"))
    named = whole.join(least, "component").select(F.col("node").alias("place"), "component_id")
    of_class = classes.join(links, "place", "left").join(named, "place", "left").select(F.col("embedding").alias("vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    answered = good.join(of_class, good.embedding == of_class.vector).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return answered.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: DuckDB SQL for the query: cosines of all pairs, components by reaching out from every vector.
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), good AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS len FROM d
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.len * b.len) >= {COSINE}
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least.component_id, d.vec_id = least.component_id AS kept
FROM d JOIN least ON least.a = d.vec_id LEFT JOIN n ON n.a = d.vec_id
"""


def brute_force(vectors: dict[int, list | None], cosine: float = COSINE) -> dict[int, tuple[int, int]]:
    """vec_id: (n_links, component_id) by all pairs: for tests."""
    label = {i: i for i in vectors}
    count = {i: 0 for i in vectors}
    good = {i: np.array(v, float) for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            x, y = good[i], good[j]
            if len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                count[i] += 1
                count[j] += 1
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i: (count[i], label[i]) for i in vectors}
