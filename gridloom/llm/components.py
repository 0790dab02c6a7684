"""Connected components over edge tables, without gathering links on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import written

#: Rounds after which the job stops with an error; components of any shape need about the square of the logarithm of their size.
MOST_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge table (a, b): component is the least node reachable. Nodes without an edge to another have no row.

    Alternating large-star and small-star rounds; each round's edges are written to the shared
    folder, so that lineage stays short. A node's least neighbour is combined on the map side, and
    the rows of a node with very many are split over tasks.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Keyed by another number than the sums are, so that the join shuffles anew and a hot node's rows are split by the skew join;
        # a node that is less than all its neighbours gives them nothing that they have not.
        least = both.groupBy("a").agg(F.min("b").alias("m")).where("m < a").select(F.bitwise_not("a").alias("k"), "m")
        large = both.where("b > a").withColumn("k", F.bitwise_not("a")).join(least, "k").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(now).where("a <> b").distinct()
        # What is larger than its neighbours now hangs from the least of them.
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(parent.select("a", F.col("m").alias("b")))
        step = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        mark = step.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"), F.countDistinct("a").alias("k")).first()
        if mark["n"] == mark["k"] and (mark["n"], mark["s"]) == before:
            return step.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, now = (mark["n"], mark["s"]), step
    raise RuntimeError("components did not settle")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges (a, b), for nodes that are not the least themselves."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        next_label = label.copy()
        np.minimum.at(next_label, label[x], low)
        np.minimum.at(next_label, label[y], low)
        next_label = next_label[next_label]
        while not np.array_equal(next_label, again := next_label[next_label]):
            next_label = again
        if np.array_equal(label, next_label):
            break
        label = next_label
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
