"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import discard, materialize

#: The rounds needed grow with the logarithm of the nodes; this only guards against errors.
MAX_ROUNDS = 60
#: Edges that a task holds before it contracts them.
HELD = 1 << 21


class Forest:
    """Components of a task's rows 0..n-1 under links that come in pieces; keeps one number a row."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(self.root, a, low)
            np.minimum.at(self.root, b, low)
            while (self.root != (up := self.root[self.root])).any():
                self.root = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are not their component's first, and that first."""
        own = np.flatnonzero(self.root != np.arange(len(self.root)))
        return own, self.root[own]


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the smallest neighbour of their end a.

    The smallest come from an aggregate that combines before its shuffle; its key gets another name
    by an expression, so that both sides of the join are dealt for it alone and a hot node is a
    skewed join that Spark splits, and no neighbourhood is gathered in one place.
    """
    smallest = least.select(F.col("a").bitwiseXOR(F.lit(0)).alias("node"), "m")
    return edges.join(smallest, F.col("a") == F.col("node")).drop("node")


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _met(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node's smaller neighbours, and the node, to the smallest of them (edges have a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _met(edges, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Self-loops, repeated edges and either direction are allowed; rows with a null end are left
    out. Each task first contracts its own edges, so rounds only join what tasks can't see. Each
    round's edges are written to the shared folder, so a lost executor costs one round, and the
    loop ends when the edges are stars. Nothing but counts reaches the driver.
    """
    clean = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = materialize(clean.mapInArrow(_contract, "a long, b long").distinct())
    for _ in range(MAX_ROUNDS):
        if not _unsettled(now):
            break
        after = materialize(_small_star(_large_star(now)).distinct())
        discard(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _contract(batches):
    """The edges of a task as stars (a > b): each node with the smallest that the task's edges reach.

    After every HELD edges the stars take the place of what they came from.
    """
    a, b, held = [], [], 0

    def stars() -> tuple[np.ndarray, np.ndarray]:
        names, ends = np.unique(np.concatenate([*a, *b]), return_inverse=True)
        forest = Forest(len(names))
        forest.link(*np.split(ends, 2))
        own, root = forest.edges()
        return names[own], names[root]

    for batch in batches:
        a.append(batch.column("a").to_numpy())
        b.append(batch.column("b").to_numpy())
        held += batch.num_rows
        if held >= HELD:
            one, other = stars()
            a, b, held = [one], [other], 0
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars()], ["a", "b"])


def _unsettled(edges: DataFrame) -> int:
    """Nodes that keep the edges from being stars: with two smaller neighbours, or smaller and larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").count()
