"""An inverted-file vector index with filters inside its lists.

Centroids are learned on a bounded sample; every usable vector goes to the list of its nearest
centroid. A query meets only the lists of its nearest centroids. Long lists are searched in
slices, so a list that holds a third of all rows is many tasks. Queries that find fewer than k
rows that way (a rare filter value, say) are searched again over all lists, and probes=None
searches all lists for every query: that is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vectors import valid
from corvane.shared import written

#: Rows that teach centroids at most, and rows of a slice of a list about.
SAMPLE, SLICE = 50_000, 8_192
#: Scores computed at a time, and rounds of learning.
CELLS, ROUNDS = 1 << 20, 12


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, vectors of length 1) of lists of one size."""
    v = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return v, v / np.sqrt((v * v).sum(axis=1))[:, None]


def centroids(vectors: DataFrame, lists: int, sample: int = SAMPLE, key: str = "block_id", vector: str = "embedding") -> np.ndarray:
    """At most `lists` unit vectors learned by spherical k-means on at most `sample` distinct vectors.

    The sample is the rows of the smallest hashes of their vector, so reruns agree and copies count
    once. Vectors must be of one length.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.where(valid(v) & F.exists(v, lambda x: x != 0)).select(v.alias("v"))
    drawn = rows.distinct().orderBy(F.xxhash64("v"), "v").limit(sample).toArrow()
    if not len(drawn):
        return np.zeros((0, 0))
    _, x = _unit(drawn["v"].combine_chunks())
    centre = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(x[i : i + 4096] @ centre.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        length = np.sqrt((total * total).sum(axis=1))
        centre = np.where(length[:, None] > 0, total / np.maximum(length, 1e-300)[:, None], centre)
    return centre


@dataclass
class Index:
    """rows: list, part, block_id, v and label of every usable vector; parts: slices of each list."""

    rows: DataFrame
    parts: DataFrame
    centre: np.ndarray

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, block_id, vector_score, rank) of the k best rows of each query by cosine.

        queries: query_id, query_vector, and wanted: a label that rows must have (null: any). A
        query never finds the row of its own id. Equal scores go to the smaller id. Queries whose
        vector is null, zero or not finite find nothing; repeated ones each find theirs.
        """
        v = F.col("query_vector").cast("array<double>")
        asked = written(queries.where(valid(v) & F.exists(v, lambda x: x != 0)).select(F.monotonically_increasing_id().alias("row"), F.col("query_id").cast("long").alias("query_id"), v.alias("v"), F.col("wanted").cast("string").alias("wanted")))
        found = self._among(asked, k, probes)
        if probes is not None and probes < len(self.centre):
            found = written(found)
            few = asked.join(found.groupBy("row").agg(F.count("*").alias("n")), "row", "left").where(F.coalesce("n", F.lit(0)) < k).drop("n")
            found = found.join(few, "row", "left_anti").unionByName(self._among(few, k, None))
        return found.drop("row")

    def _among(self, asked: DataFrame, k: int, probes: int | None) -> DataFrame:
        if not len(self.centre):
            return asked.limit(0).select("row", "query_id", F.lit(0).cast("long").alias("block_id"), F.lit(0.0).alias("vector_score"), F.lit(1).alias("rank"))
        centre, most = self.centre, min(probes or len(self.centre), len(self.centre))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = np.argpartition(-(_unit(batch.column("v"))[1] @ centre.T), most - 1, axis=1)[:, :most]
                at = pa.array(np.repeat(np.arange(batch.num_rows), most))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(near.ravel().astype(np.int32))], [*batch.schema.names, "list"])

        routed = asked.mapInArrow(nearest, "row long, query_id long, v array<double>, wanted string, list int")
        # A query goes to every slice of its lists; the number of slices follows the rows.
        routed = routed.join(self.parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        keys = ("list", "part")
        got = routed.groupBy(*keys).cogroup(self.rows.groupBy(*keys)).applyInArrow(_slice(k), "row long, query_id long, block_id long, vector_score double")
        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("vector_score"), "block_id"))
        return got.withColumn("rank", rank).where(F.col("rank") <= k)


_EMPTY = pa.table({"row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "block_id": pa.array([], pa.int64()), "vector_score": pa.array([], pa.float64())})


def _slice(k: int):
    """The k best rows of a slice for each query that comes to it."""

    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return _EMPTY
        (q, q_near), (b, b_near) = (_unit(t["v"].combine_chunks()) for t in (queries, rows))
        row, query_id, block_id = queries["row"].to_numpy(), queries["query_id"].to_numpy(), rows["block_id"].to_numpy()
        codes: dict[str | None, int] = {}
        label = np.array([codes.setdefault(x, len(codes)) for x in rows["label"].to_pylist()])
        wanted = np.array([-1 if x is None else codes.get(x, -2) for x in queries["wanted"].to_pylist()])
        # Squares and products are added in order of the components, as expressions add them.
        length = lambda m: np.sqrt(sum(m[:, c] * m[:, c] for c in range(m.shape[1])))
        q_len, b_len = length(q), length(b)
        out, step = [], max(1, CELLS // len(b))
        for at in range(0, len(q), step):
            own = slice(at, at + step)
            rough = q_near[own] @ b_near.T
            hidden = ((wanted[own, None] != -1) & (wanted[own, None] != label[None, :])) | (query_id[own, None] == block_id[None, :])
            rough[hidden] = -np.inf
            limit = np.partition(rough, -k, axis=1)[:, -k] if len(b) >= k else np.full(len(rough), -np.inf)
            # Rounding of the product is far below 1e-9: nothing that belongs to the k is left out.
            i, j = np.nonzero((rough >= limit[:, None] - 1e-9) & (rough > -np.inf))
            i += at
            score = np.clip((sum(q[i, c] * b[j, c] for c in range(q.shape[1])) / (b_len[j] * q_len[i]) + 1.0) / 2.0, 0.0, 1.0)
            order = np.lexsort((block_id[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pa.table([row[i[first]], query_id[i[first]], block_id[j[first]], score[first]], names=_EMPTY.schema.names))
        return pa.concat_tables(out)

    return run


def build(vectors: DataFrame, lists: int, label: str | None = None, sample: int = SAMPLE, key: str = "block_id", vector: str = "embedding") -> Index:
    """The index of all usable vectors: neither null, zero nor with components that are null or not finite.

    label: the column that queries can filter by. Rows without id are left out; repeated rows each
    have their place. The centroids (lists times the length of a vector) go to every task.
    """
    v = F.col(vector).cast("array<double>")
    good = vectors.where(F.col(key).isNotNull() & valid(v) & F.exists(v, lambda x: x != 0))
    lengths = [r["d"] for r in good.select(F.size(v).alias("d")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("vectors of one index have one length")
    centre = centroids(vectors, lists, sample, key, vector)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_unit(batch.column("v"))[1] @ centre.T).argmax(axis=1).astype(np.int32) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(near), *batch.columns], ["list", *batch.schema.names])

    named = good.select(F.col(key).cast("long").alias("block_id"), v.alias("v"), (F.lit(None) if label is None else F.col(label)).cast("string").alias("label"))
    rows = written(named.mapInArrow(assign, "list int, block_id long, v array<double>, label string"))
    parts = written(rows.groupBy("list").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("parts")))
    dealt = rows.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("block_id", "v"), F.col("parts")).cast("int")).drop("parts")
    return Index(dealt, parts, centre)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    both = exact.select("query_id", "block_id").distinct()
    hit = both.join(found.select("query_id", "block_id").distinct(), ["query_id", "block_id"], "left_semi").count()
    return hit / (both.count() or 1)
