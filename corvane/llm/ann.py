"""Exact nearest neighbours by a block matrix join with int8 products.

Vectors are quantised once, to int8 codes with a scale and the length of what is lost. Blocks of
codes of queries and of candidates meet in tiles, one group of a join for each pair of blocks; the
vectors themselves stay where they are written. In a tile, the integer product of the codes gives
every distance up to a known error, and a pair survives only if its lower bound does not exceed
the k-th smallest upper bound of its query, first in the tile, then over all tiles. The survivors,
about k a query, meet their original vectors again, are recomputed in double precision and merged
by a heap for each query. So nothing is lost, and the only all-against-all work is a small
integer matrix product.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of
different length are never compared.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._common import materialize, shuffle_partitions

#: Candidates and queries of a tile at most. A candidate's code travels once for each block of
#: queries, a query's once for each block of candidates, and a tile leaves k pairs a query at least.
CANDIDATES, QUERIES = 1 << 16, 1 << 13
#: Candidates of a tile at least, where a small input is cut further to busy all tasks.
LEAST = 2048
#: Distances computed at a time.
CELLS = 1 << 21


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error): x is codes * scale up to a vector of length error."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    codes = np.rint(x / scale[:, None])
    return codes.astype(np.int8), scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances between two quantised blocks."""
    (ca, sa, ea), (cb, sb, eb) = a, b
    # int8 products summed in float32 are exact below 2**24, in float64 always.
    kind = np.float32 if ca.shape[1] * 127 * 127 < 1 << 24 else np.float64
    dot = (ca.astype(kind) @ cb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    na, nb = ((ca.astype(np.float64) ** 2).sum(axis=1) * sa**2), ((cb.astype(np.float64) ** 2).sum(axis=1) * sb**2)
    square = na[:, None] + nb[None, :] - 2 * dot
    # Rounding of the three terms, far below the quantisation error, is covered as well.
    slack = 1e-12 * (na[:, None] + nb[None, :])
    error = ea[:, None] + eb[None, :]
    low = np.sqrt(np.maximum(square - slack, 0)) - error
    return low, np.sqrt(np.maximum(square + slack, 0)) + error


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, squares added in order of the components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(total)


_CODED = "row long, id long, dim int, q boolean, v array<double>, code binary, scale double, error double"


def _coder(batches):
    for batch in batches:
        n = batch.num_rows
        codes, scale, error = np.empty(n, object), np.zeros(n), np.zeros(n)
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            code, scale[at], error[at] = quantise(matrix(batch.column("v").take(pa.array(at))))
            codes[at] = [c.tobytes() for c in code]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(scale), pa.array(error)], [*batch.schema.names, "code", "scale", "error"])


def _block(table: pa.Table) -> tuple[np.ndarray, tuple]:
    codes = np.frombuffer(b"".join(table["code"].to_pylist()), np.int8).reshape(len(table), -1)
    return table["row"].to_numpy(), (codes, table["scale"].to_numpy(), table["error"].to_numpy())


def _tile(k: int):
    """Pairs of a tile with a lower bound up to the k-th smallest upper bound of their query."""

    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(candidates):
            (q_row, q), (c_row, c) = _block(queries), _block(candidates)
            wide = min(len(c_row), LEAST)
            step = max(1, CELLS // wide)
            for at in range(0, len(q_row), step):
                own = tuple(x[at : at + step] for x in q)
                rows = q_row[at : at + step]
                best = np.full((len(rows), k), np.inf)
                kept = []
                for left in range(0, len(c_row), wide):
                    low, high = bounds(own, tuple(x[left : left + wide] for x in c))
                    self = rows[:, None] == c_row[None, left : left + wide]
                    low[self], high[self] = np.inf, np.inf
                    best = np.partition(np.concatenate([best, high], axis=1), k - 1, axis=1)[:, :k]
                    i, j = np.nonzero((low <= best[:, -1:]) & ~self)
                    kept.append((i, j + left, low[i, j], high[i, j]))
                i, j, low, high = map(np.concatenate, zip(*kept))
                near = low <= best[i, -1]
                found.append((rows[i[near]], c_row[j[near]], low[near], high[near]))
        columns = map(np.concatenate, zip(*found)) if found else [np.zeros(0)] * 4
        return pa.table([pa.array(x.astype(t), t) for x, t in zip(columns, ("int64", "int64", "float64", "float64"))], names=["q_row", "c_row", "low", "high"])

    return run


def _merger(k: int):
    """The k nearest of each query, from its survivors in a row."""

    def run(batches):
        last, name, heap = None, None, []

        def done():
            rows = [(last, name, -y, -d) for d, y in heap]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["q_row", "query_id", "vec_id", "score"])

        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            score = np.zeros(batch.num_rows)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                score[at] = distances(*(matrix(batch.column(c).take(pa.array(at))) for c in ("qv", "cv")))
            for row, query, d, y in zip(batch.column("q_row").to_pylist(), batch.column("query_id").to_pylist(), score.tolist(), batch.column("vec_id").to_pylist()):
                if row != last:
                    if heap:
                        yield done()
                    last, name, heap = row, query, []
                # Of equals the smaller id stays; the heap's first is the worst.
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -y))
                elif (-d, -y) > heap[0]:
                    heapq.heapreplace(heap, (-d, -y))
        if heap:
            yield done()

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (distance) of each query row's k nearest other rows.

    Nearest first, ties to the smaller id; all candidates if there are fewer than k. A row is
    never its own neighbour, but another row with the same id or vector can be. Repeated query
    rows each get their neighbours. Rows without id take no part; ids are integers. Other columns
    are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = vectors.where(usable(v) & F.col(id_col).isNotNull())
    # Rows get numbers and codes once and keep them: the written table is what all tiles read.
    numbered = good.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), is_query.alias("q"), v.alias("v"))
    rows = materialize(numbered.mapInArrow(_coder, _CODED))
    count, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    c_blocks = max(-(-count // CANDIDATES), min(-(-count // LEAST), shuffle_partitions(spark))) or 1
    q_blocks = -(-asked // QUERIES) or 1
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    # A tile is (query block, candidate block): each side is repeated once for every block of the other.
    coded = rows.select("row", "dim", "q", "code", "scale", "error")
    left = coded.where("q").drop("q").withColumn("qb", deal(q_blocks, 1)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    right = coded.drop("q").withColumn("cb", deal(c_blocks, 2)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    keys = ("dim", "qb", "cb")
    found = materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k), "q_row long, c_row long, low double, high double"))
    kth = F.row_number().over(Window.partitionBy("q_row").orderBy("high"))
    limit = found.withColumn("nth", kth).where(F.col("nth") <= k).groupBy("q_row").agg(F.max("high").alias("limit"), F.count("*").alias("n"))
    near = found.join(limit, "q_row").where((F.col("n") < k) | (F.col("low") <= F.col("limit"))).select("q_row", "c_row")
    met = near.join(rows.select(F.col("row").alias("c_row"), F.col("id").alias("vec_id"), F.col("v").alias("cv")), "c_row")
    met = met.join(rows.where("q").select(F.col("row").alias("q_row"), F.col("id").alias("query_id"), "dim", F.col("v").alias("qv")), "q_row")
    best = met.repartition("q_row").sortWithinPartitions("q_row").mapInArrow(_merger(k), "q_row long, query_id long, vec_id long, score double")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("q_row").orderBy("score", "vec_id"))).select("query_id", "rank", "vec_id", "score")
