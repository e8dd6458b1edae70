"""Embedding near-dedup by cross-polytope hashing.

Unit vectors are turned by pseudo-random rotations (three rounds of random signs and a fast
Hadamard transform); the hash is the signed axis nearest to the turned vector, and a few such axes
name a bucket: more of them for more vectors, so that buckets stay small. Each vector also probes
the buckets of its next-best axes, so that a few tables give high recall. Exact copies are one
class from the start. Inside a bucket, candidate pairs are verified by cosine in double precision.
Only vectors with the same label meet.

A bucket of more than BUCKET classes is split: its rows are dealt to slices, and each pair of
slices is a tile of its own, so no task holds an unbounded group and no pair is lost. A link is
counted in the first bucket that both of its ends share; a tile gives the number of links of each
row and a spanning forest of them, never the pairs, so that what it writes does not grow with the
square of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import materialize
from corvane.llm.ann import matrix, usable
from corvane.llm.components import Forest, connected_components

#: Hash tables, and axes probed of each rotation: a table probes all their combinations.
TABLES, PROBES = 4, 2
#: Classes of a bucket that meet in one group.
BUCKET = 2048
#: Rows of a bucket whose pairs are laid out one by one, together with those of other buckets.
SMALL = 48
#: Rows of a matrix product, and pairs looked at, at a time.
CHUNK, PAIRS = 512, 1 << 16
#: Cosines nearer to the threshold than this are computed again in order of the components.
CLOSE = 1e-9
SEED = 77


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(vectors: int, dim: int) -> int:
    """Axes in a bucket's name: at least 2, and as many as keep about a vector a bucket."""
    width = 1 << max(1, (dim - 1).bit_length())
    return max(2, int(np.log(max(vectors, 2)) / np.log(2 * width)))


def axes(unit: np.ndarray, turns: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """[row, table, probe] bucket numbers."""
    n, dim = unit.shape
    width = 1 << (dim - 1).bit_length() if dim > 1 else 1
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    probes = min(probes, 2 * width)
    out = np.empty((n, tables, probes**turns), np.int64)
    for t in range(tables):
        names = np.zeros((n, 1), np.int64)
        for turn in range(turns):
            x = padded
            for s in np.random.default_rng((SEED, t, turn)).integers(0, 2, (3, width)) * 2.0 - 1:
                x = _hadamard(x * s)
            best = np.argsort(-np.concatenate([x, -x], axis=1), axis=1, kind="stable")[:, :probes]
            names = (names[:, :, None] * (2 * width) + best[:, None, :]).reshape(n, -1)
        out[:, t] = names
    return out


def _hasher(vectors: int, tables: int, probes: int):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            dims = batch.column("dim").to_numpy()
            buckets: list = [None] * len(batch)
            for d in np.unique(dims):
                where = np.flatnonzero(dims == d)
                x = matrix(batch.column("v").take(pa.array(where)))
                found = axes(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), rotations(vectors, int(d)), tables, probes)
                for i, own in zip(where.tolist(), found):
                    buckets[i] = (own * tables + np.arange(tables)[:, None]).ravel()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(buckets, pa.list_(pa.int64()))], [*batch.schema.names, "buckets"])

    return run


class _Rows:
    """Rows of whole tiles: vectors, norms, bucket names by table, and what links to them."""

    def __init__(self, table: pa.Table, tables: int, threshold: float):
        self.threshold, self.tables = threshold, tables
        self.id, self.n, self.side, self.bucket = (table[c].to_numpy() for c in ("id", "n", "side", "bucket"))
        self.x = matrix(table["v"])
        self.names = matrix(table["buckets"], np.int64).reshape(len(self.x), tables, -1)
        self.square = np.zeros(len(self.x))
        for d in range(self.x.shape[1]):
            self.square += self.x[:, d] ** 2
        self.norm = np.sqrt(self.square)
        self.forest, self.links = Forest(len(self.x)), np.zeros(len(self.x), np.int64)

    def add(self, i: np.ndarray, j: np.ndarray, cosine: np.ndarray | None = None) -> None:
        """Take the pairs that link, in the first bucket that they share. cosine: nearly exact, if known."""
        if cosine is not None:
            near = cosine >= self.threshold - CLOSE
            i, j, cosine = i[near], j[near], cosine[near]
        for at in range(0, len(i), PAIRS):
            own = slice(at, at + PAIRS)
            self._add(i[own], j[own], None if cosine is None else cosine[own])

    def _add(self, i: np.ndarray, j: np.ndarray, cosine: np.ndarray | None) -> None:
        open_ = np.ones(len(i), bool) if cosine is None else cosine < self.threshold + CLOSE
        a, b = i[open_], j[open_]
        dot = np.zeros(len(a))
        for d in range(self.x.shape[1]):
            dot += self.x[a, d] * self.x[b, d]
        keep = np.ones(len(i), bool)
        keep[open_] = dot / np.sqrt(self.square[a] * self.square[b]) >= self.threshold
        i, j = i[keep], j[keep]
        if not len(i):
            return
        p, q = self.names[i], self.names[j]
        shared = (p[:, :, :, None] == q[:, :, None, :]).any(axis=3)
        first = np.where(shared, p, np.iinfo(np.int64).max).reshape(len(i), -1).min(axis=1)
        new = first == self.bucket[i]
        i, j = i[new], j[new]
        self.links += np.bincount(i, self.n[j], len(self.links)).astype(np.int64) + np.bincount(j, self.n[i], len(self.links)).astype(np.int64)
        self.forest.link(i, j)

    def found(self) -> pa.RecordBatch:
        own, root = self.forest.edges()
        some = np.flatnonzero(self.links)
        a, b = np.concatenate([self.id[own], self.id[some]]), np.concatenate([self.id[root], np.zeros(len(some), np.int64)])
        n = np.concatenate([np.zeros(len(own), np.int64), self.links[some]])
        edge = np.arange(len(a)) >= len(own)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=edge), pa.array(n, pa.int64(), mask=~edge)], ["a", "b", "n"])


def _verify(table: pa.Table, threshold: float, tables: int) -> pa.RecordBatch:
    """Links inside each tile of a table that holds whole tiles of one length of vectors."""
    rows = _Rows(table, tables, threshold)
    tile = np.stack([table[c].to_numpy() for c in ("group", "s1", "s2")])
    starts = np.concatenate([[0], np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1])
    sizes = np.diff(np.append(starts, tile.shape[1]))
    # A small tile is a whole bucket: side 0 only. All pairs of such tiles at a time.
    whole = tile[1, starts] == tile[2, starts]
    small = whole & (sizes <= SMALL)
    for n in np.unique(sizes[small]):
        i, j = np.triu_indices(n, 1)
        at = starts[small & (sizes == n)]
        for part in np.array_split(at, -(-len(at) * max(len(i), 1) // PAIRS)):
            rows.add((part[:, None] + i).ravel(), (part[:, None] + j).ravel())
    for k in np.flatnonzero(~small).tolist():
        own = np.arange(starts[k], starts[k] + sizes[k])
        left, right = (own, own) if whole[k] else (own[rows.side[own] == 0], own[rows.side[own] == 1])
        for at in range(0, len(left), CHUNK):
            part = left[at : at + CHUNK]
            cosine = (rows.x[part] @ rows.x[right].T) / (rows.norm[part, None] * rows.norm[right])
            if whole[k]:
                cosine[right[None, :] <= part[:, None]] = -2.0
            i, j = np.nonzero(cosine >= threshold - CLOSE)
            rows.add(part[i], right[j], cosine[i, j])
    return rows.found()


def _verifier(threshold: float, tables: int):
    """Regroup sorted batches into tables of whole tiles; a task holds a batch and one tile."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(c).to_numpy() for c in ("group", "s1", "s2")]
            last = np.flatnonzero(np.any([x != x[-1] for x in names], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and not cut and all(h.column(c)[-1] == batch.column(c)[0] for h in held[-1:] for c in ("group", "s1", "s2")):
                held.append(batch)
                continue
            yield from _by_length([*held, batch.slice(0, cut)], threshold, tables)
            held = [batch.slice(cut)]
        yield from _by_length(held, threshold, tables)

    return run


def _by_length(batches: list[pa.RecordBatch], threshold: float, tables: int):
    batches = [b for b in batches if b.num_rows]
    if batches:
        table = pa.Table.from_batches(batches)
        dims = table["dim"].to_numpy()
        for d in np.unique(dims):
            yield _verify(table.take(pa.array(np.flatnonzero(dims == d))), threshold, tables)


def links(classes: DataFrame, threshold: float, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """What the tiles find: (a, b) edges of a forest of all links, and (a, n) numbers of linked rows.

    classes: id, label, dim, v and n, the rows that a class stands for. A link is a pair of classes
    of one label with cosine >= threshold that share a bucket. n is null for edges, b for numbers.
    """
    hashed = materialize(classes.select("id", "label", "dim", "n", "v").mapInArrow(_hasher(classes.count(), tables, probes), "id long, label string, dim int, n long, v array<double>, buckets array<long>"))
    keyed = hashed.select("id", "label", "dim", F.explode(F.array_distinct("buckets")).alias("bucket"))
    sizes = keyed.groupBy("label", "dim", "bucket").count().where("count > 1").withColumn("slices", F.ceil(F.col("count") / BUCKET).cast("int"))
    sizes = materialize(sizes.withColumn("group", F.monotonically_increasing_id()))
    own = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")
    # A row goes to every pair of slices that holds its own; side 1 is the later slice of a pair.
    dealt = keyed.join(sizes, ["label", "dim", "bucket"]).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, slices - 1)")))
    dealt = dealt.select("id", "bucket", "group", F.least("own", "other").alias("s1"), F.greatest("own", "other").alias("s2"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    full = dealt.join(hashed.select("id", "dim", "n", "v", "buckets"), "id")
    return full.repartition("group", "s1", "s2").sortWithinPartitions("group", "s1", "s2").mapInArrow(_verifier(threshold, tables), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    n_links counts other rows linked directly: exact copies and rows of linked classes. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows with a null label
    or id, link with nothing. Rows that share an id are one node of the components. Ids are
    integers; other columns are ignored, whatever their names.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    ok = usable(v) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.when(ok, v).alias("v"))
    good = rows.where("v IS NOT NULL")
    # Negative zeros equal zeros here and in grouping, so equal vectors are one class, named by its smallest id.
    classes = materialize(good.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    found = materialize(links(classes, threshold))
    others = found.where("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    counted = classes.join(others, "id", "left").select("label", "v", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    member = materialize(good.join(counted, ["label", "v"]).select("vec_id", "first", "n_links"))
    first = classes.select("id", "first")
    edges = found.where("b IS NOT NULL").join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # Copies take their class's component; classes that hold rows of one id are linked by it.
    several = member.groupBy("vec_id").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high")
    edges = edges.union(member.join(several, "vec_id").where("first > low").select(F.col("first").alias("a"), F.col("low").alias("b")))
    comp = connected_components(edges).withColumnRenamed("node", "first")
    out = member.join(comp, "first", "left").select("vec_id", "n_links", F.coalesce("component", "first").alias("component_id"))
    # Rows without a usable vector share the component of their id's other rows.
    same = out.groupBy("vec_id").agg(F.min("component_id").alias("component_id"))
    rest = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links")).join(same, "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
