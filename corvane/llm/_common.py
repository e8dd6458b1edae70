"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, _UPPER, _LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share.

    The cluster names it in spark.checkpoint.dir; without it a cluster gets an error. Only where
    driver and tasks are one process (tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/corvane-{uuid.uuid4().hex}"


#: Folders that materialize() wrote since the innermost scratch() began.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps restart from the files.

    This cuts the lineage, computes each row once for all readers, and survives lost executors.
    """
    spark = spark or df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Remove the tables that materialize() writes inside, but for those taken out of the list."""
    outer = _WRITTEN.set([])
    written = _WRITTEN.get()
    try:
        yield written
    finally:
        _WRITTEN.reset(outer)
        for path in written:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/corvane-" in name:
            _remove(df.sparkSession, name)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed_row(docs: DataFrame, added: list[str] | tuple[str, ...] = ()) -> Column:
    """A row as one structure, so that no name of its columns can clash with those of an operator.

    Columns that bear the name of an added one (in any case) are left out: the added one replaces them.
    """
    taken = {n.lower() for n in added}
    return F.struct(*[quoted(c) for c in docs.columns if c.lower() not in taken]).alias("row")


def extend(docs: DataFrame, used: dict[str, str | Column], added: str, body: Callable, keep: list[str] | None = None) -> DataFrame:
    """The rows of docs with further columns (added, as DDL) that body makes from Arrow batches.

    body gets batches of row and the used columns, and gives row and the added ones. keep names the
    input columns that come out (all); one of an added name is replaced. A used text column given
    by name travels once, inside row, if it is kept. Spark bounds the bytes of a batch
    (spark.sql.execution.arrow.maxBytesPerBatch), so rows of any length fit.
    """
    fields = T.StructType.fromDDL(added).fields
    names = [f.name for f in fields]
    taken = {n.lower() for n in names}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    inside = {n: kept.index(c) for n, c in used.items() if isinstance(c, str) and c in kept and docs.schema[c].dataType == T.StringType()}
    apart = [(quoted(c).cast("string") if isinstance(c, str) else c).alias(n) for n, c in used.items() if n not in inside]
    if not kept:
        return docs.select(*apart).mapInArrow(_without_row(body), T.StructType(fields))
    wide = docs.select(F.struct(*[quoted(c) for c in kept]).alias("row"), *apart)

    def run(batches):
        given = (pa.RecordBatch.from_arrays([*b.columns, *(b.column("row").field(i) for i in inside.values())], [*b.schema.names, *inside]) for b in batches)
        return body(given)

    return wide.mapInArrow(run if inside else body, T.StructType([wide.schema["row"], *fields])).select("row.*", *names)


def _without_row(body: Callable) -> Callable:
    def run(batches):
        wide = (pa.RecordBatch.from_arrays([pa.nulls(len(b)), *b.columns], ["row", *b.schema.names]) for b in batches)
        for out in body(wide):
            yield out.drop_columns(["row"])

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scan_parts(df: DataFrame) -> int:
    """Tasks that a scan is cut into: it grows with the bytes of the input."""
    return max(1, df.rdd.getNumPartitions())


def blocks(batches: Iterator[pa.RecordBatch], text: str, max_chars: int) -> Iterator[tuple[int, pa.Table]]:
    """Regroup a partition's rows into blocks of whole rows, each with a number that no other block has.

    A block closes once its texts hold max_chars bytes, so memory is bounded by that plus one row.
    """
    part, k = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.diff(np.frombuffer(_offsets(batch.column(text)), np.int32 if batch.column(text).type == pa.string() else np.int64)[batch.column(text).offset :][: batch.num_rows + 1])
        start = 0
        for i, n in enumerate(lengths.tolist()):
            size += n
            if size >= max_chars:
                held.append(batch.slice(start, i + 1 - start))
                yield part << 32 | k, pa.Table.from_batches(held)
                k, held, size, start = k + 1, [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield part << 32 | k, pa.Table.from_batches(held)


def _offsets(array: pa.Array) -> memoryview:
    return memoryview(array.buffers()[1])


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(values: np.ndarray) -> bytes:
    """Integers below 2**32 as compressed byte planes; small values cost little."""
    v = np.ascontiguousarray(values, np.uint32)
    return squeeze(v.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(expand(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
