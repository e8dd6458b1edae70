"""Review of parsed documents: edits, what they change, and what hangs on the changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def apply_edits(blocks: DataFrame, edits: DataFrame, key: str = "block_id", text: str = "text") -> DataFrame:
    """Blocks with edited texts and `changed`: whether an edit says something else (nulls compare equal)."""
    joined = blocks.join(edits.select(key, F.col(text).alias("_new"), F.lit(True).alias("_edited")), key, "left")
    edited = F.coalesce("_edited", F.lit(False))
    out = joined.withColumn("changed", edited & ~F.col(text).eqNullSafe(F.col("_new")))
    return out.withColumn(text, F.when(edited, F.col("_new")).otherwise(F.col(text))).drop("_new", "_edited")


def impacted(links: DataFrame, changed: DataFrame) -> DataFrame:
    """(doc_id, block_id) of what must be prepared again: changed blocks, and those whose context holds one.

    One pass in order of pos: a block also counts if its context holds an earlier block that came
    in during the pass. links: doc_id, block_id, pos, context_id; changed: doc_id, block_id. Only
    documents that have a change are walked, one after the other in the order of a partition; a task
    remembers the blocks of one document.
    """
    marks = changed.select("doc_id", F.col("block_id"), F.lit(-1).alias("pos"), F.lit(None).cast(links.schema["context_id"].dataType).alias("context_id"))
    rows = links.join(changed.select("doc_id"), "doc_id", "left_semi").select("doc_id", "block_id", "pos", "context_id").unionByName(marks)
    schema = T.StructType([T.StructField(n, links.schema[n].dataType) for n in ("doc_id", "block_id")])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, seen = object(), set()
        for batch in batches:
            docs, blocks = [], []
            for doc, block, pos, context in zip(*[c.to_pylist() for c in batch.columns]):
                if doc != document:
                    document, seen = doc, set()
                if block not in seen and ((pos is not None and pos < 0) or (context is not None and context in seen)):
                    seen.add(block)
                    docs.append(doc)
                    blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(blocks, batch.schema.field(1).type)], ["doc_id", "block_id"])

    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id", F.asc_nulls_last("pos"))
    return dealt.mapInArrow(walk, schema)
