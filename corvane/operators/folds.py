"""Folds over the segments of a document whose steps depend on what came before.

Rows are dealt and sorted by document, and one pass over a task's sorted batches carries the state:
a few numbers, or the document at hand, never a corpus-wide group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, pairwise
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.geometry import column_bucket
from corvane.functions.text import ends_open, starts_like_continuation, strip

#: Points from which two segments are one paragraph; segments that may stand between.
MERGE_SCORE, MAX_INTERRUPTORS = 6, 2
#: Target tokens of a chunk of text, and of a batch of partial results.
CHUNK_TOKENS, BATCH_TOKENS = 18_000, 12_000
#: Rows of a batch of results.
ROWS = 4096


def _flows(a: dict, b: dict) -> bool:
    """Whether the place of b on the page is where a reader goes on after a."""
    if a["page"] != b["page"]:
        return b["column"] in ("left", "full", "unknown")
    if (a["column"], b["column"]) == ("left", "right"):
        return True
    return a["column"] == b["column"] != "unknown" and b["top"] - a["bottom"] <= 0.12


def _new_paragraph(end: dict, b: dict) -> bool:
    return end["sentence_end"] and b["capital"] and not b["goes_on"]


#: Points for what is seen of a paragraph's first part (a), its last one so far (end), the segment
#: that may continue it (b), and the number of others between.
RULES = (
    (3, lambda a, end, b, between: end["open"]),
    (1, lambda a, end, b, between: end["hyphen"]),
    (3, lambda a, end, b, between: b["goes_on"]),
    (-4, lambda a, end, b, between: _new_paragraph(end, b)),
    (1, lambda a, end, b, between: True),
    (1, lambda a, end, b, between: a["page"] == b["page"]),
    (1, lambda a, end, b, between: a["page"] == b["page"] and b["order_index"] - a["order_index"] in (1, 2, 3)),
    (2, lambda a, end, b, between: _flows(a, b)),
    (1, lambda a, end, b, between: not a["path"] or not b["path"] or a["path"] == b["path"]),
    (-1, lambda a, end, b, between: between > 1),
)


def _parts(rows: list[dict]) -> Iterator[list[int]]:
    """Places of the parts of every segment of a document that stays, in order."""
    taken: set[int] = set()
    for i, a in enumerate(rows):
        if i in taken:
            continue
        parts, between = [i], 0
        for j in range(i + 1, len(rows) if a["flowing"] else 0):
            b = rows[j]
            if j in taken:
                continue
            if b["page"] - a["page"] > 1 or b["role"] == "heading" or between > MAX_INTERRUPTORS:
                break
            if not b["flowing"]:
                between += 1
                continue
            end = rows[parts[-1]]
            if not a["stripped"] or not b["stripped"] or sum(n for n, seen in RULES if seen(a, end, b, between)) < MERGE_SCORE:
                break
            parts.append(j)
            taken.add(j)
            between = 0
        yield parts


def _text(parts: list[dict]) -> str:
    out = parts[0]["stripped"]
    for end, b in pairwise(parts):
        out = out[:-1] + b["stripped"] if end["hyphen"] else out + ("\n\n" if _new_paragraph(end, b) else " ") + b["stripped"]
    return out


MERGED = "doc_id string, segment_id string, page_index int, order_index int, role string, text string, merged_from array<string>"
_MERGED = pa.schema([("doc_id", pa.string()), ("segment_id", pa.string()), ("page_index", pa.int32()), ("order_index", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("merged_from", pa.list_(pa.string()))])


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for _, document in groupby((row for batch in batches for row in batch.to_pylist()), key=itemgetter("doc_id")):
        rows = list(document)
        for places in _parts(rows):
            parts = [rows[i] for i in places]
            text = _text(parts) if len(parts) > 1 else parts[0]["text"]
            out.append({name: parts[0].get(name) for name in _MERGED.names} | {"text": text, "merged_from": [x["segment_id"] for x in parts]})
        if len(out) >= ROWS:
            yield pa.RecordBatch.from_pylist(out, schema=_MERGED)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_MERGED)


def merge_continuations(segments: DataFrame) -> DataFrame:
    """Paragraphs that run over columns, pages, tables and figures become one.

    segments: doc_id, segment_id, page_index, order_index, role, text, bbox, section_path. A merged
    segment keeps the place of its first part. Headings end a paragraph; at most two other
    segments (figures, tables, captions) may stand between its parts. Every other segment stays.
    What the points hang on are columns; a task holds one document at a time. Blank texts are never
    merged; without page or order a segment counts as the first.
    """
    t = strip(F.coalesce("text", F.lit("")))
    box = F.col("bbox")
    seen = {
        "page": F.coalesce("page_index", F.lit(0)),
        "order_index": F.coalesce("order_index", F.lit(0)),
        "flowing": F.coalesce(F.col("role").isin("paragraph", "list_item"), F.lit(False)),
        "stripped": t,
        "hyphen": F.endswith(t, F.lit("-")),
        "open": ends_open(F.col("text")),
        "sentence_end": F.rlike(t, F.lit(r"[.?!:]$")),
        "capital": F.rlike(t, F.lit(r"^\p{Lu}")),
        "goes_on": starts_like_continuation(F.col("text")),
        "column": column_bucket(box),
        "top": F.get(box, F.lit(1)),
        "bottom": F.get(box, F.lit(3)),
        "path": F.coalesce("section_path", F.array().cast("array<string>")),
    }
    rows = segments.select("doc_id", "segment_id", "page_index", "role", "text", *[c.alias(name) for name, c in seen.items()])
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "page", "order_index", "segment_id").mapInArrow(_merge, MERGED)


def pack(items: DataFrame, group: str, order: str, tokens: Column, target: int = CHUNK_TOKENS, out: str = "chunk") -> DataFrame:
    """Number greedy chunks (from 0): a chunk closes when the next item would take it over the target.

    One row comes back for each item: group, order, tokens, out. An item over the target is a chunk
    of its own; unknown tokens count 0. However long a group is, a task holds a batch of it.
    """
    kinds = dict(items.dtypes)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, used, chunk = object(), 0, 0
        for batch in batches:
            chunks = []
            for g, n in zip(batch["g"].to_pylist(), batch["tokens"].to_pylist()):
                if g != own:
                    own, used, chunk = g, 0, 0
                elif used and used + n > target:
                    used, chunk = 0, chunk + 1
                used += n
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, pa.int32())], names=["g", "o", "tokens", "chunk"])

    rows = items.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(tokens.cast("long"), F.lit(0).cast("long")).alias("tokens"))
    packed = rows.repartition("g").sortWithinPartitions("g", "o").mapInArrow(number, f"g {kinds[group]}, o {kinds[order]}, tokens long, chunk int")
    return packed.toDF(group, order, "tokens", out)


def split_columns(xs: list[float], gap: float = 0.12, most: int = 3) -> list[int]:
    """Column of each x: a gap wider than `gap` starts a new one, up to `most`."""
    order = sorted(range(len(xs)), key=xs.__getitem__)
    out, column = [0] * len(xs), 0
    for a, b in pairwise(order):
        column = min(column + (xs[b] - xs[a] > gap), most - 1)
        out[b] = column
    return out
