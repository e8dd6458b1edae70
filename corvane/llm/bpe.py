"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Plan: one scan splits the documents of a block into pre-tokens and sends each distinct word to
the shard of its hash. There every word of the corpus is encoded once, and the ids join back to
the blocks that asked. A second scan sends the positions of a block's words straight to that
join, where the documents are laid out again; so positions are shuffled once. A frequent word
travels once a block, never once an occurrence, so no key is hot. Rows carry packed words, which
keeps the shuffle below the size of the texts.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import blocks, expand, extend, materialize, pack, ragged, scan_parts, squeeze, unpack

#: UTF-8 bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Words up to this many bytes are merged by scanning; longer ones by a heap.
SCAN_BYTES = 64
#: Shuffle partitions a task of the scan, and shards a partition: both follow the input's bytes, so
#: that a task's and a group's share of the words stay the same at every size.
PARTS, SHARDS = 2, 2
#: Rows decoded at a time.
ROWS = 500
#: The token-byte table goes to every task, so its size is checked.
MAX_TOKENS = 2_000_000


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks from a file of lines "base64 rank"; the driver reads it, tasks get it by broadcast."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_TOKENS:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_TOKENS} are broadcast")
    return ranks


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank merges first, the leftmost of equals."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(word) > SCAN_BYTES:
        return [ranks[p] for p in _merge_long(parts, ranks)]
    get = ranks.get
    scores = [get(a + b) for a, b in zip(parts, parts[1:])]
    while scores:
        best = min((s for s in scores if s is not None), default=None)
        if best is None:
            break
        i = scores.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i:
            scores[i - 1] = get(parts[i - 1] + parts[i])
        if i < len(scores):
            scores[i] = get(parts[i] + parts[i + 1])
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    n = len(parts)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    alive = [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            pair = parts[i] + parts[after[i]]
            if (r := ranks.get(pair)) is not None:
                heapq.heappush(heap, (r, i, len(pair)))

    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        alive[j], after[i] = False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(before[i])
        push(i)
    return [p for p, a in zip(parts, alive) if a]


_WORDS = "block long, shard long, words binary, sizes binary"
_STREAM = "block long, stream binary, homes binary, counts binary, ids array<long>"


def _splitter(pattern: str, shards: int, block_bytes: int, positions: bool):
    """Rows of _STREAM, one a block, or of _WORDS, one for each shard that a block has words for."""

    def split(batches):
        find = regex.compile(pattern).findall
        for block, table in blocks(batches, "text", block_bytes):
            index: dict[str, int] = {}
            add = index.setdefault
            counts, codes = [], []
            for text in table["text"].to_pylist():
                tokens = find(text) if text else []
                counts.append(len(tokens))
                codes.append(np.fromiter([add(t, len(index)) for t in tokens], np.int64, len(tokens)))
            stream = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            # Frequent words get small numbers: they pack better.
            order = np.argsort(-np.bincount(stream, minlength=len(index)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = [w.encode() for w in index]
            words = [words[i] for i in order.tolist()]
            home = np.fromiter((zlib.crc32(w) % shards for w in words), np.int64, len(words))
            by_home = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.diff(home[by_home])) + 1
            if positions:
                yield _batch(_STREAM, [(block, pack(rank[stream]), pack(home), pack(np.array(counts, np.int64)), table["doc_id"].to_pylist())])
            elif words:
                yield _batch(_WORDS, [(block, int(home[own[0]]), _pack_words([words[i] for i in own.tolist()]), None) for own in np.split(by_home, cuts)])

    return split


_KINDS = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return squeeze(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    raw = expand(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    bounds = [4 + 4 * n, *ends.tolist()]
    return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


def _shard_encoder(ranks):
    def encode(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own, known, rows = ranks.value, {}, []
        for block, data in zip(table["block"].to_pylist(), table["words"].to_pylist()):
            found = []
            for w in _unpack_words(data):
                if (ids := known.get(w)) is None:
                    ids = known[w] = merge_word(w, own)
                found.append(ids)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
            rows.append((block, key[0].as_py(), pack(flat), pack(sizes)))
        return pa.Table.from_batches([_batch(_WORDS, rows)])

    return encode


def _assembler(pieces, out_col: str | None):
    """A block's documents from its positions and the ids of its words; with pieces, their bytes too."""

    def assemble(key: tuple[pa.Scalar, ...], streams: pa.Table, encoded: pa.Table) -> pa.Table:
        (head,) = streams.to_pylist()
        out = _documents(head, encoded)
        columns = {"doc_id": pa.array(head["ids"], pa.int64()), "token_ids": pa.array(out, pa.binary())}
        if out_col is not None:
            columns[out_col] = _bytes_of(out, pieces.value)
        return pa.table(columns)

    return assemble


def _documents(head: dict, encoded: pa.Table) -> list[bytes]:
    parts = sorted(encoded.to_pylist(), key=lambda r: r["shard"])
    # Shards list their words in order of rank: the stable sort that sent them finds them again.
    order = np.argsort(unpack(head["homes"]), kind="stable")
    grouped = np.concatenate([unpack(r["sizes"]) for r in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
    if len(order) != len(grouped):
        raise ValueError("the two scans disagree: the input changes between reads; pass replayable=False")
    ids = np.concatenate([unpack(r["words"]) for r in parts] or [np.zeros(0, np.uint32)])
    starts, sizes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    starts[order], sizes[order] = np.cumsum(grouped) - grouped, grouped
    stream, counts = unpack(head["stream"]), unpack(head["counts"]).astype(np.int64)
    out, at = [], 0
    for n in counts.tolist():
        own = stream[at : at + n]
        at += n
        out.append(ids[ragged(starts[own], sizes[own])].astype("<u4").tobytes() if n else b"")
    return out


def _bytes_of(packed: list[bytes | None], pieces: dict[int, bytes]) -> pa.Array:
    """What ids stand for, null for null."""
    piece = pieces.__getitem__
    return pa.array((None if x is None else b"".join(map(piece, np.frombuffer(x, "<u4").tolist())) for x in packed), pa.binary())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shards: int | None = None, replayable: bool = True, decoded: str | None = None) -> DataFrame:
    """Token ids of every document: doc_id, token_ids (little-endian unsigned 32-bit integers).

    decoded: the name of a further column, the bytes that decode() makes of the ids. They are made where
    the ids are, so a task holds one Python worker instead of one for each of the two steps.

    One row comes out for each row that goes in, also for repeated rows and null ids. A null or
    empty text has no ids. Other columns are ignored, whatever their names. Ids are integers: a
    text id that is none is an error. Every single byte must have a rank. replayable: docs reads
    files, so that two scans see the same rows in the same tasks; anything else (a shuffle's
    output) is written to the shared folder first with replayable=False.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(ranks)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not replayable:
        source = materialize(source)
    parts = PARTS * scan_parts(source)
    shards = shards or SHARDS * parts
    words = source.mapInArrow(_splitter(pattern, shards, block_bytes, False), _WORDS)
    encoded = words.repartition(parts, "shard").groupBy("shard").applyInArrow(_shard_encoder(table), _WORDS)
    streams = source.mapInArrow(_splitter(pattern, shards, block_bytes, True), _STREAM)
    both = streams.repartition(parts, "block").groupBy("block").cogroup(encoded.repartition(parts, "block").groupBy("block"))
    pieces = None if decoded is None else _pieces(spark, ranks)
    return both.applyInArrow(_assembler(pieces, decoded), "doc_id long, token_ids binary" + (f", `{decoded}` binary" if decoded else ""))


def _pieces(spark: SparkSession, ranks: dict[bytes, int]):
    if len(ranks) > MAX_TOKENS:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_TOKENS} are broadcast")
    return spark.sparkContext.broadcast({i: b for b, i in ranks.items()})


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that a row's ids stand for: a map-side join with the token-byte table.

    The table holds one entry a token of the vocabulary, at most MAX_TOKENS, whatever the corpus.
    Null ids give null, no ids no bytes; an id outside the table is an error. Repeated rows each
    come out; an input column of the added name is replaced.
    """
    table = _pieces(encoded.sparkSession, ranks)

    def run(batches):
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("row"), _bytes_of(batch.column("ids").to_pylist(), table.value)], ["row", out_col])

    return extend(encoded, {"ids": F.col(ids_col)}, f"`{out_col}` binary", run)


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def ids_array(encoded: DataFrame, ids_col: str = "token_ids", out_col: str = "ids") -> DataFrame:
    """Add the ids as array<int>, for readers that want numbers; null for null. An input column of the name is replaced."""

    def run(batches):
        for batch in _slices(batches):
            out = [None if x is None else np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.list_(pa.int32()))], ["row", out_col])

    return extend(encoded, {"packed": F.col(ids_col)}, f"`{out_col}` array<int>", run)


def digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per row: doc_id, number of ids, SHA-256 of the ids, SHA-256 of the bytes decoded from them.

    Null and empty texts have no ids and the digests of nothing; repeated rows and null ids each
    come out, one row for one.
    """
    both = encode(docs, ranks, pattern, decoded="decoded")
    return both.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
