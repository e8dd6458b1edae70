"""Packing documents into windows by the sum-of-squares rule.

Each task packs the documents of its partition as they come: nothing is shuffled, and how far one
task has come never matters to another. A document goes as a whole into the fill level that leaves
the smallest sum of squared counts of partially filled windows; the counts of all levels are one
array. What is longer than a window fills windows by itself first, and only its rest is placed.
At the end, or when many windows are open, the open ones are poured together: the emptiest fill up
the fullest, cut where they must be, and what stays of the last is cut into powers of two. So no
window is ever padded, and all but a few documents are in as few pieces as their length allows.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import blocks, ragged

#: Words whose ids a task remembers before it starts afresh.
MEMORY = 400_000
#: Windows that a task keeps open; beyond that it pours them together.
OPEN = 2048
#: Pieces of a batch that a task gives out, and bytes of ids after which it is given out sooner.
ROWS, BYTES = 4096, 4 << 20
#: Bytes of texts encoded at a time (and the row that passes them).
BLOCK = 4 << 20

#: A piece: number of the document, start in it, ids.
Piece = tuple[int, int, np.ndarray]


def is_full(length: int, window: int) -> bool:
    """Whether a sequence needs no padding: it fills the window, or its length is a power of two."""
    return length == window or length & (length - 1) == 0


def powers(length: int) -> list[int]:
    """The powers of two that add up to a length, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Levels:
    """Open windows by how full they are, and the rule that chooses among them."""

    def __init__(self, window: int):
        self.window = window
        # counts[h]: open windows that hold h ids; empty and full ones do not count.
        self.counts = np.zeros(window + 1, np.int64)
        self.windows: dict[int, list[list[Piece]]] = {}
        self.open = 0

    def choose(self, size: int) -> int:
        """The level (0: a new window) that a piece of this size should go to.

        Moving a window from level h to h + size changes the sum of squares by
        2 * (counts[h + size] - counts[h]) + 2, without the terms of level 0 and of a full window.
        Of equal changes the fullest level is taken.
        """
        top = self.window - size
        change = 2 * (self.counts[size:] - self.counts[: top + 1]) + 2
        change[0] -= 1
        change[top] -= 1
        change[1:][self.counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece (1 to window ids) into a window; the window, if that is full now."""
        size = len(piece[2])
        level = self.choose(size)
        held: list[Piece] = []
        if level:
            held = self.windows[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        held.append(piece)
        if level + size == self.window:
            return held
        self.counts[level + size] += 1
        self.windows.setdefault(level + size, []).append(held)
        self.open += 1
        return None

    def pour(self) -> Iterator[list[Piece]]:
        """Close all open windows: none of those that come out needs padding."""
        left = [(h, w) for h in sorted(self.windows, reverse=True) for w in self.windows[h]]
        self.windows, self.open = {}, 0
        self.counts[:] = 0
        last = len(left) - 1
        first = 0
        while first < last:
            level, held = left[first]
            while level < self.window and first < last:
                depth, source = left[last]
                number, start, ids = source.pop()
                room = self.window - level
                if len(ids) > room:
                    source.append((number, start, ids[:-room]))
                    number, start, ids = number, start + len(ids) - room, ids[-room:]
                held.append((number, start, ids))
                level += len(ids)
                left[last] = (depth - len(ids), source)
                if not source:
                    last -= 1
            left[first] = (level, held)
            if level == self.window:
                yield held
                first += 1
        if first == last:
            level, held = left[first]
            if is_full(level, self.window):
                yield held
            else:
                yield from cut(held, powers(level))


def cut(pieces: list[Piece], lengths: list[int]) -> Iterator[list[Piece]]:
    """Sequences of the given lengths, which add up to what the pieces hold."""
    todo = pieces[::-1]
    for length in lengths:
        held = []
        while length:
            number, start, ids = todo.pop()
            if len(ids) > length:
                todo.append((number, start + length, ids[length:]))
                ids = ids[:length]
            held.append((number, start, ids))
            length -= len(ids)
        yield held


class Encoder:
    """Ids of whole texts by a tokenizer of words: each distinct word of a block is looked up once.

    White space ends a word for this kind of tokenizer (its pattern matches none, and it is not
    composed with what follows), so the ids of a text are those of its words in order. Words of
    plain letters are cut into the pattern's pieces, all at once, and only new pieces are merged.
    """

    #: Letters and marks that composing leaves alone and that have one lower-case letter each.
    PLAIN = "[!-~\xa1-\u012f\u0131-\u017f]"
    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

    def __init__(self, path: str):
        # Spark's tasks are what runs at once; threads of the library would only compete with them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        parts = json.loads(self.tokenizer.to_str())
        cut = parts["pre_tokenizer"].get("pretokenizers") or [{}]
        self.marks, self.spelling = "$^", {}
        if parts["normalizer"].get("normalizers") == self.NORMAL and cut[0].get("type") == "Split" and cut[0]["invert"] and [c["type"] for c in cut[1:]] == ["ByteLevel"]:
            self.marks = "|".join(re.escape(t["content"]) for t in parts["added_tokens"]) or "$^"
            self.split = regex.compile(cut[0]["pattern"]["Regex"] + "| ").findall
            # How the merges spell each letter: by the tokenizer itself.
            spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.spelling = {c: spell(chr(c))[0][0] for c in range(0x21, 0x180) if re.match(self.PLAIN, chr(c))}

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each): every piece has one id at least, a space none."""
        cut = self.split(" ".join([*words, ""]).lower())
        ids = list(map(self.pieces.get, cut))
        for i in [i for i, x in enumerate(ids) if x is None]:
            piece = cut[i]
            if (known := self.pieces.get(piece)) is None:
                found = self.tokenizer.model.tokenize(piece.translate(self.spelling))
                known = self.pieces[piece] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
            ids[i] = known
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.frombuffer(b"".join(ids), "<u4"), np.diff(np.cumsum(sizes)[sizes == 0], prepend=0)

    def _encoded(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
            ids = self.known[word] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts in them, lengths) of distinct words."""
        if len(self.known) > MEMORY:
            self.known.clear()
        if len(self.pieces) > MEMORY or not self.pieces:
            self.pieces = {" ": b""}
        plain, pieces = np.zeros(len(words), bool), np.zeros(0, "<u4")
        if self.spelling:
            plain = pc.and_not(pc.match_substring_regex(words, f"^{self.PLAIN}+$"), pc.match_substring_regex(words, self.marks)).to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(words), np.int64)
        if plain.any():
            pieces, lengths[plain] = self._plain(words.filter(pa.array(plain)).to_pylist())
        other = [self._encoded(w) for w in words.filter(pa.array(~plain)).to_pylist()]
        lengths[~plain] = [len(x) // 4 for x in other]
        starts = np.empty(len(words), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate([pieces, np.frombuffer(b"".join(other), "<u4")]), starts, lengths

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where those of each text end); a null text has none."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        ids, starts, sizes = self.words(coded.dictionary)
        which = coded.indices.to_numpy()
        lengths = sizes[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(pc.list_value_length(split).to_numpy())]
        return ids[ragged(starts[which], lengths)], ends


_PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of sequences of at most window ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is the ids of its text by the tokenizer's file, without special tokens, and end_id;
    null and empty texts are end_id alone. ids are little-endian unsigned 32-bit integers. Each id
    lies in one piece, and each sequence is full or of a power of two, so none needs padding.
    Repeated rows and null ids are documents of their own; other columns are ignored. The path
    must be one that tasks can read; sequence numbers are those of the task and its windows.
    """
    if window < 1:
        raise ValueError("a window holds one id at least")
    kind = docs.schema[id_col].dataType.simpleString()
    arrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, levels, last = Encoder(tokenizer), Levels(window), np.array([end_id], "<u4")
        base, made = TaskContext.get().partitionId() << 36, 0
        names: dict[int, tuple] = {}  # documents with ids that have not come out: id, tokens, ids left
        rows: list[tuple] = []
        size = number = 0
        schema = None

        def close(held: list[Piece]) -> None:
            nonlocal made, size
            at = 0
            for doc, start, ids in held:
                name, total, left = names[doc]
                rows.append((name, start, len(ids), ids.tobytes(), total, base + made, at))
                at += len(ids)
                size += 4 * len(ids)
                if left == len(ids):
                    del names[doc]
                else:
                    names[doc] = (name, total, left - len(ids))
            made += 1

        def out() -> pa.RecordBatch:
            nonlocal rows, size
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows, size = [], 0
            return batch

        for _, block in blocks(batches, "text", BLOCK):
            if schema is None:
                schema = pa.schema([("doc_id", block.schema.field("doc_id").type), *[(n, pa.int64()) for n in ("start", "length")], ("ids", pa.binary()), *[(n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset")]])
            found, ends = encode(block.column("text").combine_chunks())
            for name, begin, end in zip(block.column("doc_id").to_pylist(), [0, *ends.tolist()], ends.tolist()):
                ids = np.append(found[begin:end], last)
                names[number] = (name, len(ids), len(ids))
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    close([(number, start, ids[start : start + window])])
                    if size >= BYTES:
                        yield out()
                if whole < len(ids) and (held := levels.place((number, whole, ids[whole:].copy()))):
                    close(held)
                number += 1
                if levels.open > OPEN:
                    for held in levels.pour():
                        close(held)
                if len(rows) >= ROWS or size >= BYTES:
                    yield out()
        for held in levels.pour():
            close(held)
        if rows:
            yield out()

    return arrow.mapInArrow(run, f"doc_id {kind}, {_PIECE}")
