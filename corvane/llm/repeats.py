"""Runs: maximal periodic stretches of words within a document, by partition refinement.

Positions of a document start in classes of equal words, and are refined length by length: the
classes of length l + 1 are those of length l, split by the class of the next position. As all
members of a class had their next positions in one class before, only the parts that split off
count, and of the parts of a class the largest need not be looked at (the smaller halves): so a
position is looked at log n times. Each class also keeps its members in order. Two neighbours at
a distance equal to the length are a square with a root that is no power itself; squares of one
period that begin at consecutive positions are one run.

Blocks of documents are refined together, so that a step is a handful of array operations: their
first classes are (document, word), and each document ends in a word of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import blocks, ragged

#: Bytes of text refined together (and the document that passes them).
BLOCK = 4 << 20

_NONE = -1


class Classes:
    """Classes of positions, each a stretch of one array, with the members linked in order."""

    def __init__(self, first: np.ndarray):
        """first: the class of each position, numbered from 0 without gaps."""
        n = len(first)
        self.of = first.copy()
        self.slots = np.argsort(first, kind="stable")
        self.slot = np.empty(n, np.int64)
        self.slot[self.slots] = np.arange(n)
        sizes = np.bincount(first)
        # Room for all classes there can be: one a position.
        self.size, self.low = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.size[: len(sizes)] = sizes
        self.low[: len(sizes)] = np.cumsum(sizes) - sizes
        self.count = len(sizes)
        self.next, self.before = np.full(n, _NONE, np.int64), np.full(n, _NONE, np.int64)
        near = first[self.slots[:-1]] == first[self.slots[1:]]
        self.next[self.slots[:-1][near]] = self.slots[1:][near]
        self.before[self.slots[1:][near]] = self.slots[:-1][near]
        self.marked = np.zeros(n, bool)

    def members(self, classes: np.ndarray) -> np.ndarray:
        """Positions of the classes, one class after the other."""
        return self.slots[ragged(self.low[classes], self.size[classes])]

    def splits(self, at: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What to move when each position of at splits off by the key beside it.

        (positions, part of each): parts are numbered by class, and the largest part of a class
        stays; those of its positions that at does not name are a part too.
        """
        order = np.lexsort((by, self.of[at]))
        at, by, of = at[order], by[order], self.of[at[order]]
        starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (by[1:] != by[:-1])]))
        sizes = np.diff(np.append(starts, len(at)))
        own = of[starts]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        groups = np.diff(np.append(first, len(own)))
        total = np.add.reduceat(sizes, first)
        rest = self.size[own[first]] - total
        largest = np.maximum.reduceat(sizes, first)
        # Where the positions not named are fewer than the largest part, they move instead of it.
        turned = (rest < largest) & ((rest > 0) | (groups > 1))
        stays = (rest == 0) & (groups == 1)
        keep = np.repeat(~stays, groups)
        if turned.any():
            # The first of the largest groups of each turned class.
            score = np.where(sizes == np.repeat(largest, groups), np.arange(len(sizes)), len(sizes))
            keep[np.minimum.reduceat(score, first)[turned]] = False
        part = np.repeat(np.cumsum(keep) - 1, sizes)
        moved = np.repeat(keep, sizes)
        positions, parts = at[moved], part[moved]
        whole = own[first][turned & (rest > 0)]
        if len(whole):
            self.marked[at] = True
            others = self.members(whole)
            others = others[~self.marked[others]]
            self.marked[at] = False
            number = np.cumsum(np.concatenate([[True], self.of[others[1:]] != self.of[others[:-1]]])) - 1
            positions = np.concatenate([positions, others])
            parts = np.concatenate([parts, number + (parts.max(initial=_NONE) + 1)])
        return positions, parts

    def move(self, positions: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Give each part a class of its own: (positions whose next may differ, their next before)."""
        # In order of the old class and position: stretches of neighbours leave together.
        order = np.lexsort((positions, self.of[positions]))
        p, old = positions[order], self.of[positions[order]]
        joined = self.next[p[:-1]] == p[1:]
        heads, tails = p[np.concatenate([[True], ~joined])], p[np.concatenate([~joined, [True]])]
        left, right = self.before[heads], self.next[tails]
        touched = np.concatenate([left[left != _NONE], positions])
        was = self.next[touched]
        here, there = left != _NONE, right != _NONE
        self.next[left[here]] = right[here]
        self.before[right[there]] = left[there]
        self._to_tail(p, old)
        order = np.lexsort((positions, parts))
        q, part = positions[order], parts[order]
        # The tail of each class holds what leaves it: lay the parts out there, in order.
        by_class = np.argsort(self.of[q], kind="stable")
        q, part, of = q[by_class], part[by_class], self.of[q[by_class]]
        begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        gone = np.diff(np.append(begins, len(q)))
        classes = of[begins]
        room = ragged(self.low[classes] + self.size[classes] - gone, gone)
        self.slots[room], self.slot[q] = q, room
        self.size[classes] -= gone
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.diff(np.append(starts, len(q)))
        new = self.count + np.arange(len(starts))
        self.count += len(starts)
        self.of[q] = np.repeat(new, sizes)
        self.low[new], self.size[new] = room[starts], sizes
        same = part[1:] == part[:-1]
        self.next[q], self.before[q] = _NONE, _NONE
        self.next[q[:-1][same]], self.before[q[1:][same]] = q[1:][same], q[:-1][same]
        return touched, was

    def _to_tail(self, p: np.ndarray, old: np.ndarray) -> None:
        """Swap the positions (sorted by class) into the last slots of their classes."""
        begins = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        gone = np.diff(np.append(begins, len(p)))
        high = self.low[old[begins]] + self.size[old[begins]]
        room = ragged(high - gone, gone)
        self.marked[p] = True
        displaced = self.slots[room]
        displaced = displaced[~self.marked[displaced]]
        self.marked[p] = False
        outside = self.slot[p[self.slot[p] < np.repeat(high - gone, gone)]]
        # Both are in order of classes, and as many in each.
        self.slots[outside], self.slot[displaced] = displaced, outside


def squares(first: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, period) of all squares whose root is no power, up to a period for each position.

    first: classes of the positions' words, where the last position of each document has a class
    of its own. limit is the same for all positions of a document.
    """
    classes = Classes(first)
    born = np.ones(len(first), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def emit(at: np.ndarray, after: np.ndarray, last: np.ndarray | int) -> None:
        """Neighbours that were so at the length of their distance, up to the length last."""
        at, gap = at[after != _NONE], (after - at)[after != _NONE]
        last = last[after != _NONE] if isinstance(last, np.ndarray) else last
        good = (born[at] <= gap) & (gap <= last)
        if good.any():
            found.append((at[good], gap[good]))

    # All words are new at first: any part but the largest of a document would do as well.
    small = np.arange(len(first))
    longest = int(limit.max(initial=0))
    length = 1
    while len(small) and length < longest:
        # A document that has reached its limit stays as it is.
        small = small[(small > 0) & (limit[small] > length)]
        at = small - 1
        live = classes.size[classes.of[at]] > 1
        at, small = at[live], small[live]
        if not len(at):
            break
        positions, parts = classes.splits(at, classes.of[small])
        length += 1
        if len(positions):
            touched, was = classes.move(positions, parts)
            changed = classes.next[touched] != was
            touched, was = touched[changed], was[changed]
            emit(touched, was, length - 1)
            born[touched] = length
        small = positions
    # What is left was never split again up to the limit of its document.
    rest = np.flatnonzero(classes.next != _NONE)
    emit(rest, classes.next[rest], limit[rest])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*found)))


def runs(words: list[list[bytes]], shortest: int, times: int) -> list[np.ndarray]:
    """Of each document the rows (start, length, period) of its runs, by start and then period.

    A run has a length of at least shortest words and times periods (two or more).
    """
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    first = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    limit = np.zeros(len(first), np.int64)
    base = 0
    for own, begin, end in zip(words, starts.tolist(), ends.tolist()):
        number = {w: k for k, w in enumerate(dict.fromkeys(own), base)}
        first[begin : end - 1] = list(map(number.__getitem__, own))
        base += len(number) + 1
        first[end - 1] = base - 1
        # Shorter documents have no run at all, and no period exceeds the length over times.
        limit[begin:end] = len(own) // times if len(own) >= shortest else 0
    begin, period = squares(first, limit)
    order = np.lexsort((begin, period))
    begin, period = begin[order], period[order]
    opens = np.concatenate([[True], (np.diff(begin) != 1) | (np.diff(period) != 0)]) if len(begin) else np.zeros(0, bool)
    at = np.flatnonzero(opens)
    count = np.diff(np.append(at, len(begin)))
    rows = np.stack([begin[at], count - 1 + 2 * period[at], period[at]], axis=1)
    rows = rows[rows[:, 1] >= np.maximum(shortest, times * rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], starts)
    out = np.split(rows, cuts[1:])
    return [r - [s, 0, 0] for r, s in zip(out, starts.tolist())]


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: a run keeps its first period, and a word goes if any run drops it."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def periodic_runs(docs: DataFrame, shortest: int = 24, times: int = 3, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs and collapsed (UTF-8) of every row's whole text.

    Words are runs of non-white-space (ASCII). A run is a stretch of at least shortest words and
    times periods that no neighbouring word extends; runs come by start, then period. collapsed
    is the text without the words that any run repeats after its first period, joined by spaces.
    rewrite gets a row's id and words and gives the words to look at. Null and empty texts have no
    words and no runs; repeated rows and null ids each come out; other columns are ignored.
    """
    if times < 2 or shortest < 1:
        raise ValueError("a run has two periods and one word at least")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in blocks(batches, "text", BLOCK):
            words = [t.split() if t else [] for t in block.column("text").cast(pa.large_binary()).to_pylist()]
            if rewrite is not None:
                words = [rewrite(i, w) for i, w in zip(block.column("doc_id").to_pylist(), words)]
            found = runs(words, shortest, times)
            texts = [b" ".join([w for w, k in zip(own, kept(len(own), r).tolist()) if k] if len(r) else own) for own, r in zip(words, found)]
            flat = np.concatenate(found)
            stretches = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32()), stretches)
            columns = [block.column("doc_id").combine_chunks(), pa.array([len(w) for w in words], pa.int64()), lists, pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {RUNS}")
