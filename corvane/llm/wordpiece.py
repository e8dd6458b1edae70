"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's trie has two roots: pieces that start a word, and pieces that continue one. A
node that cannot be extended has a failure link to where matching goes on once the longest
pieces of its string are popped, and the number of those pieces is precomputed. So a word is
read once, byte by byte, and its greedy longest-match length comes out without building pieces.
Every task holds the automaton (its size is the vocabulary's) and remembers words it has seen.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import WORD

#: Words remembered by a task before it starts afresh.
MEMORY = 300_000


def vocabulary(ranks: dict[bytes, int]) -> tuple[set[bytes], set[bytes]]:
    """(pieces that start a word, pieces that continue one) from byte-level tokens.

    Tokens with a leading space start words, without it; those without continue them. Where no
    token with a space fits a word's beginning, the longest of the others starts it: so any word
    is spelled out, in scripts too that have no token with a space.
    """
    spaced = {t[1:] for t in ranks if t[:1] == b" " and len(t) > 1}
    inside = {t for t in ranks if t[:1] != b" "}
    # A piece that begins with a spaced one never starts a word: the spaced one fits there.
    others = {t for t in inside if not any(t[:n] in spaced for n in range(1, len(t) + 1))}
    return spaced | others, inside


class Automaton:
    """steps maps node << 8 | byte to a node; fail and pops are a node's failure link and pieces popped."""

    START, INSIDE = 0, 1

    def __init__(self, first: set[bytes], inside: set[bytes]):
        steps: dict[int, int] = {}
        final = [False, False]
        level: list[tuple[int, int, int]] = []
        depth_of: list[tuple[int, int, int, int]] = []
        for root, pieces in ((self.START, first), (self.INSIDE, inside)):
            for piece in pieces:
                node = root
                for depth, c in enumerate(piece):
                    nxt = steps.get(node << 8 | c)
                    if nxt is None:
                        nxt = steps[node << 8 | c] = len(final)
                        final.append(False)
                        depth_of.append((depth, nxt, node, c))
                    node = nxt
                if piece:
                    final[node] = True
        fail, pops = [-1] * len(final), [0] * len(final)
        level = [(n, parent, c) for _, n, parent, c in sorted(depth_of)]
        for node, parent, c in level:
            if final[node]:
                fail[node], pops[node] = self.INSIDE, 1
                continue
            z, count = fail[parent], pops[parent]
            while z != -1 and (z << 8 | c) not in steps:
                count += pops[z]
                z = fail[z]
            if z != -1:
                fail[node], pops[node] = steps[z << 8 | c], count
        self.steps, self.fail, self.pops = steps, fail, pops

    def count(self, word: bytes) -> int:
        """Number of pieces of a word; 1 (the unknown piece) if the greedy match gets stuck."""
        steps, fail, pops = self.steps, self.fail, self.pops
        node, n = self.START, 0
        for c in word:
            while (nxt := steps.get(node << 8 | c)) is None:
                n += pops[node]
                node = fail[node]
                if node == -1:
                    return 1
            node = nxt
        while node != self.INSIDE:
            n += pops[node]
            node = fail[node]
            if node == -1:
                return 1
        return n


def count_tokens(docs: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every row's whole text; 0 for null and empty texts.

    Words are runs of non-white-space. Repeated rows each come out; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        find, count, known = re.compile(WORD).findall, held.value.count, {}
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text").to_pylist():
                own = find(text) if text else []
                total = 0
                for w in own:
                    if (n := known.get(w)) is None:
                        if len(known) >= MEMORY:
                            known.clear()
                        n = known[w] = count(w.encode())
                    total += n
                words.append(len(own))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
