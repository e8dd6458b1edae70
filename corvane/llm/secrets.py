"""Secret scans with a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived that every match must satisfy.
Documents are indexed in segments (bounded blocks of a partition): one pass over the bytes of a
segment gives sorted postings (documents by trigram) of all trigrams that any rule asks for. A
rule intersects and unites postings as its query says and runs its pattern only over the
candidates; a rule without mandatory trigrams scans every document. Segments are independent, so
nothing is shuffled and memory is bounded by a segment and its longest document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import blocks, extend, quoted

#: UTF-8 bytes of text in a segment of the index.
SEGMENT_BYTES = 4 << 20
#: Alternatives followed at a time while deriving a query; beyond, the pattern is cut there.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group and length: a match counts if that group has as many characters."""

    kind: str
    pattern: str
    group: int = 0
    length: int = 0
    any_case: bool = False

    def compile(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The three kinds that the contract fixes, in its order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # The runs [0-9a-f]+ of 24 characters and more, without stopping at each shorter one.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: A line's end, as such or escaped as in JSON, with what quotes or indents the next line.
_NEXT = r"[ \t]*(?:[\r\n]|\\[rn])(?:[\s>]|\\[nrt])*"
#: The line is base64 as a whole, or begins with a long piece of it.
_LINE = _NEXT + r"""(?:[A-Za-z0-9+/=]{24,}|[A-Za-z0-9+/=]+(?=[ \t]*(?:[\r\n\\"']|\Z)))"""
#: What follows a key's first line: all up to END where no other block comes before; or else its
#: base64 lines, after headers if any; or else pieces as long as lines and one more, on one line.
_KEY_BODY = (
    r"[^-]*+(?:-{1,4}+(?!-)[^-]*+)*+-----END [A-Z ]{0,32}PRIVATE KEY-----"
    rf"|(?:{_NEXT}[A-Z][A-Za-z-]*:[^\r\n\\]*)*(?:{_LINE})+"
    r"|(?:[ \t]*[A-Za-z0-9+/=]{40,})+(?:[ \t]+[A-Za-z0-9+/=]+)?"
)
#: Further kinds of well-known form.
MORE_RULES = (
    Rule("private_key", rf"-----BEGIN [A-Z ]{{0,32}}PRIVATE KEY-----(?:{_KEY_BODY})?"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is True (any text), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple


def _both(op: str, queries: list[Query]) -> Query:
    if op == "and":
        queries = [q for q in queries if q is not True]
        return True if not queries else queries[0] if len(queries) == 1 else ("and", tuple(dict.fromkeys(queries)))
    if any(q is True for q in queries):
        return True
    return queries[0] if len(queries) == 1 else ("or", tuple(dict.fromkeys(queries)))


def _of_strings(strings: set[bytes]) -> Query:
    """What holds if one of the strings occurs; a string that contains another adds nothing."""
    strings = {s for s in strings if not any(o != s and o in s for o in strings)}
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(items) -> tuple[set[bytes] | None, Query]:
    """(all strings that items can match, or None if there are many; what any match requires)."""
    now: set[bytes] = {b""}
    whole, needs = True, []
    for op, arg in items:
        strings, query = _item(op, arg)
        joined = None if strings is None else {a + b for a in now for b in strings}
        if joined is None or len(joined) > MAX_STRINGS:
            needs += [_of_strings(now), query if strings is None else _of_strings(strings)]
            now, whole = {b""}, False
        else:
            now = joined
    if whole:
        return now, True
    return None, _both("and", [*needs, _of_strings(now)])


def _item(op, arg) -> tuple[set[bytes] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).encode().lower()}, True
    if op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
        return {chr(c).encode().lower() for _, c in arg}, True
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {b""}, True
    if op is sre.SUBPATTERN:
        return _walk(arg[-1])
    if op is sre.BRANCH:
        found = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in found):
            return set().union(*(s for s, _ in found)), True
        return None, _both("or", [q if s is None else _of_strings(s) for s, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, sub = arg
        strings, query = _walk(sub)
        if strings is not None and most == 1:
            return (strings if least else strings | {b""}), True
        if least == 0:
            return None, True
        return None, query if strings is None else _of_strings(strings)
    return None, True


def trigram_query(pattern: str) -> Query:
    """The Boolean query over trigrams of lower-cased UTF-8 text that every match satisfies."""
    strings, query = _walk(_parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


def candidates(query: Query, index: dict[bytes, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Ordinals of a segment's documents whose trigrams satisfy the query."""
    if query is True:
        return everything
    if isinstance(query, bytes):
        return index[query]
    parts = [candidates(q, index, everything) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


class Index:
    """Sorted postings of the wanted trigrams over the lower-cased bytes of a segment's documents."""

    def __init__(self, wanted: set[bytes]):
        self.wanted = sorted(wanted)
        self.flag = np.zeros(1 << 24, bool)
        self.flag[[_code(g) for g in self.wanted]] = True

    def postings(self, texts: list[str]) -> dict[bytes, np.ndarray]:
        # 0xFF is in no UTF-8 text, so no wanted trigram reaches over a document's end.
        parts = [t.encode().lower() for t in texts]
        data = np.frombuffer(b"\xff".join([*parts, b"\xff"]), np.uint8).astype(np.int32)
        codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        at = np.flatnonzero(self.flag[codes])
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
        pairs = np.unique(codes[at].astype(np.int64) * (len(texts) + 1) + np.searchsorted(ends, at, side="right"))
        keys = np.array([_code(g) for g in self.wanted], np.int64) * (len(texts) + 1)
        low, high = np.searchsorted(pairs, keys), np.searchsorted(pairs, keys + len(texts) + 1)
        return {g: pairs[i:j] - k for g, i, j, k in zip(self.wanted, low, high, keys)}


class Scanner:
    """The rules' patterns, their trigram queries and the index that answers them."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(k, r, r.compile(), trigram_query(r.pattern)) for k, r in enumerate(rules)]
        self.index = Index(set().union(*(trigrams(q) for *_, q in self.rules)))

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each text, by start, then by the order of the rules."""
        postings = self.index.postings(texts)
        everything = np.arange(len(texts))
        found: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
        for k, rule, pattern, query in self.rules:
            for i in candidates(query, postings, everything).tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.length:
                        found[i].append((m.start(), k, rule.kind, m.end()))
        return [[(kind, start, end) for start, _, kind, end in sorted(f)] for f in found]


def _finder(rules: tuple[Rule, ...], bytes_: int, out: str):
    def run(batches):
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for _, table in blocks(batches, "text", bytes_):
            spans = scanner.spans([t or "" for t in table["text"].to_pylist()])
            rows = [[{"kind": a, "start": b, "end": c} for a, b, c in s] for s in spans]
            yield from table.select(["row"]).append_column(out, pa.array(rows, kind)).combine_chunks().to_batches()

    return run


def scan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, segment_bytes: int = SEGMENT_BYTES, spans_out: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """Add spans: array<struct<kind, start, end>> of every row's whole text.

    Positions are code points, the end exclusive; spans are sorted by start, then by the order of
    the rules. Matches of a rule are the leftmost that don't overlap; those of different rules may.
    Null and empty texts have no spans. Repeated rows each come out; an input column of the added
    name is replaced; keep names those that come out (all).
    """
    added = f"`{spans_out}` array<struct<kind: string, start: int, end: int>>"
    return extend(docs, {"text": text_col}, added, _finder(rules, segment_bytes, spans_out), keep)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    Null and empty texts have none, and the digest of nothing; repeated rows each come out, and ids
    may be null or of any type.
    """
    found = scan(docs, keep=["doc_id"])
    kinds = [r.kind for r in BASE_RULES]
    count = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in kinds]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with one [SECRET] for each span; overlapping spans count as one."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The rows with each secret's characters replaced by one [SECRET]; overlapping spans count as one.

    Every row comes out, repeated ones too, with its columns in their order; null and empty texts
    stay as they are. The work is linear in the length of a text.
    """

    def run(batches):
        scanner = Scanner(rules)
        for _, table in blocks(batches, "text", segment_bytes):
            texts = table["text"].to_pylist()
            spans = scanner.spans([t or "" for t in texts])
            clean = [redacted(t, s) if s else t for t, s in zip(texts, spans)]
            yield from table.select(["row"]).append_column(text_col, pa.array(clean, pa.string())).combine_chunks().to_batches()

    return extend(docs, {"text": text_col}, f"`{text_col}` string", run).select(*[quoted(c) for c in docs.columns])
