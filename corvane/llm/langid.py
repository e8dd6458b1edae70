"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. It reads a document greedily:
as long as the phrase so far occurs somewhere in the labelled text, it goes on (longest match);
else a new phrase starts. The language that needs the fewest phrases, each counted at the bits of
a pointer into its labelled text (and a character that this lacks at those of a code point), wins. The automata come from a bounded sample of pieces of all
labelled documents, long and short (SAMPLE_CHARS a language), so they have a fixed size and go to
every task; every whole document is parsed.

Documents are read in lanes of LANE characters, all lanes of a batch in step, so that one table
lookup moves thousands of texts. Lanes begin with a guess of the state that the lane before
leaves, and are read again from the true one until both ways meet; so phrases cross lanes and the
counts are those of one pass over the whole text.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import extend

#: Characters of labelled text a language, and of a piece of it.
SAMPLE_CHARS, PIECE = 60_000, 2_000
#: Every task holds an automaton a language, so their number is checked.
MAX_LANGUAGES = 128
#: Characters read in one go.
LANE = 256
#: Characters of text handled at a time.
BATCH_CHARS = 2_000_000
#: An automaton is laid out as a full table in a task if that takes no more; else it is searched.
TABLE_BYTES = 32 << 20
#: Bits of a character that a language's sample lacks; so a tiny sample is no cheap one.
LITERAL = log2(0x110000)
UNKNOWN = "und"


@cache
def _fold() -> np.ndarray:
    """Code point to code point: letters lower-cased (where that is one character), all else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha() or unicodedata.category(ch)[0] == "M":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def normalise(text: str, fold: np.ndarray) -> np.ndarray:
    """Lower-case letters, with one space for each run of anything else, and one at either end."""
    codes = fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def suffix_automaton(codes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (state, code, next state) of the suffix automaton of a text, sorted; 0 is the start.

    A text of n characters has fewer than 2n states and 3n transitions, whatever its alphabet.
    """
    link, length, ways, last = [-1], [0], [{}], 0
    for c in codes:
        now = len(link)
        length.append(length[last] + 1)
        link.append(0)
        ways.append({})
        p = last
        while p != -1 and c not in ways[p]:
            ways[p][c] = now
            p = link[p]
        if p != -1:
            q = ways[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(link)
                length.append(length[p] + 1)
                link.append(link[q])
                ways.append(dict(ways[q]))
                while p != -1 and ways[p].get(c) == q:
                    ways[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    flat = np.array([(s, c, t) for s, own in enumerate(ways) for c, t in sorted(own.items())], np.int64).reshape(-1, 3)
    return flat[:, 0], flat[:, 1], flat[:, 2]


class Model:
    """Automata by language, each over its own alphabet; code 0 stands for characters that its sample lacks."""

    def __init__(self, samples: dict[str, list[str]]):
        if len(samples) > MAX_LANGUAGES:
            raise ValueError(f"{len(samples)} languages; at most {MAX_LANGUAGES} go to every task")
        fold = _fold()
        texts = {lang: np.concatenate([normalise(t, fold) for t in own]) for lang, own in sorted(samples.items())}
        texts = {lang: t for lang, t in texts.items() if (t != 32).any()}
        self.langs = list(texts)
        self.bits = np.array([log2(len(t)) for t in texts.values()])
        self.alphabets = [np.unique(t) for t in texts.values()]
        #: (key = state * width + code, next state) in order of the keys.
        self.ways = []
        for t, letters in zip(texts.values(), self.alphabets):
            state, code, after = suffix_automaton((np.searchsorted(letters, t) + 1).tolist())
            self.ways.append((state * (len(letters) + 1) + code, after.astype(np.int32)))


class _Steps:
    """One step of many readers: next state * 2, plus 1 where no way led on and a new phrase began."""

    def __init__(self, keys: np.ndarray, after: np.ndarray, width: int, table_bytes: int):
        self.width, self.keys, self.after = width, keys, after
        # From the start: where no way leads on, the next phrase begins at the same character.
        self.fresh = np.zeros(width, np.int32)
        first = keys < width
        self.fresh[keys[first]] = after[first]
        states = int(after.max(initial=0)) + 1
        self.table = None
        if states * width * 4 <= table_bytes:
            self.table = np.tile(self.fresh * 2 + 1, states)
            self.table[keys] = after * 2

    def __call__(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state * np.int32(self.width) + code]
        key = state.astype(np.int64) * self.width + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.after[at] * 2, self.fresh[code] * 2 + 1)


class Parser:
    """Phrase counts of texts under each language of a model."""

    def __init__(self, model: Model, table_bytes: int = TABLE_BYTES):
        self.model, self.fold = model, _fold()
        self.letters = np.unique(np.concatenate([np.array([32], np.uint32), *model.alphabets]))
        self.code = np.zeros(0x110000, np.int32)
        self.code[self.letters] = np.arange(1, len(self.letters) + 1)
        self.own, self.steps = [], []
        for letters, (keys, after) in zip(model.alphabets, model.ways):
            own = np.zeros(len(self.letters) + 1, np.uint16 if len(letters) < 1 << 16 else np.int32)
            own[self.code[letters]] = np.arange(1, len(letters) + 1)
            self.own.append(own)
            self.steps.append(_Steps(keys, after, len(letters) + 1, table_bytes))

    def phrases(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """[text, language] counts of phrases, and of characters that the language's sample lacks."""
        flat = self.code[np.concatenate(texts)]
        sizes = np.array([len(t) for t in texts])
        lanes = _Lanes(flat, sizes, int(self.code[32]))
        out, lacking = np.zeros((len(texts), len(self.steps))), np.zeros((len(texts), len(self.steps)))
        for k, (own, step) in enumerate(zip(self.own, self.steps)):
            codes = own[lanes.codes]
            out[:, k] = 1 + lanes.by_text(lanes.read(step, codes) & 1)
            lacking[:, k] = lanes.by_text(codes == 0)
        return out, lacking


class _Lanes:
    """Texts cut into lanes, the longest first: codes [place, lane], padded with spaces."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, space: int):
        count = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(LANE, np.repeat(sizes, count) - nth * LANE)
        start = np.repeat(np.cumsum(sizes) - sizes, count) + nth * LANE
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.owner, self.length, self.texts = owner[order], length[order], len(sizes)
        #: The lane before in the text, or -1; and how many lanes go on at each place.
        self.before = np.where(nth > 0, place[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order]
        self.active = np.searchsorted(-self.length, -np.arange(LANE), side="left")
        at = start[order] + np.arange(int(self.length[0]))[:, None]
        inside = np.arange(int(self.length[0]))[:, None] < self.length
        self.codes = np.where(inside, flat[np.minimum(at, len(flat) - 1)], space)

    def by_text(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, values.sum(axis=0, dtype=np.int64), self.texts)

    def read(self, step: _Steps, codes: np.ndarray) -> np.ndarray:
        """What step() gives at each place, read from the first one of each text; 0 in the padding."""
        went = np.zeros(codes.shape, np.int32)
        lanes = np.arange(codes.shape[1])
        enter, state = np.zeros(len(lanes), np.int32), np.zeros(len(lanes), np.int32)
        for i in range(len(codes)):
            n = self.active[i]
            went[i, :n] = new = step(state[:n], codes[i, :n])
            state = new >> 1
        rounds = 0
        while True:
            left = went[self.length - 1, lanes] >> 1
            true = np.where(self.before >= 0, left[self.before], 0)
            todo = np.flatnonzero(true != enter)
            if not len(todo):
                return went
            rounds += 1
            if rounds > 3:
                # Texts whose ways don't meet (long repetitions) go on lane by lane, each from a true state.
                settled = (true == enter)[self.before[todo]] | (self.before[todo] < 0)
                todo = todo[settled]
            enter[todo] = true[todo]
            state, lane, i = true[todo], todo, 0
            while len(lane):
                new = step(state, codes[i, lane])
                met = went[i, lane] >> 1 == new >> 1
                went[i, lane] = new
                i += 1
                more = ~met & (i < self.length[lane])
                state, lane = (new >> 1)[more], lane[more]


def _chosen(id_: Column, text: Column, share: Column) -> Column:
    """array<struct<h, piece>>: the pieces of a text whose hash lies in the share [0, 1] of all hashes.

    The hash hangs on the id, the text and the place, so copies are separate and no piece comes with all.
    """
    places = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / PIECE).cast("int"))

    def of(mark: Column) -> Column:
        hashed = F.transform(places, lambda k: F.struct(F.xxhash64(mark, k).alias("h"), k.alias("k")))
        low = F.filter(hashed, lambda s: F.shiftrightunsigned(s["h"], 11) < share * float(1 << 53))
        return F.transform(low, lambda s: F.struct(s["h"].alias("h"), F.substring(text, s["k"] * PIECE + 1, F.lit(PIECE)).alias("piece")))

    # The lambda's variable holds the text's hash, so it is computed once a row.
    return F.flatten(F.transform(F.array(F.xxhash64(id_, text)), of))


def sample_pieces(labelled: DataFrame, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Pieces of labelled text a language, in order of a hash, until `chars` characters are there.

    labelled: doc_id, text, lang. Every document with text and language takes part by its pieces of
    PIECE characters, whatever its length; a language with less text gives all of it. Which pieces
    come hangs on ids and texts alone. Equal rows (id and text) count once. One pass sums the
    characters, a second one brings about twice the sample to the driver; a share that proves too
    small is doubled.
    """
    spark = labelled.sparkSession
    rows = labelled.where((F.length("text") > 0) & F.col("lang").isNotNull())
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; at most so many go to every task")
    share = {lang: min(1.0, 2 * (chars + 2 * PIECE) / n) for lang, n in totals.items()}
    out: dict[str, list[str]] = {}
    while share:
        shares = spark.createDataFrame(sorted(share.items()), "lang string, share double")
        drawn = rows.join(F.broadcast(shares), "lang").select("lang", F.explode(_chosen(F.col("doc_id"), F.col("text"), F.col("share"))).alias("p")).select("lang", "p.h", "p.piece").distinct()
        found: dict[str, list[tuple[int, str]]] = {lang: [] for lang in share}
        for r in drawn.collect():
            # Ascending as unsigned numbers, as the shares are cut.
            found[r["lang"]].append((r["h"] % (1 << 64), r["piece"]))
        for lang, own in found.items():
            if share[lang] < 1 and sum(len(p) for _, p in own) < chars:
                continue
            out[lang], n = [], 0
            for _, piece in sorted(own):
                if n < chars:
                    out[lang].append(piece)
                    n += len(piece)
        share = {lang: min(1.0, 2 * s) for lang, s in share.items() if lang not in out}
    return out


def train(labelled: DataFrame, chars: int = SAMPLE_CHARS) -> Model:
    """Automata from a sample of the rows with text and language; no such rows: a model that knows none."""
    return Model(sample_pieces(labelled, chars))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the language with the fewest bits of phrases, and how clearly it wins (0 to 1).

    The score is 1 - best / second best bits, and 1 if only one language is known. Texts that are
    null or have no letter, and all texts under a model without languages, get 'und' and 0. Equal
    bits go to the language first by code point. Repeated rows each come out; input columns of the
    two names are replaced; keep names those that come out (all). A task holds some 30 bytes a character of its longest text.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        parser, m = Parser(held.value), held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs: list[str] = [UNKNOWN] * len(texts)
            scores = [0.0] * len(texts)
            part: list[np.ndarray] = []
            where: list[int] = []

            def flush():
                if not part:
                    return
                count, lacking = parser.phrases(part)
                bits = count * m.bits + lacking * LITERAL
                best = bits.argmin(axis=1)
                for row, i, k in zip(bits, where, best.tolist()):
                    langs[i] = m.langs[k]
                    scores[i] = 1.0 - float(row[k] / np.partition(row, 1)[1]) if len(row) > 1 else 1.0
                part.clear()
                where.clear()

            size = 0
            for i, text in enumerate(texts):
                if not text or not m.langs:
                    continue
                codes = normalise(text, parser.fold)
                if len(codes) < 2 or not any(map(str.isalpha, text)):
                    continue
                part.append(codes)
                where.append(i)
                size += len(codes)
                if size >= BATCH_CHARS:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", lang_out, score_out])

    return extend(docs, {"text": text_col}, f"`{lang_out}` string, `{score_out}` double", run, keep)


def evaluate(docs: DataFrame, chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: train on the documents that are not held out, predict all.

    Held out are ids whose crc32 (of their digits; a null id: of nothing) is divisible by 5. Rows
    with null text or language teach nothing; null, empty and letterless texts get 'und'. Repeated
    rows each come out and count once in training; ids of any type are allowed.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 0
    model = train(docs.where(~out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), chars)
    marked = docs.select("doc_id", out.alias("held_out"), "text")
    return predict(marked, model, keep=["doc_id", "held_out"])
