"""Language-model scoring by deleted interpolation.

P(w | v) = l2[b] c(v w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1), where b is the bucket of the
context's frequency c(v) and the weights l of each bucket come from expectation-maximisation on
counts held out of training: a tenth of the training documents is deleted, their tokens are
predicted from the counts of the rest, and the final model uses all counts with those weights.

Plan: blocks of documents send their distinct words and word pairs, with counts, to shards by
hash; a shard sums them over the corpus and answers each block in the block's own order. A second
scan sends the order of a block's tokens straight to that join. What results, a block's token
order with corpus counts, is written once: the held-out statistics and the scores both read it.
Held-out tokens reach the driver only as sums over a fixed grid of probabilities. A
frequent word travels once a block, so no key is hot.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import ASCII_LOWER, WORD, blocks, expand, materialize, pack, scan_parts, squeeze, unpack

#: UTF-8 bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Shuffle partitions a task of the scan, and shards a partition: both follow the input's bytes, so
#: that a task's and a group's share of the counts stay the same at every size.
PARTS, SHARDS = 2, 2
#: Buckets of context frequency: powers of two.
BUCKETS = 40
#: Steps of the histogram in an octave of probability, and its width on either axis.
STEPS, WIDTH = 4, 256
EM_ROUNDS = 60
#: Hashes of the end of a text and of the place before its first word.
END, BEGIN = xxhash.xxh64_intdigest(b"\n</s>"), xxhash.xxh64_intdigest(b"\n<s>")

_KEYS = "block long, shard long, level int, keys binary, total binary, held binary, fresh long"
_STREAM = "block long, words binary, stream binary, counts binary, ids array<long>"
_BOTH = "block long, stream binary, counts binary, ids array<long>, ones binary, twos binary, train_tokens long, held_tokens long, fresh long, cells array<long>, cell_counts array<long>, cell_shares array<double>, cell_words array<double>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their gaps."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return squeeze(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_keys(data: bytes) -> np.ndarray:
    raw = np.frombuffer(expand(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def role(doc_id: int | None) -> int:
    """0: held out of training, 1: training, 2: training, but deleted while weights are learned."""
    c = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    return 0 if c % 7 == 2 else 2 if c // 7 % 10 == 0 else 1


def _pair_codes(stream: np.ndarray, counts: np.ndarray, n_words: int) -> np.ndarray:
    """previous * n_words + current for every token; word 0 is END, 1 is BEGIN."""
    before = np.empty(len(stream), np.int64)
    before[1:] = stream[:-1]
    starts = np.cumsum(counts) - counts
    before[starts] = 1
    return before * n_words + stream


def _pair_keys(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mix(_mix(words[codes // len(words)]) + words[codes % len(words)])


class _Tokens:
    """A block's tokens as numbers of its distinct words."""

    def __init__(self, table: pa.Table, find):
        index: dict[str, int] = {}
        add = index.setdefault
        lines = []
        for text in table["text"].to_pylist():
            tokens = find(text.translate(ASCII_LOWER)) if text else []
            lines.append(np.fromiter([add(t, len(index) + 2) for t in tokens] + [0], np.int64, len(tokens) + 1))
        self.counts = np.array([len(x) for x in lines], np.int64)
        stream = np.concatenate(lines)
        rank = np.arange(len(index) + 2)
        order = np.argsort(-np.bincount(stream, minlength=len(rank))[2:], kind="stable") + 2
        rank[order] = np.arange(2, len(rank))
        words = np.array([END, BEGIN, *map(xxhash.xxh64_intdigest, index)], np.uint64)
        self.words = words[np.concatenate([[0, 1], order])]
        self.stream = rank[stream]
        self.ids = table["doc_id"].to_pylist()
        self.roles = np.array([role(i) for i in self.ids])


def _split(shards: int, block_bytes: int, order: bool):
    def run(batches):
        find = re.compile(WORD).findall
        for block, table in blocks(batches, "text", block_bytes):
            t = _Tokens(table, find)
            if order:
                yield _batch(_STREAM, [(block, squeeze(t.words.tobytes()), pack(t.stream), pack(t.counts), t.ids)])
                continue
            who = np.repeat(t.roles, t.counts)
            ones = np.arange(len(t.words))
            in_ones = [np.bincount(t.stream[who > 0], minlength=len(ones)), np.bincount(t.stream[who == 2], minlength=len(ones))]
            in_ones[0][1], in_ones[1][1] = (t.roles > 0).sum(), (t.roles == 2).sum()
            codes, where = np.unique(_pair_codes(t.stream, t.counts, len(t.words)), return_inverse=True)
            in_twos = [np.bincount(where[who > 0], minlength=len(codes)), np.bincount(where[who == 2], minlength=len(codes))]
            rows = _rows(block, 1, t.words, in_ones, shards) + _rows(block, 2, _pair_keys(codes, t.words), in_twos, shards)
            yield _batch(_KEYS, rows)

    return run


def _rows(block: int, level: int, keys: np.ndarray, counts: list[np.ndarray], shards: int) -> list[tuple]:
    """One row for each shard: equal shares of the key space, keys ascending."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    shard = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(keys)]
    return [(block, int(shard[i]), level, _pack_keys(keys[i:j]), pack(counts[0][order[i:j]]), pack(counts[1][order[i:j]]), 0) for i, j in zip(cuts, cuts[1:])]


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _sum_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Corpus counts for every block's keys, in the order they came. fresh counts distinct trained words once."""
    rows = table.to_pylist()
    keys = [_unpack_keys(r["keys"]) for r in rows]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, np.concatenate([unpack(r["total"]) for r in rows]), len(distinct)).astype(np.int64)
    held = np.bincount(where, np.concatenate([unpack(r["held"]) for r in rows]), len(distinct)).astype(np.int64)
    fresh = int(((total > 0) & (distinct != np.uint64(BEGIN))).sum()) if rows[0]["level"] == 1 else 0
    out, at = [], 0
    for r, own in zip(rows, keys):
        mine = where[at : at + len(own)]
        at += len(own)
        out.append((r["block"], r["shard"], r["level"], None, pack(total[mine]), pack(held[mine]), fresh))
        fresh = 0
    return pa.Table.from_batches([_batch(_KEYS, out)])


def _level(rows: list[dict], level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, held) in the order of keys, from answers in ascending order."""
    own = [r for r in rows if r["level"] == level]
    order = np.argsort(keys, kind="stable")
    out = []
    for name in ("total", "held"):
        values = np.concatenate([unpack(r[name]) for r in own]).astype(np.int64)
        if len(values) != len(keys):
            raise ValueError("the two scans disagree: the input changes between reads; pass replayable=False")
        placed = np.empty(len(keys), np.int64)
        placed[order] = values
        out.append(placed)
    return out[0], out[1]


def _step(x: np.ndarray) -> np.ndarray:
    """Place of a positive number on the logarithmic grid, from 1; 0 stands for zero."""
    return np.where(x > 0, np.clip(np.rint(STEPS * np.log2(np.maximum(x, 1e-12))) + WIDTH // 2, 1, WIDTH - 1), 0).astype(np.int64)


def _join_block(key: tuple[pa.Scalar, ...], streams: pa.Table, answers: pa.Table) -> pa.Table:
    (head,) = streams.to_pylist()
    rows = sorted(answers.to_pylist(), key=lambda r: r["shard"])
    words = np.frombuffer(expand(head["words"]), np.uint64)
    stream, counts = unpack(head["stream"]).astype(np.int64), unpack(head["counts"]).astype(np.int64)
    codes, where = np.unique(_pair_codes(stream, counts, len(words)), return_inverse=True)
    ones, ones_held = _level(rows, 1, words)
    twos, twos_held = _level(rows, 2, _pair_keys(codes, words))
    roles = np.array([role(i) for i in head["ids"]])
    who = np.repeat(roles, counts)
    # Deleted tokens on the grid of what the other training documents say about them.
    pair = where[who == 2]
    times = np.bincount(pair, minlength=len(codes))
    seen = np.flatnonzero(times)
    context, word = codes[seen] // len(words), codes[seen] % len(words)
    rest_c, rest_w = (ones - ones_held)[context], (ones - ones_held)[word]
    share = np.divide((twos - twos_held)[seen], rest_c, out=np.zeros(len(seen)), where=rest_c > 0)
    # Shares are at most 1 and counts at least 1. A cell keeps sums, so that its mean stands for its tokens.
    cell = (_bucket(rest_c) * WIDTH + _step(share)) * WIDTH + _step(rest_w.astype(float) / 2**16)
    cells, at = np.unique(cell, return_inverse=True)
    n = times[seen]
    out = (head["block"], head["stream"], head["counts"], head["ids"], pack(ones), pack(twos), int(counts[roles > 0].sum()), int(counts[roles == 2].sum()), sum(r["fresh"] for r in rows), cells, np.bincount(at, n, len(cells)).astype(np.int64), np.bincount(at, n * share, len(cells)), np.bincount(at, n * rest_w, len(cells)))
    return pa.Table.from_batches([_batch(_BOTH, [out])])


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two of its count."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def learn_weights(bucket: np.ndarray, share: np.ndarray, word: np.ndarray, counts: np.ndarray, distinct: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """[bucket, (pair, word, uniform)] weights by expectation-maximisation on held-out tokens.

    counts tokens of a bucket have the probabilities share (of the pair) and word. Buckets without
    held-out tokens take the weights of all tokens together; the uniform part never vanishes, so
    every text has a probability.
    """
    p = np.stack([share, word, np.full(len(share), 1.0 / (distinct + 1))], axis=1)

    def fit(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        weight = np.array([0.5, 0.4, 0.1])
        for _ in range(rounds if len(n) else 0):
            part = p * weight
            weight = (part / part.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
        weight = np.maximum(weight, 1e-6)
        return weight / weight.sum()

    weights = np.tile(fit(p, counts), (BUCKETS, 1))
    for b in np.unique(bucket):
        weights[b] = fit(p[bucket == b], counts[bucket == b])
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def _scorer(held, n_tokens: int, distinct: int):
    def run(batches):
        weights = held.value
        for batch in batches:
            for r in batch.to_pylist():
                stream, counts = unpack(r["stream"]).astype(np.int64), unpack(r["counts"]).astype(np.int64)
                ones, twos = unpack(r["ones"]).astype(np.int64), unpack(r["twos"]).astype(np.int64)
                codes, where = np.unique(_pair_codes(stream, counts, len(ones)), return_inverse=True)
                context, word = codes // len(ones), codes % len(ones)
                w = weights[_bucket(ones[context])]
                share = np.divide(twos, ones[context], out=np.zeros(len(twos)), where=ones[context] > 0)
                chance = w[:, 0] * share + w[:, 1] * ones[word] / max(n_tokens, 1) + w[:, 2] / (distinct + 1)
                base = np.log10((ones + 1) / (n_tokens + distinct + 1))
                starts = np.cumsum(counts) - counts
                sums = [np.add.reduceat(x, starts) for x in ((ones > 0)[stream].astype(np.int64), base[stream], np.log10(chance)[where])]
                roles = [role(i) == 0 for i in r["ids"]]
                columns = [pa.array(r["ids"], pa.int64()), pa.array(roles), pa.array(counts), pa.array(sums[0]), pa.array(np.full(len(counts), n_tokens)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shards: int | None = None, replayable: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens are A-Z-lower-cased words and one end; a null text has only the end. base_score is the
    add-one unigram log10 probability, score that of the interpolated model. Repeated rows each
    count and come out; a null id trains; ids are integers. Other columns are ignored, whatever
    their names. replayable as in bpe.encode. Without training documents all probability is uniform.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not replayable:
        source = materialize(source)
    parts = PARTS * scan_parts(source)
    shards = shards or SHARDS * parts
    keys = source.mapInArrow(_split(shards, block_bytes, False), _KEYS)
    answers = keys.repartition(parts, "level", "shard").groupBy("level", "shard").applyInArrow(_sum_shard, _KEYS)
    streams = source.mapInArrow(_split(shards, block_bytes, True), _STREAM)
    both = streams.repartition(parts, "block").groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block"))
    joined = materialize(both.applyInArrow(_join_block, _BOTH))
    totals = joined.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("train_tokens", "held_tokens", "fresh")]).first()
    names = ("cell_counts", "cell_shares", "cell_words")
    grid = joined.select(F.explode(F.arrays_zip("cells", *names)).alias("c")).groupBy("c.cells").agg(*[F.sum(f"c.{n}").alias(n) for n in names]).orderBy("cells").toPandas()
    n = grid["cell_counts"].to_numpy(np.float64)
    rest = max(totals["train_tokens"] - totals["held_tokens"], 1)
    bucket = grid["cells"].to_numpy(np.int64) // (WIDTH * WIDTH)
    weights = learn_weights(bucket, grid["cell_shares"].to_numpy(np.float64) / n, grid["cell_words"].to_numpy(np.float64) / n / rest, n, totals["fresh"])
    held = spark.sparkContext.broadcast(weights)
    return joined.select("stream", "counts", "ids", "ones", "twos").mapInArrow(_scorer(held, totals["train_tokens"], totals["fresh"]), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
