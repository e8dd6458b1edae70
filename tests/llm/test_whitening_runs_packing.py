"""Whitening, periodic runs and packing against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import packing, queries, repeats, whitening
from tests.conftest import DATA


def put(df, folder, table):
    df.write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


# Whitening


def brute_space(vectors, scale=64, shift=1_000_000):
    """(n, S, exact covariance times n squared) of the distinct grid vectors."""
    xs = sorted({tuple(math.floor(scale * c) + shift for c in v) for v in vectors})
    n, s = len(xs), [sum(c) for c in zip(*xs)]
    exact = [[n * sum(x[i] * x[j] for x in xs) - s[i] * s[j] for j in range(len(s))] for i in range(len(s))]
    return n, s, exact


def check_whitening(rows, vectors, components=16):
    """rows of the query against the exact space of the vectors (id to components)."""
    n, s, exact = brute_space(vectors.values())
    v = np.array([[float(Fraction(c, n * n)) for c in row] for row in exact])
    values = np.linalg.eigvalsh(v)[::-1]
    d = len(s)
    by_id = defaultdict(dict)
    for r in rows:
        by_id[r["vec_id"]][r["component"]] = r
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-9)
    assert set(by_id) == set(vectors)
    z, centred = [], []
    for i, own in by_id.items():
        x = [math.floor(64 * c) + 1_000_000 for c in vectors[i]]
        assert set(own) == set(range(1, min(components, d) + 1))
        assert {r["deviation"] for r in own.values()} == {sum((n * a - b) ** 2 for a, b in zip(x, s))}
        z.append([own[k]["whitened"] for k in sorted(own)])
        centred.append([float(Fraction(n * a - b, n)) for a, b in zip(x, s)])
    z, centred = np.array(z), np.array(centred)
    # Whitened values are projections on unit eigenvectors over the root of the eigenvalue.
    axes = np.linalg.lstsq(centred, z * np.sqrt(values[: z.shape[1]]), rcond=None)[0]
    assert np.allclose(axes.T @ axes, np.eye(z.shape[1]), atol=1e-8)
    assert np.allclose(v @ axes, axes * values[: z.shape[1]], atol=1e-8 * values[0])


def test_whitening_equals_brute_force(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    check_whitening(queries.op11_whitening(spark, DATA).collect(), {i: [float(c) for c in v] for i, v in rows.items()})


def test_whitening_odd_rows(spark, tmp_path):
    """Repeated rows count once; null and non-finite ones go; few dimensions give few components."""
    rng = random.Random(5)
    good = {i: [rng.uniform(-3, 3) * (k + 1) for k in range(5)] for i in range(40)}
    rows = [*good.items(), *[(i, good[0]) for i in range(100, 160)], (200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [math.nan] * 5), (204, [1.0, 2.0, math.inf, 1.0, 1.0]), (205, [1e300] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "n": F.lit("a"), "dim": F.lit(2)})
    got = queries.op11_whitening(spark, put(df.repartition(5), tmp_path, "embeddings")).collect()
    assert len(got) == 100 * 5
    check_whitening(got, good | {i: good[0] for i in range(100, 160)})


def test_whitening_degenerate(spark):
    """Empty tables, one vector and equal vectors have no variance; a flat direction is left out."""
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i * i), 7.0]) for i in range(6)] + [(None, [1.0, 7.0])], schema)).collect()
    assert Counter(r["component"] for r in flat) == {1: 7} and {r["n"] for r in flat} == {6}
    two = whitening.whiten(spark.createDataFrame([(i, [float(i)] * (1 + i % 2)) for i in range(8)], schema)).collect()
    assert {r["n"] for r in two} == {4} and len(two) == 8


def test_scatter_is_exact():
    rng = random.Random(3)
    for bits in (3, 19, 21, 40, 62):
        x = np.array([[rng.randint(-(1 << bits), 1 << bits) for _ in range(4)] for _ in range(50)], np.int64)
        want = x.astype(object).T @ x.astype(object)
        assert (whitening.scatter(x) == want).all()


def test_whitening_of_large_numbers(spark):
    """Beyond long integers the deviation stays exact, and the query's long is null."""
    rows = [(i, [float(i) * 1e12, float(i % 3) * 1e11]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, s, _ = brute_space([v for _, v in rows])
    want = {i: sum((n * (math.floor(64 * c) + 1_000_000) - b) ** 2 for c, b in zip(v, s)) for i, v in rows}
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == want and max(want.values()) > 1 << 63
    assert max(r["identity_error"] for r in got) < 1e-9


# Periodic runs


def brute_runs(w, shortest, times):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, times * q):
                own = w[i : j + q]
                if not any(own[z:] == own[:-z] for z in range(1, q)):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_document(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w, 24, 3)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found).encode()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(b" ".join(x for i, x in enumerate(w) if i not in dropped)))


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        block = []
        for _ in range(rng.randint(1, 6)):
            k, n = rng.randint(1, 4), rng.randint(0, 90)
            w = [b"%d" % rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), 1 + rng.randrange(1 + n // 3)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            block.append(w)
        shortest, times = rng.choice([(1, 2), (6, 2), (6, 3), (24, 3)])
        assert [list(map(tuple, r.tolist())) for r in repeats.runs(block, shortest, times)] == [brute_runs(w, shortest, times) for w in block]


def test_periodic_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "ß x", "　"]
    rows = [(i, rng.choice([" ", "\n", "  \t"]).join(rng.choice(vocabulary) for _ in range(rng.choice([5, 30, 80, 200])))) for i in range(300)]
    for i, (period, times, tail) in enumerate([(1, 24, 0), (1, 23, 0), (8, 3, 0), (8, 3, -1), (8, 2, 5), (7, 5, 3), (60, 3, 20), (2, 13, 1)], 300):
        own = [f"p{k}" for k in range(period)] * (times + 2)
        rows.append((i, "x y " + " ".join(own[: period * times + tail]) + " z"))
    rows += [(400, "a b " * 12 + "a c " + "a b " * 13), (401, "a " * 5000), (402, " ".join(["q", "r"] * 20 + ["q"] * 30)), (403, None), (404, ""), (405, " \n\t "), (None, "k " * 24), (None, None), (7, rows[7][1]), (7, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("r"), "start": F.lit(3), "row": F.lit(0)})
    got = queries.op12_periodic_runs(spark, put(df.repartition(3), tmp_path, "documents"))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_document(*r) for r in rows)


def test_periodic_runs_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if len(r["text"] or "") < 6000]
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, DATA).where(F.col("doc_id").isin([i for i, _ in rows])).collect()}
    assert got == {brute_document(*r) for r in rows}
    assert sum(r[1] > 0 for r in got) > 5


def test_refinement_work_is_bounded(monkeypatch):
    """Smaller halves: positions looked at grow like n log n, in periodic texts too."""
    looked = []
    splits = repeats.Classes.splits
    monkeypatch.setattr(repeats.Classes, "splits", lambda self, at, by: (looked.append(len(at)), splits(self, at, by))[1])
    for w in ([b"a"] * 20_000, [b"%d" % (i % 97) for i in range(20_000)], [b"ab"[int(c)] for c in "0110100110010110" * 1250]):
        looked.clear()
        repeats.runs([w], 24, 3)
        assert sum(looked) < 20_000 * 20


def test_periodic_runs_empty(spark):
    assert repeats.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        repeats.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), times=1)


# Packing


def check_packing(rows, documents, window=2048):
    """Pieces tile documents and sequences, hold the library's ids, and leave no padding."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for name, text in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want[name, tuple(ids)] += 1
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for held in sequences.values():
        held.sort(key=lambda r: r["offset"])
        at = 0
        for r in held:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == window or (at < window and at & (at - 1) == 0)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for name in {n for n, _ in want}:
        own = [ids for (n, ids), times in want.items() for _ in range(times) if n == name]
        assert sum(map(len, own)) == sum(r["length"] for r in pieces[name])
        if len(own) == 1:
            at = 0
            for r in sorted(pieces[name], key=lambda r: r["start"]):
                part = np.array(own[0][at : at + r["length"]], "<u4").tobytes()
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(own[0]), zlib.crc32(part))
                at += r["length"]
    assert set(pieces) == {n for n, _ in want}
    return sequences


def test_packing_of_documents(spark):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = queries.op13_packing(spark, DATA).collect()
    check_packing(rows, documents)


ODD = [(1, "a b <|endoftext|>x <|startoftext|>"), (2, "ÀÉ é ́x DON'T it's 123 İI ΣΑΣ"), (3, " \x1c\x1d a\x85b   c"), (4, "日本語 กข"), (5, "a'llb 'll ' s"), (6, "x\x00y ﻿ z"), (7, "\n"), (8, ""), (9, None), (None, "no id"), (10, "twice"), (10, "twice"), (11, "one text"), (11, "another"), (12, "word " * 5000), (13, "w " * 2047), (14, "w " * 2048), (15, "한국어" * 3000)]


@pytest.mark.parametrize("parts", [1, 4])
def test_packing_odd_rows(spark, tmp_path, parts):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"ids": F.lit(1), "start": F.lit("s"), "row": F.lit(2)})
    rows = queries.op13_packing(spark, put(df.repartition(parts), tmp_path, "documents")).collect()
    check_packing(rows, ODD)
    assert packing.pack(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_encoder_equals_the_library():
    """Every letter below U+0250 beside others, marks, and words of other scripts."""
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.Encoder(path)
    assert encode.spelling
    rng = random.Random(1)
    texts = [f"{chr(c)} a{chr(c)}b {chr(c)}{chr(c)}9{chr(c)}X {chr(c).upper()}'S" for c in range(0x250)]
    letters = [chr(c) for c in [*range(0x250), 0x300, 0x301, 0x3A3, 0x3C2, 0x1E9E, 0x130, 0x2028, 0xFEFF, 0xAC00, 0x0E01, 0x1F600]]
    texts += ["".join(rng.choice(letters) for _ in range(60)) for _ in range(3000)]
    texts += ["".join(rng.choice("abcXYZ'stremvld09.,!<|> éÉß") for _ in range(60)) for _ in range(3000)]
    texts += [None, "", "<|endoftext|>", "x<|startoftext|>y <|ENDOFTEXT|> <|endoftext|"]
    ids, ends = encode(pa.array(texts))
    begin = 0
    for text, end in zip(texts, ends.tolist()):
        assert ids[begin:end].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
        begin = end


@pytest.mark.parametrize("window", [1, 2, 7, 64, 100])
def test_pouring_and_open_windows(spark, monkeypatch, window):
    """Any window; many open ones are poured together."""
    monkeypatch.setattr(packing, "OPEN", 3)
    rng = random.Random(window)
    rows = [(i, "w " * rng.randint(0, 120)) for i in range(150)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), public_tokenizers.path("word_bpe_49k.json"), window).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(got, rows, window)


def test_levels_choose_by_squares():
    """The level array's choice is the smallest sum of squares over all choices."""
    rng = random.Random(2)
    levels = packing.Levels(24)
    for i in range(400):
        size = rng.choice([3, 5, 8, 11, 17, 24])

        def squares(level):
            c = levels.counts.copy()
            if level:
                c[level] -= 1
            if level + size < 24:
                c[level + size] += 1
            return int((c * c).sum())

        options = [h for h in range(24 - size + 1) if h == 0 or levels.counts[h]]
        assert levels.choose(size) == max(options, key=lambda h: (-squares(h), h))
        levels.place((i, 0, np.zeros(size, "<u4")))


def test_few_windows_stay_open():
    """What has to be poured at the end, and so cut, does not grow with the documents."""
    rng = random.Random(4)
    levels, full, open_ = packing.Levels(2048), 0, []
    for i in range(40_000):
        full += levels.place((i, 0, np.zeros(rng.randint(1, 1500), "<u4"))) is not None
        if i % 10_000 == 9_999:
            open_.append(levels.open)
    assert max(open_) < 2 * open_[0] and open_[-1] < 0.1 * full
