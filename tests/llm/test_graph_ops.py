"""Mixing, neighbours, deduplication and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import ann, bpe, embdedup, minhash, mixing, queries, secrets
from corvane.llm._common import word_count
from corvane.llm.components import connected_components
from tests.compare import assert_same, connect
from tests.conftest import DATA, TABLES
from tests.llm.test_text_ops import plain_chain


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 230)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 4)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: c for n, c in closure(touched, [p for p in links if p[0] != p[1]]).items()}


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(minhash.ASCII_LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_dedup(rows, n, percent=80):
    sets = [(i, shingles(t, n)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    comp = closure([i for i, _ in rows], links)
    return Counter((i, len(s), comp[i], comp[i] == i) for i, s in sets)


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocabulary) for _ in range(40)]
    rows, i = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((i, " ".join(own) + rng.choice(["", " ", "\n"])))
            i += 1
    for _ in range(25):  # a passage that many documents share
        rows.append((i, " ".join(common + [rng.choice(vocabulary) for _ in range(rng.randint(15, 40))])))
        i += 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, "one"), (i + 3, "ONE"), (i + 4, "b a"), (i + 5, "x " * 20_000)]


@pytest.mark.parametrize("words", [4, 5])
def test_minhash_equals_brute_force(spark, words):
    rows = corpus(words)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "key": F.lit("k"), "sketch": F.lit("s"), "component": F.lit(0)})
    got = Counter(tuple(r) for r in minhash.near_duplicates(df, words).collect())
    assert got == brute_dedup(rows, words)


@pytest.mark.parametrize("slice_,shrink", [(4, 0.9), (4, 0.0), (60, 0.5)])
def test_minhash_splits_hot_buckets(spark, monkeypatch, slice_, shrink):
    """Slices of buckets and chunks of clusters lose no link."""
    monkeypatch.setattr(minhash, "SLICE", slice_)
    monkeypatch.setattr(minhash, "SHRINK", shrink)
    monkeypatch.setattr(minhash, "TILE", 3)
    rng = random.Random(21)
    base = [f"h{i}" for i in range(60)]
    rows = corpus(9)
    for i in range(70):  # one template: some within, some below the threshold of each other
        own = list(base)
        for k in rng.sample(range(60), rng.randint(0, 5)):
            own[k] = f"z{rng.randrange(99)}"
        rows.append((5000 + i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in minhash.near_duplicates(df, 4).collect()) == brute_dedup(rows, 4)


def test_minhash_odd_rows(spark):
    """Repeated rows, two texts under one id, null ids, empty tables."""
    long = " ".join(f"a{i}" for i in range(30))
    rows = [(1, long), (1, long), (2, long), (3, "p q r s t u"), (3, long), (4, "p q r s t u"), (None, long), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in minhash.near_duplicates(df, 4).collect())
    assert got == Counter([(1, 27, 1, True)] * 2 + [(2, 27, 1, False), (3, 3, 1, False), (3, 27, 1, False), (4, 3, 1, False), (None, 27, None, True), (None, 0, None, True)])
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_mixing_targets():
    t = mixing.targets({"a": 100, "b": 10, None: 90})
    assert t["b"] == 30.0 and math.isclose(sum(t.values()), 200) and math.isclose(t["a"] * 3, t[None])
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_flow_prefers_few_repeats():
    flows = mixing.route([(("a",), 10), (("a", "b"), 10), (("b",), 10)], {"a": 15, "b": 25})
    taken = [sum(f.values()) for f in flows]
    assert sum(taken) == 40 and taken[0] >= 10 and sum(f.get("a", 0) for f in flows) == 15
    assert max(taken) <= 20  # costs are convex: nobody is taken a third time while others were once


def test_mix_overlapping(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([["a"], ["a", "b"], ["b"], [None], None, []]), rng.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame([*rows, (None, ["a"], None)], "doc_id long, m array<string>, n int")
    df = df.withColumns({n: F.lit(k) for k, n in enumerate(("_pattern", "_hash", "_edge", "_bucket", "bucket", "pattern", "key", "row", "_size", "_TAKEN", "rest"))})
    out = mixing.mix(df, F.col("m"), F.col("n")).cache()
    assert sorted(out.columns) == sorted([c for c in df.columns if c not in ("_size", "_TAKEN")] + list(mixing.ADDED))
    assert out.where("_bucket <> 3 OR key <> 6").count() == 0
    again = mixing.mix(df.repartition(7), F.col("m"), F.col("n"))
    key = lambda d: Counter((r["doc_id"], r["_size"], r["_taken"]) for r in d.collect())
    assert key(out) == key(again)
    got = out.collect()
    assert len(got) == 3001 and all(0 <= r["_repeats"] <= 3 and r["_taken"] == r["_repeats"] * r["_size"] for r in got)
    total = sum(r["_size"] for r in got)
    assert abs(sum(r["_taken"] for r in got) - total) < 0.02 * total
    assert mixing.mix(df.limit(0), F.col("m"), F.col("n")).count() == 0


def test_mix_hits_targets(spark):
    rows = [(i, f"s{i % 5}" if i % 11 else None, "w " * (i % 40)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(df, F.array("source"), word_count(F.col("text")))
    for r in out.groupBy("source").agg(F.sum("_taken").alias("t"), F.first("_target").alias("want")).collect():
        assert abs(r["t"] - r["want"]) <= 40


def brute_choice(own, rest):
    """The documents (hash, size, ...) that give rest words: lengths from the longest down, then a prefix."""
    words, chosen = sum(d[1] for d in own), []
    share = rest * 4096 // words if words else 0
    for bits in range(62, -1, -1):
        here = [d for d in own if d[1].bit_length() == bits]
        shorter = sum(d[1] for d in own if d[1].bit_length() < bits)
        drawn = [d for d in here if int(d[0][:3], 16) < share]
        every = sum(d[1] for d in here)
        if 0 <= rest - sum(d[1] for d in drawn) <= shorter:
            chosen += drawn
            rest -= sum(d[1] for d in drawn)
        elif rest > shorter:
            if rest >= every:
                chosen, rest = chosen + here, rest - every
            elif rest - shorter <= every - rest and rest - shorter <= 2**bits / 4:
                rest = shorter
            elif every - rest <= 2**bits / 4:
                chosen, rest = chosen + here, 0
            else:
                before = 0
                for d in sorted(d for d in own if d[1].bit_length() <= bits):
                    if 2 * before + d[1] <= 2 * rest:
                        chosen.append(d)
                    before += d[1]
                break
    return chosen


@pytest.mark.parametrize("seed", range(4))
def test_mix_passes_long_documents_at_the_cut(spark, tmp_path, seed):
    """A document of most of a source's words does not keep the short ones after it out; the SQL agrees."""
    rng = random.Random(seed)
    rows = [(i, f"s{i % 3}", "w " * rng.randint(100, 300)) for i in range(900)]
    rows += [(1000 + i, f"s{i % 3}", "w " * n) for i, n in enumerate([200_000, 90_000, 30_000, 50_000, 3_000, 30_000])]
    rows += [(None, "s0", "w " * 200)] * 40 + [(2000, None, None), (2001, None, ""), (2002, "empty", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op3_source_mix(spark, str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "source").dropna().dropDuplicates(["doc_id"]).join(out, "doc_id")
    sources = {r["source_size"]: r["source"] for r in got.dropDuplicates(["source"]).collect()}
    for r in out.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect():
        # s0 has 250,000 of its 318,000 words in two documents: 200,000 alone come nearest to 196,000.
        assert abs(r["t"] - r["target"]) <= (4500 if sources.get(r["source_size"]) == "s0" else 300), (sources.get(r["source_size"]), r)
    assert got.where("taken > 3 * size").count() == 0
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(out, con.sql(queries.OP3_SQL))


VECTOR = "vec_id long, embedding array<float>, label int"


def vectors(seed=3, n=260, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = [(i, (centres[i % 12] + rng.normal(size=d) * 0.12 * (i % 3)).astype(np.float32).tolist(), int(i % 4)) for i in range(n)]
    return [*rows, (300, [0.0] * d, 1), (301, None, 1), (302, [float("nan")] * d, 1), (303, [None] + [1.0] * (d - 1), 1), (304, [], 1), (305, [1.0, 2.0], 1), (400, rows[0][1], 0), (500, rows[1][1], None), (305, [1.0, 2.0], 1), (None, rows[0][1], 0)]


def good(rows):
    return [r for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]


def test_nearest_equals_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTOR).withColumns({"row": F.lit(0), "id": F.lit(5), "q": F.lit(True)})
    got = Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest(df, F.col("vec_id") % 100 == 0, 5).collect())
    own, expected = good(rows), Counter()
    for x, (i, v, _) in enumerate(own):
        if i % 100 == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), j) for y, (j, w, _) in enumerate(own) if y != x and len(w) == len(v))[:5]
            expected.update((i, k, j, round(d, 9)) for k, (d, j) in enumerate(near, 1))
    assert got == expected


def test_quantised_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 33)) * 7, rng.normal(size=(60, 33)) / 9
    low, high = ann.bounds(ann.quantise(a), ann.quantise(b))
    exact = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert (low <= exact + 1e-12).all() and (exact <= high + 1e-12).all()


def test_nearest_few_and_none(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], VECTOR)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect()] == [(100, 1, 1)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def brute_links(rows, threshold=0.98):
    own = [r for r in good(rows) if r[2] is not None]
    pairs = []
    for x, (i, v, k) in enumerate(own):
        for j, w, m in own[:x]:
            if k == m and len(v) == len(w):
                dot, a, b = (sum(p * q for p, q in zip(s, t)) for s, t in ((v, w), (v, v), (w, w)))
                if dot / math.sqrt(a * b) >= threshold:
                    pairs.append((i, j))
    return pairs


def test_embedding_dedup_equals_brute_force(spark):
    rows = [r for r in vectors() if r[0] != 305 or r[2] != 1] + [(305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [1.0, 2.0], 1)]
    pairs = brute_links(rows)
    comp = closure([i for i, *_ in rows if i is not None], pairs)
    counts = Counter(x for p in pairs for x in p)
    expected = Counter((i, counts[i] if i is not None else 0, comp.get(i), i is None or comp[i] == i) for i, *_ in rows)
    df = spark.createDataFrame(rows, VECTOR).withColumns({"id": F.lit(1), "v": F.lit("v"), "first": F.lit(0)})
    assert Counter(tuple(r) for r in embdedup.near_duplicates(df).collect()) == expected
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


def linked(df, threshold=0.98):
    """(numbers of links by id, components by id) from what the tiles give."""
    found = embdedup.links(df, threshold).collect()
    n = Counter()
    for r in found:
        if r["n"] is not None:
            n[r["a"]] += r["n"]
    return n, [(r["a"], r["b"]) for r in found if r["b"] is not None]


def test_embedding_split_buckets(spark, monkeypatch):
    """Large buckets cut into slices, and small ones taken together, give the same links."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 32))
    rows = [(i, (base[i % 40] + rng.normal(size=32) * 0.09).astype(np.float32).tolist(), 1) for i in range(400)]
    want = brute_links(rows)
    df = spark.createDataFrame(rows, VECTOR).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.lit("1").alias("label"), F.size("embedding").alias("dim"), F.lit(1).cast("long").alias("n"))
    results = []
    for size, small in ((2048, 48), (2048, 0), (3, 48)):
        monkeypatch.setattr(embdedup, "BUCKET", size)
        monkeypatch.setattr(embdedup, "SMALL", small)
        n, forest = linked(df)
        results.append((n, closure(range(400), forest)))
        assert sum(n.values()) >= 0.97 * 2 * len(want) and all(n[i] <= c for i, c in Counter(x for p in want for x in p).items())
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("dim,turns", [(64, 2), (64, 3), (64, 4), (24, 2), (24, 4), (200, 3)])
def test_embedding_recall_by_number_of_axes(dim, turns):
    """Pairs at the threshold and somewhat above meet in a bucket, whatever number of axes names it."""
    rng = np.random.default_rng(dim + turns)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for cosine in (0.98, 0.985, 0.995):
        a, other = unit(rng.normal(size=(400, dim))), rng.normal(size=(400, dim))
        other = unit(other - (other * a).sum(axis=1, keepdims=True) * a)
        b = cosine * a + np.sqrt(1 - cosine**2) * other
        p, q = embdedup.axes(a, turns), embdedup.axes(b, turns)
        met = (p[:, :, :, None] == q[:, :, None, :]).any(axis=(1, 2, 3))
        assert met.mean() >= 0.97


need = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@need
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    assert_same(queries.queries()[name](spark, DATA), connect(DATA, TABLES).sql(queries.oracle_sql()[name]))


@need
def test_every_operator_has_its_query():
    assert [sum(n.startswith(f"op{i}_") for n in queries.queries()) for i in range(1, 11)] == [1] * 10


@need
def test_pipeline_by_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mix", "byte_bpe"]
    stages = dict(corpus_pipeline.STAGES)
    mild = stages["toxicity"](spark, docs, DATA).cache()
    assert mild.columns == docs.columns
    gone = {r["doc_id"] for r in docs.select("doc_id").subtract(mild.select("doc_id")).collect()}
    assert gone and sum(labels.get(i, 1) == 0 for i in gone) == 0

    kept = stages["near_dedup"](spark, mild, DATA).cache()
    expected = brute_dedup([(r["doc_id"], r["text"]) for r in mild.collect()], 5)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _, k in expected if k} and kept.columns == docs.columns

    clean = stages["secrets"](spark, kept, DATA).cache()
    assert clean.count() == kept.count() and clean.columns == docs.columns
    changed = kept.join(clean.select("doc_id", F.col("text").alias("t2")), "doc_id").where("text <> t2").collect()
    assert all("[SECRET]" in r["t2"] for r in changed)
    assert {r["doc_id"] for r in changed} == {r["doc_id"] for r in secrets.report(kept).where("spans <> ''").collect()}

    mixed = stages["mix"](spark, clean, DATA).cache()
    copies = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert mixed.columns == docs.columns and max(copies.values()) <= 3
    assert stages["byte_bpe"](spark, mixed, DATA).count() == mixed.count()


def pipeline_rows(seed=31):
    rng = random.Random(seed)
    vocabulary = ["w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(300)]
    rows, labels = [], []
    for i in range(160):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        toxic = i % 9 == 0
        if toxic:
            own[rng.randrange(len(own)) :] += ["nasty", "vile"]
        if i % 7 == 3:
            own.insert(rng.randrange(len(own)), rng.choice(["api_key=abcdef123456", "AKIA" + "B7" * 9, "deadbeef" * 4, "token: Qwertyuiop"]))
        rows.append((i, " ".join(own), rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", "c", None])))
        labels.append((i, int(rng.random() < 0.8), int(toxic)))
    for i in range(160, 200):  # near copies
        _, text, lang, source = rows[rng.randrange(160)]
        own = text.split()
        own[rng.randrange(len(own))] = rng.choice([*own, "other"])
        rows.append((i, " ".join(own), lang, source))
    rows += [(200, None, "en", "b"), (201, "", None, "c"), (None, "wab wac", "en", "a"), (5, rows[5][1], "xx", "a"), (5, "another text of id five", "en", "a"), (7, rows[7][1], rows[7][2], rows[7][3])]
    return rows, labels


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels = pipeline_rows()
    clash = {n: F.lit(k) for k, n in enumerate(("_words", "_size", "_repeats", "_pattern", "p_toxic", "spans", "row", "whole", "tie"))}
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    # Toxicity: the chain written out, on every distinct labelled row (id, text).
    of = {i: (1 - q, t) for i, q, t in labels}
    known = sorted({(i, t) for i, t, *_ in rows if i in of and t})
    y = np.array([of[i] for i, _ in known], float)
    total = Counter(t for _, _, t in labels)
    weight = np.array([total[int(t)] / (y[:, 1] == t).sum() for t in y[:, 1]])
    predict = plain_chain([t for _, t in known], y, weight, np.array([zlib.crc32(str(i).encode()) % 3 for i, _ in known]))
    mild = [r for r in rows if not (r[1] and predict(r[1])[1] >= 0.5)]
    assert 0 < len(rows) - len(mild) < 40

    # Near copies: of each group the smallest id; equal rows of an id once.
    kept = {i for i, _, _, k in brute_dedup([(r[0], r[1]) for r in mild if r[0] is not None], 5) if k}
    once = {}
    for r in sorted((r for r in mild if r[0] in kept), key=lambda r: tuple("" if x is None else str(x) for x in r[2:])):
        once.setdefault((r[0], r[1]), r)
    left = [*once.values(), *(r for r in mild if r[0] is None)]
    assert len(left) < len(mild) and sum(r[0] == 5 for r in left) == 2

    # Secrets.
    def clean(text):
        spans = sorted((m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in r.compile().finditer(text) if len(m.group(r.group)) >= r.length)
        out, at = "", 0
        for start, _, end in spans:
            out, at = (out + text[at:start] + "[SECRET]" if start >= at else out), max(at, end)
        return out + text[at:]

    left = [(i, t and clean(t), s) for i, t, _, s in left]
    assert sum("[SECRET]" in (t or "") for _, t, _ in left) > 5

    # Mix: words of each source nearly at its target, whole documents in seeded order.
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in left:
        sizes[s] += size(t)
    weights = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    target, free, amount = {}, set(sizes), sum(sizes.values())
    while free:
        share = {s: amount * weights[s] / sum(weights[u] for u in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            amount -= target[s]
        free -= over
    want = Counter()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for s in sizes:
        words = min(3 * sizes[s], math.floor(target[s] + 0.5))
        whole, rest = divmod(words, sizes[s]) if sizes[s] else (0, 0)
        own = [(hashlib.md5(f"mix|{'null' if i is None else i}|{size(t)}".encode()).hexdigest(), size(t), i, t) for i, t, src in left if src == s]
        more = brute_choice(own, rest)
        for d in own:
            i, t, times = d[2], d[3], whole + (d in more)
            ids = encoding.encode_ordinary(t or "")
            if times:
                want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += times
    assert got == want and max(want.values()) > 1


def test_pipeline_without_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
