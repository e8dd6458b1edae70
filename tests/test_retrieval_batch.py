"""Many queries at once against one at a time: positional index, answers, vector index."""

from __future__ import annotations

import json
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import answers, ivf, postings
from corvane.operators import retrieval as R
from tests.conftest import DATA

TEXTS = "block_id long, text string"


def test_postings_equal_single_queries(spark):
    """Every query of many gives what keyword_matches gives alone, whatever the number of its terms."""
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(12)] + ["Ünïcode", "x9"]
    rows = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", " -"]) for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(200, None), (201, ""), (202, "!!"), (7, "t1 t2 t3"), (None, "t1 t2")]
    blocks = spark.createDataFrame(rows, TEXTS)
    index = postings.build(blocks).cache()
    asked = {q: rng.sample([v.lower() for v in vocabulary], rng.randint(1, 5)) for q in range(25)} | {100: ["t1", "unknown"], 101: ["t1", "t2"], 102: ["t2", "t1"]}
    terms = [(q, t) for q, own in asked.items() for t in own] + [(101, "t1"), (103, None), (None, "t1")]
    got = {}
    for r in postings.matches(index, spark.createDataFrame(terms, "query_id long, term string")).collect():
        if r["block_id"] != 7 and r["block_id"] is not None:
            got.setdefault(r["query_id"], {})[r["block_id"]] = round(r["keyword_score"], 9)
    plain = blocks.where("block_id IS NOT NULL AND block_id <> 7").cache()
    for q, own in asked.items():
        want = {r["block_id"]: round(r["keyword_score"], 9) for r in R.keyword_matches(plain, own).collect()}
        assert got.get(q, {}) == want, own
    assert got[101] == got[102] and not set(got) & {100, 103, None}
    assert postings.matches(index, spark.createDataFrame([], "query_id long, term string")).count() == 0
    assert postings.build(blocks.limit(0)).count() == 0


def test_widest_words(spark):
    index = postings.build(spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a b d")], TEXTS))
    words = spark.createDataFrame([(1, "d"), (1, "b"), (1, "a"), (1, "a"), (1, "zz"), (2, "zz")], "query_id long, term string")
    assert sorted(tuple(r) for r in postings.widest(words, index, 2).collect()) == [(1, "a"), (1, "b")]


def answered(spark, queries, include_filtered=False, k=5):
    links = spark.createDataFrame([(1, "d1"), (1, "d2"), (1, "d1"), (2, "d3"), (3, "gone")], "conversation_id long, document_id string")
    documents = spark.createDataFrame([("d1", False), ("d2", False), ("d3", False), ("gone", True)], "document_id string, is_deleted boolean")
    rows = [(i, f"d{1 + i % 3}", f"n{i % 3}", str(i % 2), " " if i == 4 else f"common word{i}", "TEXT", None, "note" if i % 7 == 6 else "heading" if i % 5 == 0 else "paragraph", ["References"] if i % 11 == 3 else [" Body "], [float(i), 1.0] if i % 4 else None) for i in range(60)]
    blocks = spark.createDataFrame(rows, "block_id long, document_id string, document_name string, unit string, text string, block_type string, subtype string, role string, section_path array<string>, embedding array<float>")
    asked = spark.createDataFrame(queries, "query_id long, conversation_id long, query string, query_vector array<float>")
    index = postings.build(blocks)
    terms = asked.select("query_id", F.explode(R.tokens(F.col("query"))).alias("term")).where("term IN ('common', 'word8')")
    found, results = answers.retrieve(asked, links, documents, blocks, index, terms, k, include_filtered)
    made = {r["query_id"]: json.loads(r["payload"]) for r in answers.payloads(found, results, k, include_filtered).collect()}
    return made


def test_answers_of_odd_queries(spark):
    """Empty queries, deleted and unknown scopes, no vector; limits by document and unit; filtered blocks only if asked for."""
    queries = [(1, 1, "what is  common?", [1.0, 0.5]), (2, 2, "common", None), (3, 3, "common", [1.0, 1.0]), (4, 99, "common", [1.0, 1.0]), (5, 1, " ? ", [1.0, 1.0]), (6, 1, "summarize common", [1.0, 0.5]), (7, 1, None, None)]
    got = answered(spark, queries)
    assert {q: p["strategy"] for q, p in got.items()} == {1: "rrf", 2: "keyword_fallback", 3: "empty_scope", 4: "empty_scope", 5: "empty_query", 6: "rrf", 7: "empty_query"}
    one, two, six = got[1], got[2], got[6]
    assert one["query"] == "what is common" and one["k"] == 10 and two["k"] == 10 and six["k"] == 12 and got[3]["k"] == 5
    for p in got.values():
        assert p["returned_count"] == len(p["results"]) and [r["rank"] for r in p["results"]] == list(range(1, len(p["results"]) + 1))
        assert not any(r["is_filtered"] for r in p["results"]) and p["requested_k"] == 5
    assert max(sum(r["document_id"] == d for r in one["results"]) for d in ("d1", "d2")) == 5 and {r["document_id"] for r in one["results"]} == {"d1", "d2"}
    assert len(six["results"]) == 8  # two documents, two units each, two of a unit
    assert all("vector_score" not in r and r["match_sources"] == ["keyword"] for r in two["results"]) and {r["document_id"] for r in two["results"]} == {"d3"}
    best = one["results"][0]
    assert best["snippet"].startswith("common word") and best["section_path"] == ["Body"] and best["block_type"] == "text" and best["relevance_reason"].startswith("matched")
    counts = one["filter_summary"]
    assert counts["total_candidate_count"] == 39 and counts["included_candidate_count"] + counts["excluded_candidate_count"] == 39 and counts["visible_candidate_count"] == counts["included_candidate_count"]
    every = answered(spark, queries[:1], include_filtered=True, k=20)[1]
    assert every["filter_summary"]["visible_candidate_count"] == 39 and any(r["is_filtered"] for r in every["results"])
    assert {r["relevance_reason"] for r in every["results"] if r["is_filtered"]} <= {"filtered reference note", "filtered references"}


def test_answers_shuffle_no_text(spark, monkeypatch):
    """What a block says does not travel with candidates: limits see ids, ranks and scores; snippets meet what comes back."""
    seen = []
    limited = answers.limited
    monkeypatch.setattr(answers, "limited", lambda rows, asked: seen.append(set(rows.columns)) or limited(rows, asked))
    got = answered(spark, [(1, 1, "common", [1.0, 0.5])])[1]
    assert not seen[0] & {"text", "snippet", "section_path", "embedding"} and {"query_id", "block_id", "document_id", "unit", "rrf_score"} <= seen[0]
    assert len(got["results"]) == 10 and all(r["snippet"] == f"common word{r['block_id']}" for r in got["results"])


VECTOR = "block_id long, embedding array<float>, label string"


def vectors(spark):
    return spark.read.parquet(f"{DATA}/embeddings.parquet").withColumnRenamed("vec_id", "block_id")


def test_vector_index_recall(spark):
    """The registered lists and probes find 0.9 of the exact neighbours; clustered vectors need few probes."""
    from corvane.plans import retrieval as plans

    all_, asked = plans._vector_index(spark, DATA)
    assert ivf.recall(all_.search(asked, 10, plans.PROBES), all_.search(asked, 10)) >= 0.9
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(16, 8))
    rows = [(i, (centre[i % 16] + rng.normal(size=8) * 0.1).astype(np.float32).tolist(), None) for i in range(1600)]
    index = ivf.build(spark.createDataFrame(rows, VECTOR), 16)
    some = spark.createDataFrame([(i, v, None) for i, v, _ in rows[::40]], "query_id long, query_vector array<float>, wanted string")
    assert ivf.recall(index.search(some, 10, 3), index.search(some, 10)) >= 0.95


@pytest.mark.parametrize("probes", [1, None])
def test_vector_index_odd_rows(spark, monkeypatch, probes):
    """Slices of a list of copies, rare labels that only a full search finds, vectors that take no part, repeats."""
    monkeypatch.setattr(ivf, "SLICE", 16)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], f"l{i % 3}") for i in range(200)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0], "l0") for i in range(120)]
    rows += [(500, [9.0, -9.0, 9.0, -9.0], "rare"), (501, [-9.0, 9.0, 9.0, 9.0], "rare"), (502, None, "l0"), (503, [0.0] * 4, "l0"), (504, [float("nan")] * 4, "l0"), (None, [1.0] * 4, "l0"), (7, [1.0, 1.0, 1.0, 1.0], None)]
    index = ivf.build(spark.createDataFrame(rows, VECTOR), 6, "label")
    asked = [(7, [1.0, 1.0, 1.0, 1.0], None), (900, [0.1, 0.2, 0.3, 0.4], "rare"), (901, [1.0, 2.0, 3.0, 4.0], "l0"), (902, None, None), (903, [0.0] * 4, None), (904, [1.0, 0.0, 0.0, 0.0], "nothing"), (7, [1.0, 1.0, 1.0, 1.0], None)]
    got = {}
    for r in index.search(spark.createDataFrame(asked, "query_id long, query_vector array<float>, wanted string"), 3, probes).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["block_id"], round(r["vector_score"], 6)))

    def exact(q, v, wanted):
        good = [(i, np.array(x, np.float32).astype(float), own) for i, x, own in rows if i is not None and x and np.isfinite(x).all() and any(x)]
        cos = lambda x: float(np.clip((x @ np.array(v) / np.linalg.norm(x) / np.linalg.norm(v) + 1) / 2, 0, 1))
        return [(n, i, round(-s, 6)) for n, (s, i) in enumerate(sorted((-round(cos(x), 12), i) for i, x, own in good if i != q and wanted in (None, own))[:3], 1)]

    assert sorted(got[900]) == [(1, 501, got[900][0][2] if got[900][0][0] == 1 else got[900][1][2]), (2, 500, min(x[2] for x in got[900]))]
    assert [b for _, b, _ in sorted(got[901])] == [1000, 1001, 1002] and set(got) == {7, 900, 901}
    assert len(got[7]) == 6  # a repeated query finds its own twice
    if probes is None:
        v = np.array([1.0, 1.0, 1.0, 1.0])
        assert sorted(got[7]) == sorted(2 * exact(7, v, None))
    empty = ivf.build(spark.createDataFrame([], VECTOR), 4)
    assert empty.search(spark.createDataFrame(asked[:1], "query_id long, query_vector array<float>, wanted string"), 3).count() == 0


def lanes_data(spark):
    rng = random.Random(9)
    texts = [(i, f"d{i % 3}", rng.choice(["b", "a", None]), " ".join(rng.choice("tuvwxyz") for _ in range(rng.randint(0, 30)))) for i in range(700)]
    blocks = spark.createDataFrame(texts, "block_id long, document_id string, document_name string, text string")
    terms = spark.createDataFrame([(q, t) for q in range(12) for t in rng.sample("tuvwxyz", 1 + q % 4)] + [(90, "t"), (90, "none")], "query_id long, term string")
    scope = spark.createDataFrame([(q, f"d{d}") for q in range(12) for d in range(q % 4)], "query_id long, document_id string")
    return blocks, terms, scope


def test_best_of_tiles_equal_all_matches(spark, monkeypatch):
    """The k best by tiles, with bounds that leave blocks out, are the k best of all matches; no match is gathered."""
    monkeypatch.setattr(postings, "TILE", 128)
    monkeypatch.setattr(postings, "FIRST", 16)
    blocks, terms, scope = lanes_data(spark)
    index, order = postings.build(blocks).cache(), [F.asc_nulls_last("document_name"), F.asc("block_id")]
    every = postings.matches(index, terms).withColumn("keyword_score", F.round("keyword_score", 9)).join(blocks.drop("text"), "block_id").cache()
    with monkeypatch.context() as m:
        m.setattr(postings, "matches", None)
        got = [postings.best(index, terms, blocks.drop("text"), order, 10, s) for s in (None, scope)]
    for found, hits in zip(got, (every, every.join(scope, ["query_id", "document_id"], "left_semi"))):
        want = postings.topk(hits, 10, [F.desc("keyword_score"), *order]).select("query_id", "block_id", "keyword_score", "sparse_rank")
        assert sorted(found.collect()) == sorted(want.collect())


def test_best_goes_in_waves(spark, monkeypatch, tmp_path):
    """A class with k blocks of the highest score meets no later tiles; one without does. No terms or no blocks give no rows."""
    monkeypatch.setattr(postings, "TILE", 64)
    real, seen = postings._best, str(tmp_path)

    def spied(*args):
        run = real(*args)

        def noted(key, held, asked):
            if len(held) and len(asked):
                tempfile.NamedTemporaryFile(dir=seen, delete=False, suffix=f".{len(asked)}").close()
            return run(key, held, asked)

        return noted

    monkeypatch.setattr(postings, "_best", spied)
    blocks = spark.createDataFrame([(i, "d", "n", "a b " * 12 + "c" * (i == 290)) for i in range(300)], "block_id long, document_id string, document_name string, text string")
    index, order, terms = postings.build(blocks).cache(), [F.asc("block_id")], "query_id long, term string"
    best = lambda asked: sorted(map(tuple, postings.best(index, spark.createDataFrame(asked, terms), blocks.drop("text"), order, 10).collect()))
    assert best([(1, "a"), (1, "b"), (2, "b"), (2, "a")]) == [(q, b, 1.0, b + 1) for q in (1, 2) for b in range(10)]
    assert len(os.listdir(seen)) == 1
    assert best([(1, "c"), (1, "a")]) == [(1, 290, 0.05, 1)]
    assert len(os.listdir(seen)) > 5
    assert postings.best(index, spark.createDataFrame([], terms), blocks.drop("text"), order, 10).count() == 0
    assert postings.best(index, spark.createDataFrame([(1, "a")], terms), blocks.drop("text").limit(0), order, 10).count() == 0


def test_dense_tiles_equal_pairs(spark, monkeypatch):
    """Tiles of queries and blocks of a document leave what all pairs do, vectors without a length last."""
    monkeypatch.setattr(R, "TILE", 64)
    blocks, _, scope = lanes_data(spark)
    vector = F.array(*[(F.xxhash64("block_id", F.lit(j)) % 3).cast("double") for j in range(3)])
    blocks = blocks.withColumn("embedding", F.when(F.col("block_id") % 7 != 0, vector))
    asked = spark.range(12).select(F.col("id").alias("query_id"), F.when(F.col("id") != 5, F.array(*[((F.col("id") + j) % 3).cast("double") for j in range(3)])).alias("query_vector"))
    pairs = asked.where("query_vector IS NOT NULL").join(scope, "query_id").join(blocks.where("embedding IS NOT NULL"), "document_id").withColumn("vector_score", R.similarity(F.col("embedding"), F.col("query_vector")))
    want = postings.topk(pairs, 210, [F.desc_nulls_last("vector_score"), F.asc("block_id")], "dense_rank").select("query_id", "block_id", "vector_score", "dense_rank")
    key = lambda r: (r[0], r[3])
    assert sorted(R.dense_topk_in(blocks, asked, scope, 210).collect(), key=key) == sorted(want.collect(), key=key)
