from __future__ import annotations

import io
import json
import math
import random
import time
import zipfile
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.operators import blocks, conversation, folds, html, jobs, joins, quota, retrieval, structure
from corvane.plans import catalog, ingestion, models, study
from corvane.sources import files, sinks
from corvane.streaming import usage
from tests.conftest import DATA

SEGMENT = "doc_id string, segment_id string, page_index int, order_index int, role string, text string, bbox array<double>, section_path array<string>"


def segments(spark, *rows):
    return spark.createDataFrame([("d", f"s{i}", p, i, role, t, None, None) for i, (p, role, t) in enumerate(rows)], SEGMENT)


def test_page_break_merge(spark):
    out = folds.merge_continuations(segments(spark, (0, "paragraph", "This paragraph continues"), (1, "paragraph", "on the next page after a page break."))).collect()
    assert [(r["text"], r["merged_from"]) for r in out] == [("This paragraph continues on the next page after a page break.", ["s0", "s1"])]


def test_heading_is_a_barrier(spark):
    out = folds.merge_continuations(segments(spark, (0, "paragraph", "This goes"), (0, "heading", "2 Results"), (0, "paragraph", "on here."))).collect()
    assert [r["role"] for r in out] == ["paragraph", "heading", "paragraph"]


def test_merge_over_a_table_and_hyphen(spark):
    out = folds.merge_continuations(segments(spark, (0, "paragraph", "a split-"), (0, "table", "| x |"), (0, "paragraph", "word here."))).collect()
    assert sorted(r["text"] for r in out) == ["a splitword here.", "| x |"]


def test_greedy_packing(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate([3, 4, 9, 1, 1])], "g string, o int, n int")
    got = {r["o"]: r["chunk"] for r in folds.pack(df, "g", "o", F.col("n"), 8).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}


def test_section_paths_pop(spark):
    df = spark.createDataFrame([("d", 1, 1, "A"), ("d", 2, None, "x"), ("d", 3, 2, "B"), ("d", 4, 1, "C"), ("d", 5, 3, "D"), ("d", 6, 2, "E")], "doc string, pos int, level int, label string")
    got = {r["pos"]: r["section_path"] for r in structure.section_paths(df, "doc", "pos", "level", "label").collect()}
    assert got == {1: ["A"], 2: ["A"], 3: ["A", "B"], 4: ["C"], 5: ["C", "D"], 6: ["C", "E"]}


def test_running_text(spark):
    rows = [("d", p, i, t, y) for p in range(4) for i, (t, y) in enumerate([(f"My Paper page {p}", 0.05), (f"Body {'abcd'[p]} says much", 0.5)])]
    lines = spark.createDataFrame(rows, "doc string, page int, n int, line string, y double")
    found = structure.running_text(lines, "doc", "page", "line", "y")
    assert [(r["canonical"], r["place"]) for r in found.collect()] == [("my paper page", "header")]
    assert {r["text"] for r in structure.remove_running_text(lines, found, "doc", "page", "line", "n").collect()} == {f"Body {c} says much" for c in "abcd"}


def test_html_spans():
    page = "<table><tr><th colspan=2>T</th><th>S</th></tr><tr><td rowspan=2>a</td><td>b<td>c</tr><tr><td>d</td><td>e</td></tr></table>"
    ((matrix, cells),) = html.parse_tables(page)
    assert matrix == [["T", "T", "S"], ["a", "b", "c"], ["a", "d", "e"]]
    assert sum(c["row_span"] * c["col_span"] > 1 for c in cells) == 2
    assert html.parse_tables(None) == [] and html.parse_tables("<table></table>") == []


def greedy(rows, limits):
    """The walk that apply_limits replaces."""
    docs, units, out = {}, {}, []
    for _, d, u in rows:
        if d:
            if limits.per_document and docs.get(d, 0) >= limits.per_document:
                continue
            if limits.per_unit and u and units.get((d, u), 0) >= limits.per_unit:
                continue
            units[d, u] = units.get((d, u), 0) + 1
            docs[d] = docs.get(d, 0) + 1
        out.append((_, d, u))
        if len(out) >= limits.target_k:
            break
    return out


@pytest.mark.parametrize("limits", [retrieval.Limits(9, 3, 2), retrieval.Limits(30, 4, 1), retrieval.Limits(5, None, None), retrieval.Limits(30, 2, None)])
def test_limits_equal_the_greedy_walk(spark, limits):
    rows = [(i, ["a", "b", "", "c"][i * 7 % 4], ["1", "2", ""][i * 5 % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, document_id string, unit string")
    assert [tuple(r) for r in retrieval.apply_limits(df, [F.asc("i")], limits, unit="unit").collect()] == greedy(rows, limits)


def test_result_limits():
    assert retrieval.result_limits(5, 1, "broad") == retrieval.Limits(14, 14, 2)
    assert retrieval.result_limits(5, 3, "narrow") == retrieval.Limits(15, 5, None)
    assert retrieval.result_limits(5, 0, "broad") == retrieval.Limits(5, None, None)
    assert retrieval.pool_size(5) == 15 and retrieval.pool_size(20) == 50
    with pytest.raises(ValueError, match="between"):
        retrieval.parse_k(21)


def test_keyword_needs_all_terms(spark):
    df = spark.createDataFrame([("1", "n", "alpha beta"), ("2", "n", "alpha x x x beta"), ("3", "n", "alpha"), ("4", "n", None)], "block_id string, document_name string, text string")
    got = {r["block_id"]: round(r["keyword_score"], 6) for r in retrieval.keyword_matches(df, ["alpha", "beta"]).collect()}
    assert got == {"1": 0.1, "2": 0.025}
    assert retrieval.keyword_matches(df, []).count() == 0


def test_scope_outside_is_an_error(spark):
    links = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    docs = spark.createDataFrame([("d1", False), ("d2", True)], "document_id string, is_deleted boolean")
    assert [r[0] for r in retrieval.scope_documents(links, docs).collect()] == ["d1"]
    with pytest.raises(ValueError, match="d2"):
        retrieval.scope_documents(links, docs, spark.createDataFrame([("d2",)], "document_id string"))


def test_guardrail_cases(spark):
    answers = spark.createDataFrame([(1, ["x"], ["b1"]), (2, ["b1", "b1", "no"], ["b1"]), (3, None, ["b1"])], "answer_id int, citation_block_ids array<string>, result_ids array<string>")
    answers = answers.withColumns({"answer_text": F.lit("t"), "confidence": F.lit("high"), "prompt_version": F.lit("v")})
    got = {r["answer_id"]: (r["citation_block_ids"], r["confidence"]) for r in conversation.guardrail(answers.where("answer_id < 3")).collect()}
    assert got == {1: ([], "insufficient"), 2: (["b1"], "high")}


def test_session_boundary_is_exact(spark):
    t = datetime(2024, 1, 1)
    rows = [(i, "m", t + timedelta(seconds=s), e) for i, (s, e) in enumerate([(0, False), (59, False), (119, False), (120, True), (121, False)])]
    df = spark.createDataFrame(rows, "i int, k string, ts timestamp, err boolean")
    got = [(r["session_no"], r["used"]) for r in quota.session_counts(df, ["k"], "ts", F.lit(1), "i", F.col("err")).orderBy("i").collect()]
    assert got == [(1, 1), (1, 2), (2, 1), (3, 1), (4, 1)]


def test_backoff_and_failure(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 7, 30)], "n int")
    assert [r[0] for r in df.select(jobs.backoff(F.col("n"))).collect()] == [5.0, 10.0, 300.0, 300.0]


def test_ranges(spark):
    points = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    spans = spark.createDataFrame([(1, 3.0, 11.0), (2, 10.5, 40.0), (3, 60.0, 70.0)], "i int, low double, high double")
    got = sorted((r["x"], r["i"]) for r in joins.points_in_intervals(points, spans, "x", "low", "high", 10).collect())
    assert got == sorted((float(x), i) for x in range(50) for i, a, b in ((1, 3, 11), (2, 10.5, 40), (3, 60, 70)) if a <= x <= b)
    keyed = spans.withColumn("k", F.lit(1))
    assert [tuple(r) for r in joins.overlapping_pairs(keyed, ["k"], "i", "low", "high", 4).collect()] == [(1, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("été\r\n\r\nzwei".encode("cp1252"))
    (tmp_path / "b.md").write_bytes("﻿one".encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "my_pic-1.png").write_bytes(b"\x89PNG")
    (tmp_path / "copy.png").write_bytes(b"\x89PNG")
    found = files.binary(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.texts(found).collect()}
    assert got == {"a.txt": "été\r\n\r\nzwei", "b.md": "one"}
    assert [r["text"] for r in files.text_segments(files.texts(found).where("path like '%a.txt'")).orderBy("paragraph_index").collect()] == ["été", "zwei"]
    assets = files.images(found)
    assert {r["caption"] for r in assets.collect()} == {"my pic 1", "copy"}
    assert [len(r["paths"]) for r in files.unique_assets(assets).collect()] == [2]


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_zip_fallbacks(spark, tmp_path):
    page = [{"type": "title", "content": {"title_content": [{"content": "T1"}], "level": "2"}}, {"type": "paragraph", "bbox": [0, 0, 10, 10], "content": {}}, {"type": "text", "text": "no content"}]
    flat = [{"type": "text", "text": "far", "page_idx": 0, "bbox": [50, 50, 60, 60]}, {"type": "text", "text": "near", "page_idx": 0, "bbox": [2, 0, 12, 10]}]
    (tmp_path / "v2.zip").write_bytes(zipped({"x/content_list_v2.json": json.dumps([page, [{"type": "paragraph", "content": {"paragraph_content": [{"type": "text", "content": "p2"}]}}]]), "x/content_list.json": json.dumps(flat), "x/a.md": "# T"}))
    (tmp_path / "flat.zip").write_bytes(zipped({"content_list.json": '[{"type": "text", "text": "f", "page_idx": 3}]'}))
    (tmp_path / "md.zip").write_bytes(zipped({"full.md": "## Head\n\nbody text"}))
    (tmp_path / "deck.pptx").write_bytes(zipped({"ppt/slides/slide1.xml": '<r xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>Hi</a:t></a:r></a:p></r>'}))
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(str(tmp_path))
    blocks = files.intermediate_blocks(files.manifest(files.zip_members(archives)))
    got = sorted((r["path"].rsplit("/", 1)[1], r["page_index"], r["order_index"], r["block_type"], r["text"]) for r in blocks.collect())
    assert got == [("flat.zip", 3, 0, "paragraph", "f"), ("md.zip", 0, 0, "heading", "Head"), ("md.zip", 0, 1, "paragraph", "body text"), ("v2.zip", 0, 0, "heading", "T1"), ("v2.zip", 0, 1, "paragraph", "near"), ("v2.zip", 1, 0, "paragraph", "p2")]
    assert [(r["slide"], r["text"]) for r in files.slides(files.binary(spark, str(tmp_path))).collect()] == [(1, "Hi")]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_by_key(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    sinks.replace_by_key(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    log = str(tmp_path / "log")
    for n, v in ((1, "old"), (2, "new")):
        sinks.append_versions(spark.createDataFrame([("x", v)], "k string, v string"), log, F.lit(n))
    assert [tuple(r) for r in sinks.read_latest(spark.read.parquet(log), ["k"]).collect()] == [("x", "new")]
    assert "<td>&lt;1&gt;</td>" in sinks.html_report("r", {"n": "<1>"})


def test_stream_sessions_and_dedup(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("m", t + timedelta(seconds=s)) for s in (0, 59, 119, 119, 400)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("k string, ts timestamp").parquet(source)
    out = usage.drain(usage.first_of_each(stream, ["k", "ts"]), str(tmp_path / "a"))
    assert out.count() == 4
    done = usage.drain(usage.sessions(stream, "k", late="1 second"), str(tmp_path / "b"), "append")
    assert sorted(r["used"] for r in done.collect()) == [2, 2]
    assert usage.days(stream, "k").isStreaming and usage.sliding(stream, "k").isStreaming


def test_models(spark):
    df = spark.createDataFrame([("d", i, f"line {i} " + "w " * 30) for i in range(20)], "doc_id string, reading_order int, text string")
    out = models.summarise(df, chunk_tokens=60, batch_tokens=200).collect()
    assert len(out) == 1 and out[0]["summary"]
    v = df.limit(1).select(models.hashing_embedder(8)(F.lit("a a b")).alias("v")).first()["v"]
    assert len(v) == 8 and sum(abs(x) for x in v) in (1.0, 3.0)
    e = df.limit(1).select(models.model_embedder(lambda ts: [[float(len(t))] for t in ts])(F.lit("abc")).alias("v")).first()["v"]
    assert e == [3.0]
    assert models.first_sentences(pd.Series([None])).tolist() == [""]


def test_empty_inputs(spark):
    lines = structure.lines(spark.createDataFrame([], "doc_id long, text string"))
    assert lines.count() == 0
    assert structure.section_paths(lines.withColumns({"level": F.lit(None).cast("int")}), "doc_id", "reading_order", "level", "text").count() == 0
    assert folds.merge_continuations(spark.createDataFrame([], SEGMENT)).count() == 0
    assert joins.positions(lines, [F.asc("doc_id")], "n").count() == 0


def test_containment_of_whole_items(spark):
    items = [(1, "short"), (2, "two words"), (3, "日本語の文章を引用する"), (4, "x"), (5, ""), (6, None), (7, "é💡"), (8, "a b  c d\ne the end of it"), (9, "ends with blank "), (9, "ends with blank "), (10, "Extraordinarilylongwords acknowledgement"), (None, "one two three")]
    texts = [(1, "a shortage"), (2, "my two words"), (3, "これは日本語の文章を引用するものです。"), (4, "日本語の文章"), (5, ""), (6, None), (7, "an é💡 x"), (8, "za b  c d\ne the end of items"), (8, "za b c d e the end of items"), (9, "it ends with blank s"), (None, "none two three"), (10, "extraordinarilylongwords"), (11, "one two three" * 2)]
    expected = Counter((i, d) for i, x in items for d, t in texts if x is not None and t is not None and x in t)
    df = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, conversation.containment(df, spark.createDataFrame(texts, "doc_id long, text string")).collect())) == expected


def test_every_order_is_linearised(spark):
    orders = spark.read.parquet(f"{DATA}/lineitem.parquet").groupBy("l_orderkey").count()
    got = ingestion.table_linearise(spark, DATA).select("l_orderkey", "n_rows")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, orders.collect()))


def test_skipped_files_are_counted_not_collected(spark):
    df = spark.createDataFrame([("a", 10), ("a", 5), ("a", 5), ("a", 40), (None, 5), (None, 20), ("b", 0)], "source string, doc_id long")
    out = study._skipped(df)
    said = "Some files were skipped due to unsupported format: "
    assert dict(map(tuple, out.collect())) == {"a": said + "5.bin, 5.bin and 2 more.", None: said + "5.bin, 20.bin.", "b": said + "0.bin."}
    # At most two rows a source leave a task.
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_dense_search_of_all_labels(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 7)
    rng = random.Random(8)
    rows = [(i, [float(rng.randint(-3, 3)), float(rng.randint(-3, 3)), 1.0], None if i % 4 == 0 else i % 3) for i in range(60)] + [(60, None, 1), (61, [0.0, 0.0, 0.0], 1), (62, [1.0], 1), (63, [float("nan"), 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "block_id long, embedding array<double>, label int").repartition(3)
    asked = df.where("block_id % 20 = 0").select(F.col("block_id").alias("query_id"), F.col("embedding").alias("query_vector"))

    def score(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        return min(1.0, max(0.0, (dot(a, b) / (math.sqrt(dot(b, b)) * math.sqrt(dot(a, a))) + 1) / 2))

    expected = set()
    for q in (0, 20, 40):
        best = sorted((-score(rows[q][1], v), i) for i, v, _ in rows[:60] if i != q)[:5]
        expected |= {(q, i, n + 1, round(-s, 9)) for n, (s, i) in enumerate(best)}
    got = retrieval.dense_topk_per_query(df, asked, 5).collect()
    assert {(r["query_id"], r["block_id"], r["rank"], round(r["vector_score"], 9)) for r in got} == expected and len(got) == 15


def test_sliding_counts_over_slices(spark):
    rng = random.Random(4)
    base = datetime(2024, 1, 1, 0, 59)
    # A hot key, ties, the exact far end of a window, the ends of slices, no time.
    rows = [(i, "hot" if i % 3 else None, base + timedelta(seconds=rng.choice([0, 59, 60, 3599, 3600, 7200, rng.randint(0, 20_000)]))) for i in range(300)] + [(300, "hot", None), (301, "hot", None)]
    df = spark.createDataFrame(rows, "i int, k string, ts timestamp")
    for seconds in (60, 1800, 7200):
        got = {r["i"]: r["n"] for r in quota.sliding_counts(df, ["k"], "ts", seconds, "n").collect()}
        within = lambda x, y: x is None and y is None or None not in (x, y) and timedelta(0) <= y - x < timedelta(seconds=seconds)  # noqa: B023, E731
        assert got == {i: sum(k == q and within(t, ts) for _, q, t in rows) for i, k, ts in rows}


def test_sliding_counts_of_dense_events(spark):
    """Every event of a minute sees all before it: the work is by event, not by the events in its window."""
    df = spark.range(200_000).select("id", F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * 100).alias("ts"))
    began = time.monotonic()
    got = quota.sliding_counts(df, ["k"], "ts", 10, "n").agg(F.max("n"), F.sum("n")).first()
    assert tuple(got) == (100_000, 100_000 * 100_001 // 2 + 100_000 * 100_000)
    assert time.monotonic() - began < 60


def test_merges_by_the_word_ends_of_sql(spark, tmp_path):
    spark.createDataFrame([(1, "open\nAsñ x"), (2, "open\nAsn x"), (3, "open\nAs x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["merged"] for r in catalog.queries()["page_merges"](spark, str(tmp_path)).where("page = 1").collect()}
    want = duckdb.sql(catalog.oracle_sql()["page_merges"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"))
    assert got == {d: m for d, p, m in want.fetchall() if p == 1} == {1: "open Asñ x", 2: None, 3: "open As x"}


def test_packing_goes_on_over_batches(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randint(0, 6)) for g, n in ((None, 40), (1, 3000), (2, 1)) for i in range(n)] + [(3, 0, None)]
    expected = {}
    for g in (None, 1, 2, 3):
        used = chunk = 0
        for _, i, n in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            if used and used + (n or 0) > 10:
                used, chunk = 0, chunk + 1
            used += n or 0
            expected[g, i] = chunk
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = folds.pack(spark.createDataFrame(rows, "g int, o int, n int").repartition(5), "g", "o", F.col("n"), 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["g"], r["o"]): r["chunk"] for r in got} == expected and len(got) == len(rows)


def test_paragraphs_by_place_and_section(spark):
    def merged(a, b):
        rows = [("d", str(i), p, i, "paragraph", t, box, path) for i, (p, t, box, path) in enumerate((a, b))]
        return folds.merge_continuations(spark.createDataFrame(rows, SEGMENT)).count() == 1

    left, right, low = [0.1, 0.5, 0.4, 0.9], [0.6, 0.1, 0.9, 0.3], [0.1, 0.95, 0.4, 0.99]
    assert merged((0, "The end is", left, ["A"]), (0, "Open", right, ["A"]))
    assert merged((0, "The end is", left, None), (0, "Open", low, None))
    assert not merged((0, "The end is", right, ["A"]), (1, "Open", right, ["B"]))
    assert not merged((0, "The end.", left, ["A"]), (0, "Open", right, ["A"]))
    assert not merged((0, "The end is", left, None), (2, "open", left, None))
    assert not merged((0, None, None, None), (0, "open", None, None))


def test_covers_against_brute_force(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "x", "y"]) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(60, None)]

    def covers(ws, terms):
        stretches = [(p, q) for p in range(len(ws)) for q in range(p, len(ws)) if set(terms) <= set(ws[p : q + 1])]
        least = [(p, q) for p, q in stretches if not any((p <= r and s <= q and (p, q) != (r, s)) for r, s in stretches)]
        return round(min(1.0, sum(0.1 / (1 + q - p + 1 - len(terms)) for p, q in least)), 9) if least else None

    df = spark.createDataFrame(docs, "block_id int, text string")
    for terms in (["a"], ["a", "b"], ["c", "a", "b"], ["zz", "a"]):
        got = retrieval.keyword_matches(df, terms)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        expected = {i: s for i, t in docs if (s := covers((t or "").split(), terms)) is not None}
        assert {r["block_id"]: round(r["keyword_score"], 9) for r in got.collect()} == expected


def test_odd_page_items_give_no_crash(spark):
    """Items and fields of any shape: no text or box instead of an error; html at any depth; tables left open."""
    odd = [3, None, "x", [], {}, {"type": 5}, {"type": "image", "content": {"image_source": "a.png"}}, {"type": "image", "content": {"image_source": {"path": 4}}}, {"type": "list", "content": {"list_items": 7}}, {"type": "list", "content": {"list_items": [1, {"item_content": "i"}]}}, {"type": "paragraph", "content": "text", "bbox": [1, 2, 3, "a"]}, {"type": "paragraph", "content": {"paragraph_content": {"deep": 1}}, "bbox": "box"}, {"type": "title", "content": {"title_content": "t", "level": None}}, {"type": "other", "content": ["a", {"text": "b"}]}, {"type": "table", "content": {"x": [{"body_HTML": "<tr><td>1<td>2"}], "table_footnote": "f"}}, {"type": "table", "content": {"table_body": None}}]
    rows = [("a", json.dumps([odd, 5, None])), ("b", "not json"), ("c", None), ("d", "{}"), ("e", "[" * 5000), ("f", json.dumps([[{"type": "page_number", "content": {"page_number_content": "7"}}]]))]
    df = spark.createDataFrame(rows, "path string, content string")
    got = {(r["path"], r["order_index"]): r for r in blocks.page_blocks(df).collect()}
    assert got["a", 9]["list_items"] == ["i"] and got["a", 8]["list_items"] == [] and got["a", 6]["image_path"] == ""
    assert got["a", 10]["bbox"] is None and got["a", 13]["text"] == "a b" and got["a", 12]["text_level"] == 1
    assert got["a", 14]["text"] == "| 1   | 2   |\n|-----|-----|\nf" and got["f", 0]["block_type"] == "page_number"
    assert not {("a", i) for i in range(6)} & set(got)
    flat = blocks.flat_blocks(spark.createDataFrame([("a", json.dumps([*odd, {"type": "footer", "text": "end", "page_index": 2}, {"type": "figure", "img_path": 3, "text": "cap"}]))], "path string, content string")).collect()
    assert ("page_footer", "end", 1) in {(r["block_type"], r["text"], r["page_index"]) for r in flat}
    assert blocks.page_blocks(df.limit(0)).count() == 0


def test_boxes_overlap_once(spark):
    """Each pair once whatever the cells; edges that touch, turned boxes and nulls share nothing."""
    rng = random.Random(6)
    boxes = lambda n: [(rng.randint(0, 2), i, [x := rng.uniform(-20, 20), y := rng.uniform(-20, 20), x + rng.uniform(0, 9), y + rng.uniform(0, 9)]) for i in range(n)]
    a, b = boxes(80), boxes(80)
    a += [(0, 900, [0.0, 0.0, 5.0, 5.0]), (0, 901, None), (0, 902, [5.0, 0.0, 1.0, 5.0])]
    b += [(0, 900, [5.0, 0.0, 9.0, 5.0])]
    want = {}
    for p, i, u in a:
        for q, j, v in b:
            if p == q and u and v and u[0] < u[2]:
                w, h = (min(u[k + 2], v[k + 2]) - max(u[k], v[k]) for k in (0, 1))
                if w > 0 and h > 0:
                    want[p, i, j] = w * h
    left, right = (spark.createDataFrame(x, "page int, id int, box array<double>") for x in (a, b))
    for cell in (1.5, 7.0, 100.0):
        got = joins.overlapping_boxes(left, right, ["page"], cell).collect()
        assert len(got) == len(want) and {(r["page"], r["left_id"], r["right_id"]): pytest.approx(r["overlap"]) for r in got} == want
    best = {(r["page"], r["left_id"]): r["right_id"] for r in joins.best_overlap(joins.overlapping_boxes(left, right, ["page"], 7.0), ["page"]).collect()}
    assert best == {k: min((j for p, i, j in want if (p, i) == k), key=lambda j: (-want[*k, j], j)) for k in {(p, i) for p, i, _ in want}}
    assert joins.overlapping_boxes(left.limit(0), right, ["page"], 7.0).count() == 0
