"""Paragraphs and first pages against plain walks over lines."""

from __future__ import annotations

import json
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import blocks as B
from corvane.operators import html, pages, review, structure, typed
from corvane.plans import catalog
from corvane.shared import dealt
from tests.conftest import DATA

LINE = "doc long, order_index int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, bold boolean, italic boolean, page_height double"


def heading(text, size, emphatic, body):
    t = " ".join(text.split())
    if not t or len(t) > 120:
        return False
    numbered = re.match(r"\d+\.\d+\b|\d+\.\s*[A-Z]|\d+\s+[A-Z]", t) or t.lower().startswith(("chapter", "section"))
    return bool(numbered or (t.isupper() and len(t.split()) <= 12) or (emphatic and size >= body * 1.04 and t[-1] not in ".!?"))


def is_item(text):
    return bool(re.match(r"\s*(?:[-*•]|\d+[.)]|[A-Za-z][.)])\s+", text))


def walk_paragraphs(lines):
    body = statistics.median([x["font_size"] for x in lines if x["font_size"]] or [11.0])
    groups = []
    for x in lines:
        p = groups[-1][-1] if groups else None
        emphatic = x["bold"] or x["italic"]
        if p is None or (
            x["y0"] - p["y1"] > max(p["font_size"], x["font_size"], 8)
            or abs(x["x0"] - p["x0"]) > 80
            or (is_item(x["text"]) and not is_item(p["text"]))
            or heading(x["text"], x["font_size"], emphatic, body)
            or (p["text"].strip()[-1:] in (".", "!", "?") and p["text"].strip() and re.match("[A-Z]", x["text"].strip()) and abs(x["x0"] - p["x0"]) > 12)
        ):
            groups.append([])
        groups[-1].append(x)
    out = []
    for n, group in enumerate(groups, 1):
        text = ""
        for s in [s.strip() for x in group for s in x["text"].splitlines() if s.strip()]:
            if not text:
                text = s
            elif text.endswith("-") and s[0].islower():
                text = text[:-1] + s
            else:
                text += ("\n" if is_item(s) else " ") + s
        whole = " ".join(x["text"].strip() for x in group if x["text"].strip())
        role = "list" if is_item(whole) else "heading" if heading(whole, group[0]["font_size"], group[0]["bold"] or group[0]["italic"], body) else "paragraph"
        if text:
            out.append((n, role, " ".join(text.split()), len(group)))
    return out


def words(text):
    return re.findall(r"\w+", re.sub(r"(^|\n|\s)(?:\d+|[A-Za-z])[.)]\s", r"\1", text))


def page_of(rng, doc):
    y, lines = 0.0, []
    for i in range(rng.randint(0, 25)):
        size = rng.choice([0.0, 9.0, 10.0, 10.0, 14.0])
        y += rng.choice([0.0, 1.0, 9.5, 30.0])
        text = rng.choice(["Plain words go on", "end of it.", "Capital start", "- item one", "2) item two", "1.2 Methods", "3 Results", "ALL CAPITALS", "Section four", "hyphen-", "ated word", "--", " ", "two\nlines", "lower. A bold title", "x" * 130])
        x = rng.choice([10.0, 10.0, 25.0, 120.0])
        lines.append({"doc": doc, "order_index": i, "text": text, "x0": x, "y0": y, "x1": x + 50, "y1": y + 10, "font_size": size, "bold": rng.random() < 0.2, "italic": False, "page_height": 100.0})
        y += 10
    return lines


def test_paragraphs_read_each_line_once(spark):
    """A line's patterns stand in the plan once; without text and role, lines are neither joined nor collected."""
    made = pages.paragraphs(spark.createDataFrame([], LINE), "doc")
    lean = made.select("doc", "paragraph_index", "bbox", "n_lines")._jdf.queryExecution().optimizedPlan().toString()
    assert lean.count(pages.NUMBERED_HEADING) == 1 and lean.count(pages.LIST_ITEM) == 1 and "collect_list" not in lean
    # Lines of separators only make a paragraph that has no text, and so no row.
    odd = ["\x1c", " \u3000\x1e", "\n\x85\u2028", None, "\x1f", "-", "\u200b"]
    rows = [(i, 0, t, 0.0, 0.0, 1.0, 1.0, 10.0, False, False, 100.0) for i, t in enumerate(odd)]
    found = pages.paragraphs(spark.createDataFrame(rows, LINE), "doc")
    assert sorted(r["doc"] for r in found.collect()) == [4, 5, 6] == sorted(r["doc"] for r in found.where("text <> ''").collect())
    assert found.select("doc", "n_lines").count() == 3


def test_paragraphs_equal_a_walk(spark):
    rng = random.Random(12)
    every = {d: page_of(rng, d) for d in range(60)}
    rows = [tuple(x.values()) for own in every.values() for x in own]
    rng.shuffle(rows)
    got = {}
    for r in pages.paragraphs(spark.createDataFrame(rows, LINE), "doc").collect():
        got.setdefault(r["doc"], []).append((r["paragraph_index"], r["role"], words(r["text"]), r["n_lines"]))
    # Cleaning takes list marks away: what is compared is the words.
    want = {d: [(n, role, words(t), k) for n, role, t, k in walk_paragraphs(own)] for d, own in every.items()}
    assert {d: sorted(x for x in v if x[2]) for d, v in got.items() if any(x[2] for x in v)} == {d: [x for x in w if x[2]] for d, w in want.items() if any(x[2] for x in w)}
    odd = spark.createDataFrame([(1, 0, None, None, None, None, None, None, None, None, None), (1, 1, "text", None, 1.0, None, 2.0, None, None, None, None)], LINE)
    assert [(r["text"], r["n_lines"]) for r in pages.paragraphs(odd, "doc").collect()] == [("text", 2)]
    assert pages.paragraphs(odd.limit(0), "doc").count() == 0


def line(i, text, y, size=10.0, bold=False):
    return (1, i, text, 10.0, float(y), 90.0, float(y + size), size, bold, False, 800.0)


@pytest.mark.parametrize(
    "lines, title, authors",
    [
        # The title goes on in its size; a publisher's line is passed over; authors end before the abstract.
        ([line(0, "Procedia Computer Science 12", 10), line(1, "A Study of Spark Engines", 60, 18.0), line(2, "and Their Plans", 80, 18.0), line(3, "Jane Doe, John Roe", 110), line(4, "10.1234/abc.5", 125), line(5, "University of Somewhere", 140), line(6, "Abstract", 160), line(7, "We study things at length.", 180)], "A Study of Spark Engines and Their Plans", "Jane Doe, John Roe University of Somewhere"),
        # Of equals the first; short, low and marked lines are no titles.
        ([line(0, "too short", 10), line(1, "A line of middling length", 50), line(2, "Another line of middling", 300), line(3, "Low on the page it stands", 700, 30.0)], "A line of middling length", "Another line of middling Low on the page it stands"),
        ([line(0, "Keywords: none of these", 10), line(1, "https://example.org/paper", 30), line(2, "ISSN 1234-567X of a journal", 50)], "", ""),
        ([line(0, None, 10), line(1, "", 20)], "", ""),
    ],
)
def test_first_pages(spark, lines, title, authors):
    r = pages.first_pages(spark.createDataFrame(lines, LINE), "doc").collect()[0]
    assert r["title"] == title
    if title.startswith("A Study"):
        assert (r["authors"], r["doi"]) == (authors, "10.1234/abc.5")
    if not title:
        assert r["authors"] == ""
    assert r["issn"] == ("1234-567X" if any("ISSN" in (x[2] or "") for x in lines) else "")


def test_first_pages_empty(spark):
    assert pages.first_pages(spark.createDataFrame([], LINE), "doc").count() == 0


def test_running_lines_that_are_protected(spark):
    """A title that runs through all pages stays on the first and where it first stands; lines in the middle stay."""
    rows = []
    for page in range(1, 5):
        rows += [(1, page, 0, f"Deep Learning {page}", 0.05), (1, page, 1, f"body {'abcd'[page - 1]}", 0.5), (1, page, 2, f"Page {page}", 0.95)]
    rows += [(1, 2, 5, "Deep Learning 9", 0.5), (1, 3, 6, None, 0.01), (2, 1, 0, "Page 1", 0.95), (2, 1, 1, "alone", 0.5)]
    lines = spark.createDataFrame(rows, "doc long, page int, pos int, line string, y double")
    found = structure.running_text(lines.where("y < 0.5 OR y > 0.5 OR pos = 1"), "doc", "page", "line", "y")
    title = spark.createDataFrame([(1, "Deep Learning"), (1, " "), (1, None)], "doc long, line string")
    text = lambda **more: {(r["doc"], r["page"]): r["text"].split("\n") for r in structure.remove_running_text(lines, found, "doc", "page", "line", "pos", **more).collect()}
    got = text(y="y", protected=title)
    assert got[1, 1] == ["Deep Learning 1", "body a"] and got[1, 2] == ["body b", "Deep Learning 9"] and got[1, 3] == ["body c"] and got[2, 1] == ["Page 1", "alone"]
    assert text()[1, 2] == ["body b"] and text(y="y")[1, 1] == ["body a"]
    late = spark.createDataFrame([(1, "page")], "doc long, line string")
    assert text(protected=late)[1, 1] == ["body a", "Page 1"]


def test_typed_blocks(spark):
    """Tables from markup and from bars, malformed ones, blank headers; diagrams with the text beside them."""
    rows = [
        ("d", 0, 0, "paragraph", "before", None, None, None, None, None),
        ("d", 0, 1, "table", "x", " Table 3: sums ", ["n1", " "], "<table>", [["a", "", "b"], ["1", "2", "3"], ["4"]], None),
        ("d", 0, 2, "table", "Bars\n| h | k |\n|---|---|\n| 1 | 2 |\nnote", None, None, "", [], None),
        ("d", 0, 3, "table", "only words", "", None, None, None, None),
        ("d", 0, 4, "table", " ", None, None, None, None, None),
        ("d", 0, 5, "image", None, "Figure 2 a chart of x", None, None, None, "i.png"),
        ("d", 1, 0, "page_header", "head", None, None, None, None, None),
        ("d", 1, 1, "image", None, None, None, None, None, "j.png"),
        ("d", 1, 2, "heading", "after", None, None, None, None, None),
        ("d", 1, 3, "image", None, "", None, None, None, " "),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], "path string, page_index int, order_index int, block_type string, text string, caption string, footnotes array<string>, table_html string, table_rows array<array<string>>, image_path string, bbox array<double>")
    got = {r["order_index"]: r for r in typed.table_blocks(df).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["title"] == "Table 3" and got[1]["caption"] == "Table 3: sums" and got[1]["footnotes"] == ["n1"] and got[1]["quality"] == "native"
    assert got[1]["row_objects"][1] == {"a": "4"} and len(got[1]["cells"]) == 7 and [c["is_header"] for c in got[1]["cells"]][:4] == [True] * 3 + [False]
    assert got[2]["caption"] == "Bars" and got[2]["footnotes"] == ["note"] and got[2]["row_objects"] == [{"h": "1", "k": "2"}]
    assert got[3]["quality"] == "malformed" and got[3]["row_objects"] == [] and got[3]["display_text"] == "only words"
    seen = {(r["page_index"], r["order_index"]): r for r in typed.diagram_blocks(df).collect()}
    assert set(seen) == {(0, 5), (1, 1)}
    assert (seen[0, 5]["kind"], seen[0, 5]["title"], seen[0, 5]["near"]) == ("chart", "Figure 2", "before")
    assert (seen[1, 1]["kind"], seen[1, 1]["near"]) == ("unknown", "after") and "Nearby Context: after" in seen[1, 1]["retrieval_text"]
    assert typed.table_blocks(df.limit(0)).count() == 0 and typed.diagram_blocks(df.limit(0)).count() == 0


def test_running_forms_compute_each_step_once(spark):
    """The plan of a canonical line holds each of its patterns once, not once for each place that reads it."""
    plan = spark.range(1).select(T.canonical_running_line(F.col("id").cast("string")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("month-year") == 1 and plan.count("volume <n>") == 1 and plan.count("et al") == 1
    rows = spark.createDataFrame([("Vol. 3, No. 7",), ("  Page 12 ",), ("17",), ("Plain; text 4 of",), (None,), (" ",)], "x string")
    got = [r[0] for r in rows.select(T.canonical_running_line(F.col("x"))).collect()]
    assert got == ["vol <n> no", "page", "<n>", "plain text 4 of", "", ""]


def test_archives_are_filled_as_they_are_read(spark):
    """archive_blocks gives the rows of filled_blocks, from odd lists too, and deals no block out."""
    box = lambda x: [x, 0.0, x + 8.0, 5.0]
    item = lambda x, text=None: {"type": "paragraph", "bbox": box(x), "content": {"paragraph_content": text}}
    flat = [{"type": "text", "text": t, "page_idx": p, "bbox": b} for t, p, b in (("near", 0, box(1)), ("same distance", 0, box(1)), (" ", 0, box(2)), ("far", 0, box(50)), ("no box", 0, None), ("next", 1, box(9)))]
    cells = {"type": "table", "bbox": box(0), "content": {"table_caption": " T\t1 ", "table_body": "<table><tr><td>a<td>b c<tr><td>1</table>"}}
    pages = [[item(2.0), item(48.0), item(3.0, "own  text"), item(3.0) | {"bbox": [1, True, 2, 3]}, cells], [item(9.0)], [item(9.0)], "odd"]
    rows = [("a", json.dumps(pages), json.dumps(flat)), ("b", json.dumps(pages), "no json"), ("c", json.dumps(pages), None), ("d", "{", json.dumps(flat)), ("e", None, None)]
    df = spark.createDataFrame(rows, "path string, pages string, flat string")
    made = B.page_blocks(df.select("path", F.col("pages").alias("content")))
    want = B.filled_blocks(made, B.flat_blocks(df.select("path", F.col("flat").alias("content"))))
    got = B.archive_blocks(df)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert [r["text"] for r in got.where("path = 'a'").orderBy("page_index", "order_index").collect()][:3] == ["near", "far", "own text"]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, B.page_tables(df.select("path", F.col("pages").alias("content"))).collect())) == sorted(map(repr, made.where("block_type = 'table'").collect()))
    assert B.archive_blocks(df, "path", "text").columns == ["path", "text"]


def test_bare_markup_is_read_as_the_parser_reads_it(monkeypatch):
    rng = random.Random(3)
    marks = ["<table>", "</table>", "<tr>", "</TR>", "<td>", "</td>", "<TH>", "</th>", "<b>", "</b>", "x", "  a b\n", "é", "<br>", "<p>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(25))) for _ in range(500)]
    got = [(html.table_rows(t), html.parse_tables(t)) for t in texts]
    monkeypatch.setattr(html, "_BARE", re.compile(r"(?!)"))
    assert got == [(html.table_rows(t), html.parse_tables(t)) for t in texts]


def test_lines_of_an_order_are_shuffled_once(spark):
    """A shuffle by order for its lines, its blocks and its tables, and no partition of more than some 100,000 lines."""
    for name in ("table_blocks", "archive_blocks", "block_orders"):
        plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == plan.count("REPARTITION_BY_NUM") == 1, name
    many = dealt(spark.range(1_000_000).withColumn("k", F.col("id") % 1000), "k")
    assert many.rdd.getNumPartitions() == 11


def test_payloads_of_all_keys_compute_the_found_ones_once(spark):
    rows = spark.createDataFrame([(1, 5, 7, 2), (1, 6, 7, 2), (1, 4, None, 9), (3, 1, 8, 1)], "q long, block_id int, document_id int, score int")
    keys, found = spark.createDataFrame([(1,), (2,)], "q long"), B.payload(rows, "q", 3)
    got = B.payloads(keys, found, "q")
    want = found.where("q = 1").union(B.empty_payload(keys, found, "q"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert '"documents_covered":1,' in got.where("q = 1").first()["payload"]
    plan = catalog.queries()["retrieval_payloads"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") and plan.count("RepartitionByExpression") == 1 and "Expand" not in plan


def test_review_walks_many_documents_in_one_pass(spark):
    """Chains over batches of rows, blocks out of order, null contexts, a change of an unknown block; no call for each document."""
    links = spark.createDataFrame([(d, b, b, b - 2 if b > 2 else None) for d in range(50) for b in range(400, 0, -1)], "doc_id int, block_id int, pos int, context_id int")
    changed = spark.createDataFrame([(d, 3) for d in range(0, 50, 2)] + [(4, 3), (6, 1000)], "doc_id int, block_id int")
    got = review.impacted(links, changed)
    want = sorted([(d, b) for d in range(0, 50, 2) for b in range(3, 401, 2)] + [(6, 1000)])
    assert sorted(map(tuple, got.collect())) == want and got.dtypes == [("doc_id", "int"), ("block_id", "int")]
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
