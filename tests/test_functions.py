from __future__ import annotations

import math
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import gate, geometry, jsonfix, scopes, text, vectors
from corvane.operators.stem import stem


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        (None, ""),
        ("", ""),
        ("a\r\nb", "a b"),
        ("hyphen-\nated word", "hyphenated word"),
        ("- one\n- two", "- one\n- two"),
        ("- one\ntwo", "- one two"),
        ("a\n\n\n\nb  \t c", "a\n\nb c"),
        ("a\n \nb", "a\n\nb"),
    ],
)
def test_clean(spark, raw, expected):
    assert one(spark, text.clean(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(("raw", "level"), [("2.1 Title", 2), ("3 Results", 1), ("Title", None), ("1.2.3", 3), ("", None)])
def test_heading_level(spark, raw, level):
    assert one(spark, text.heading_level(F.lit(raw))) == level


@pytest.mark.parametrize(
    ("role", "raw", "expected"),
    [("heading", "x", "heading"), ("", "1) item", "list"), ("reference_entry", "x", "note"), ("", "Table 3 shows", "caption"), (None, None, "paragraph")],
)
def test_text_role(spark, role, raw, expected):
    assert one(spark, text.text_role(F.lit(role).cast("string"), F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    ("query", "scope"),
    [("", "narrow"), ("What is X?", "narrow"), ("What is X? And Y?", "broad"), ("tell me more about it", "broad"), ("please compare them", "broad"), ("w " * 15, "broad"), ("w " * 14, "narrow")],
)
def test_query_scope(spark, query, scope):
    assert one(spark, scopes.query_scope(F.lit(query))) == scope


def test_normalize_query_drops_one_mark(spark):
    assert one(spark, scopes.normalize_query(F.lit("  a  b?? "))) == "a b?"


@pytest.mark.parametrize(("role", "sections", "reason"), [("note", ["x"], "reference_note"), ("p", ["Intro", " Works cited A"], "works_cited"), ("p", [], ""), ("p", ["References", "Abstract"], "references")])
def test_filter_reason(spark, role, sections, reason):
    column = F.array(*map(F.lit, sections)).cast("array<string>")
    assert one(spark, scopes.filter_reason(F.lit(role), column)) == reason


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-5, 5, allow_nan=False, width=32), min_size=3, max_size=3), st.lists(st.floats(-5, 5, allow_nan=False, width=32), min_size=3, max_size=3))
def test_similarity_is_bounded(spark, a, b):
    s = one(spark, vectors.similarity(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    zero = math.hypot(*a) == 0 or math.hypot(*b) == 0
    assert s is None or zero or 0 <= s <= 1


def test_pad_and_literals(spark):
    v = F.array(F.lit(1.0), F.lit(2.5)).cast("array<float>")
    assert one(spark, vectors.pad(v, 4)) == [1.0, 2.5, 0.0, 0.0]
    assert one(spark, vectors.from_literal(vectors.to_literal(v))) == [1.0, 2.5]
    assert one(spark, vectors.valid(F.lit(None).cast("array<float>"))) is False
    with pytest.raises(Exception, match="exceeds"):
        one(spark, vectors.pad(v, 1))


@pytest.mark.parametrize(("spec", "pages"), [("1-3, 7", [1, 2, 3, 7]), ("5-3", [3, 4, 5]), ("0,2", [2]), ("x", []), ("", []), (None, [])])
def test_page_numbers(spark, spec, pages):
    assert one(spark, text.page_numbers(F.lit(spec).cast("string"))) == pages


def test_tables(spark):
    m = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("long cell"), F.lit("x")))
    assert one(spark, text.markdown_table(m)).split("\n")[1] == "|-----|-----------|-----|"
    rows = one(spark, text.row_objects(F.array(F.lit("h"), F.lit(""), F.lit("k")), F.array(F.array(F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4")))))
    assert rows == [{"h": "2", "k": "3", "column_4": "4"}]
    assert one(spark, text.pipe_matrix(F.lit("| a | b |\n|---|---|\n| 1 | |"))) == [["a", "b"], ["1"]]


def test_markdown_of_a_long_table(spark):
    """Widths are taken once a table: 20,000 rows are a matter of seconds, not of the rows squared."""
    m = F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.array(i.cast("string"), F.lit(" x ")))
    began = time.monotonic()
    lines = one(spark, text.markdown_table(m)).split("\n")
    assert time.monotonic() - began < 30
    assert lines[:3] == ["| 1     | x   |", "|-------|-----|", "| 2     | x   |"] and lines[-1] == "| 20000 | x   |" and len(lines) == 20_001


def test_bounded_list_ignores_case(spark):
    assert one(spark, text.bounded_list(F.array(*map(F.lit, ("A b", "a B", " ", "c d e"))), 5, 4)) == ["A b", "c d"]


def test_gate(spark):
    score = lambda k, c, n: one(spark, gate.gate_score(F.lit(k), F.lit(c), F.lit(n)))
    assert score("chart", "Figure 2", "") == pytest.approx(0.22, abs=1e-9)
    assert score("", "", "") == 0.0
    assert score("chart", "the system architecture of the network pipeline", "as shown in figure") >= gate.THRESHOLD


def test_geometry(spark):
    box = F.array(*map(F.lit, (61.2, 79.2, 306.0, 396.0)))
    assert one(spark, geometry.normalise_bbox(box, F.lit(612.0), F.lit(792.0))) == [0.1, 0.1, 0.5, 0.5]
    assert one(spark, geometry.column_bucket(F.array(*map(F.lit, (0.1, 0.0, 0.9, 1.0))))) == "full"
    assert one(spark, geometry.nearest_rank(F.array(*[F.lit(float(i)) for i in range(101)]))) == 96.0


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": 1,}\n```', {"a": 1}),
        ("says: {“a”: “b”}", {"a": "b"}),
        ('{"a": "x\ny"}', {"a": "x\ny"}),
        ("{'a': True}", {"a": True}),
        ('"answer": "yes", "why": "so"', {"answer": "yes", "why": "so"}),
        ("nothing", None),
        (None, None),
    ],
)
def test_tolerant_json(raw, expected):
    assert jsonfix.parse_object(raw) == expected


def test_repaired_column(spark):
    df = spark.createDataFrame([('{"b":1}',), ("```\n{'a': 2}\n```",), ("no",), (None,)], "raw string")
    assert [r[0] for r in df.select(jsonfix.repaired(F.col("raw"))).collect()] == ['{"b":1}', '{"a":2}', None, None]
    assert df.select(jsonfix.canonical_hash(F.col("raw"))).collect()[2][0] is None


@pytest.mark.parametrize(("word", "expected"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("conditional", "condit"), ("rate", "rate"), ("controlling", "control"), ("été", "été")])
def test_stem(word, expected):
    assert stem(word) == expected


@pytest.mark.parametrize(
    "line,want",
    [("Law civil", "law civil"), ("Law ill", "law ill"), ("17", "<n>"), ("  ", ""), ("Journal of X, Vol. 12, No. 3", "journal of x vol <n> no"), ("12 Smith et al.", "smith et al"), ("ISSN: 1234-567X", "issn <id>"), ("Chapter 4 text", "chapter 4 text"), ("Proceedings, May 2021 (4)", "proceedings may <year> (<n>)"), ("pp. 12-19", "pp <range>")],
)
def test_running_lines(spark, line, want):
    assert one(spark, text.canonical_running_line(F.lit(line))) == want


def test_running_line(spark):
    assert one(spark, text.canonical_running_line(F.lit("Annual  Report 2024 Page 3 of 9"))) == "annual report <year> page <n> of"
    assert re.fullmatch("[0-9a-f]{64}", one(spark, text.content_hash(F.lit("a"), F.lit(None).cast("string"))))
