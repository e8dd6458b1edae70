"""Query normalisation and rule-based classifiers of queries and blocks, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section titles whose blocks are filtered, in order of precedence.
FILTERED_SECTIONS = ("abstract", "references", "bibliography", "works cited", "literature cited")

# Openings of vague follow-up questions.
FOLLOW_UPS = ("tell me more", "elaborate", "more detail", "give an example", "can you explain", "what do you mean", "go on", "continue")

# Phrases of questions that need many passages.
BROAD_PHRASES = (
    "list all", "list the", "list every", "main points", "key points", "key concepts", "overview of", "summarize", "summary of",
    "compare", "contrast", "advantages and disadvantages", "pros and cons", "challenges and", "future directions",
    "explain the concept", "explain how", "explain why", "applications of", "uses of", "what are the", "what were the",
    "describe all", "describe the main",
)

#: Words from which a question is broad whatever it says.
BROAD_WORDS = 15


def strip(x: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def non_blank(x: Column) -> Column:
    return F.coalesce(strip(x) != "", F.lit(False))


def normalize_query(q: Column) -> Column:
    """Collapse white space and drop one closing '?' or '.'."""
    return F.trim(F.regexp_replace(collapse(F.coalesce(q, F.lit(""))), r"[?.]$", ""))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def query_scope(q: Column) -> Column:
    """'broad' for several questions, vague follow-ups, listing phrases or long queries; else 'narrow'."""
    text = F.lower(strip(F.coalesce(q, F.lit(""))))
    many = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit(""))) > 1
    vague = any_of([F.startswith(text, F.lit(m)) for m in FOLLOW_UPS])
    listing = any_of([F.contains(text, F.lit(p)) for p in BROAD_PHRASES])
    long = F.size(F.split(collapse(text), " ")) >= BROAD_WORDS
    return F.when(text == "", "narrow").when(many | vague | listing | long, "broad").otherwise("narrow")


def filter_reason(role: Column, sections: Column) -> Column:
    """'reference_note' for notes, else the first marker that the first matching section starts with, else ''."""
    hits = F.flatten(
        F.transform(
            F.transform(F.filter(sections, lambda s: s.isNotNull() & (s != "")), lambda s: F.lower(strip(s))),
            lambda s: F.filter(F.transform(F.array(*map(F.lit, FILTERED_SECTIONS)), lambda m: F.when(F.startswith(s, m), F.replace(m, F.lit(" "), F.lit("_")))), lambda x: x.isNotNull()),
        )
    )
    return F.when(role == "note", "reference_note").otherwise(F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("")))


def relevance_reason(block_type: Column, subtype: Column, role: Column, sections: Column, reason: Column) -> Column:
    """Why a block was returned, in words."""
    return (
        F.when(reason == "reference_note", "filtered reference note")
        .when(reason != "", F.concat(F.lit("filtered "), F.replace(reason, F.lit("_"), F.lit(" "))))
        .when(block_type == "table", "matched table context")
        .when(block_type == "diagram", "matched diagram caption or nearby context")
        .when(role == "caption", "matched caption text")
        .when(role == "heading", "matched section heading")
        .when(F.coalesce(F.size(sections), F.lit(0)) > 0, "matched body paragraph within section")
        .when(F.coalesce(subtype, F.lit("")) != "", F.concat(F.lit("matched "), subtype))
        .otherwise("matched body paragraph")
    )


def snippet(text: Column, limit: int = 900) -> Column:
    """Text of at most `limit` characters, with '...' where it was cut."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(limit)), r"(?U)\s+$", ""), F.lit("...")))
