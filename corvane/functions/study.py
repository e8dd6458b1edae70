"""Prompt profiles, study aids, titles and estimates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.scopes import any_of, collapse, strip

# Profiles in order of precedence, what is searched, and the phrases that choose them.
PROFILES = (
    ("summary", "query", ("summarize", "summary", "key points", "overview")),
    ("comparison", "query", ("compare", "difference", "different", "versus", "vs")),
    ("detailed", "query", ("list", "applications", "uses", "explained in this paper", "discussed in this paper")),
    ("causal", "query", ("why ", "why does", "why is", "how does", "how did", "cause", "reason")),
    ("simplify", "context", ("simpler", "simplify", "easier to understand", "plain english", "layman")),
    ("detailed", "context", ("more detail", "more detailed", "elaborate", "expand on", "go deeper")),
    ("explanation", "query", ("explain", "walk me through", "what does this mean")),
    ("definition", "start", ("what is", "define", "how is", "what does")),
)

# Words by which a line reads like a sentence.
HELPERS = ("is", "are", "was", "were", "have", "has", "had", "be", "been", "being", "this", "that", "these", "those", "we", "they", "it", "our", "their", "can", "will", "should", "may", "might", "using", "used", "propose", "present", "show", "shows", "results", "method")


def prompt_profile(query: Column, context: Column) -> Column:
    """The first profile one of whose phrases is found. context: the last two messages, joined by blanks."""
    q = F.lower(strip(F.coalesce(query, F.lit(""))))
    both = F.lower(F.concat_ws(" ", F.nullif(context, F.lit("")), q))
    out: Column | None = None
    for name, where, phrases in PROFILES:
        hay = both if where == "context" else q
        test = any_of([(F.startswith if where == "start" else F.contains)(hay, F.lit(p)) for p in phrases])
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("default")


def valid_cards(cards: Column, count: int) -> Column:
    """Cards (front, back) with something on both sides, at most count."""
    trimmed = F.transform(cards, lambda c: F.struct(strip(F.coalesce(c["front"], F.lit(""))).alias("front"), strip(F.coalesce(c["back"], F.lit(""))).alias("back")))
    return F.slice(F.filter(trimmed, lambda c: (c["front"] != "") & (c["back"] != "")), 1, count)


def valid_nodes(nodes: Column, most: int = 80) -> Column:
    """Mind-map nodes (id, parent_id, text): first of each id, short texts, a root if there is none, at most `most`."""
    own = F.filter(F.transform(nodes, lambda n: F.struct(strip(F.coalesce(n["id"], F.lit(""))).alias("id"), F.nullif(strip(n["parent_id"]), F.lit("")).alias("parent_id"), strip(F.coalesce(n["text"], F.lit(""))).alias("text"))), lambda n: (n["id"] != "") & (n["text"] != ""))
    firsts = F.filter(own, lambda n, i: ~F.exists(F.slice(own, F.lit(1), i), lambda o: o["id"] == n["id"]))
    rooted = F.exists(firsts, lambda n: n["parent_id"].isNull())
    return F.slice(F.transform(firsts, lambda n, i: F.struct(n["id"].alias("id"), F.when(rooted | (i > 0), n["parent_id"]).alias("parent_id"), F.left(n["text"], F.lit(80)).alias("text"))), 1, most)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def duration_label(seconds: Column) -> Column:
    s = F.greatest(F.lit(1), half_up(seconds))
    mins = half_up(s / 60)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(mins.cast("string"), F.when(mins == 1, " min").otherwise(" mins")))


def processing_seconds(size_bytes: Column) -> Column:
    """18 s and 4.2 s a megabyte, between 20 and 900."""
    return F.least(F.lit(900), F.greatest(F.lit(20), half_up(18 + F.greatest(F.lit(0.0), size_bytes / 1048576) * F.lit(4.2))))


def sentence_like(lines: Column) -> Column:
    """At least half of the lines long and half with a helper word, and a fifth with punctuation."""
    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit("[a-z']+"), F.lit(0))
    n = F.greatest(F.lit(1), F.size(lines))
    share = lambda test: F.size(F.filter(lines, test)) / n
    long = share(lambda s: F.size(words(s)) >= 6)
    helped = share(lambda s: F.arrays_overlap(words(s), F.array(*map(F.lit, HELPERS))))
    marked = share(lambda s: F.rlike(s, F.lit("[.!?,:;]")))
    return (F.size(lines) > 0) & (long >= 0.5) & (helped >= 0.5) & (marked >= 0.2)


def intro_text(documents: Column, summary: Column, points: Column) -> Column:
    """The opening message of a conversation: state, summary and up to three points, a line each."""
    said = F.slice(F.filter(F.transform(points, collapse), lambda p: p != ""), 1, 3)
    lead = F.when(documents == 1, "Your 1 document is processed and ready for Q&A.").when(documents > 1, F.concat(F.lit("Your "), documents.cast("string"), F.lit(" documents are processed and ready for Q&A."))).otherwise("Your documents are processed and ready for Q&A.")
    s = strip(F.coalesce(summary, F.lit("")))
    return F.concat(
        lead,
        F.when(s != "", F.concat(F.lit("\n\nConversation summary: "), s)).otherwise(""),
        F.when(F.size(said) > 0, F.concat(F.lit("\n\nKey points:\n"), F.array_join(F.transform(said, lambda p: F.concat(F.lit("- "), p)), "\n"))).otherwise(""),
    )


def skipped_files(names: Column, total: Column | None = None) -> Column:
    """The warning about files of unsupported kind: two by name, the rest as a number. total: where names holds only the first two."""
    rest = (F.size(names) if total is None else total) - 2
    return F.concat(F.lit("Some files were skipped due to unsupported format: "), F.array_join(F.slice(names, 1, 2), ", "), F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise(""), F.lit("."))
