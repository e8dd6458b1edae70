"""Lines of pages with their geometry: paragraphs, and the title and authors of a first page.

Lines have the columns of their page, order, text, x0, y0, x1, y1, font_size, bold and italic.
Paragraphs are a fold in columns: each line against the one before it, a flag where a new one
starts, a running sum. What a page's first lines say of it is a fold over the page's array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.scopes import any_of, collapse, strip

# Sizes in points that part paragraphs, and what a page without font sizes has.
LEAST_SIZE, COLUMN_SHIFT, INDENT, NO_SIZE = 8.0, 80.0, 12.0, 11.0
LIST_ITEM = r"^\s*(?:[-*•]|\d+[.)]|[A-Za-z][.)])\s+"
NUMBERED_HEADING = r"^(?:\d+\.\d+\b|\d+\.\s*[A-Z]|\d+\s+[A-Z]|(?i:chapter|section))"
HEADING_CHARS, HEADING_WORDS, LARGER = 120, 12, 1.04
# A sentence's end, a capital at the start, and anything but white space and separators of lines.
SENTENCE_END, CAPITAL, WRITTEN = r"(?U)[.!?]\s*\z", r"(?U)^\s*[A-Z]", r"(?U)[^\s\x1C\x1D\x1E]"

# What marks identifiers, and lines that belong to a journal rather than to a paper.
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"
ISBN = r"(?i)\bISBN(?:-1[03])?:?\s*((?:97[89][-\s]?)?\d(?:[-\s]?\d){8,16}[\dXx])\b"
ISSN = r"(?i)\bISSN(?:\s*\((?:print|online)\))?\s*[:#]?\s*([0-9]{4}-?[0-9]{3}[0-9Xx])\b"
PUBLISHER = r"sciencedirect|procedia|computer science|international conference|\bvol(?:ume)?\.?\s*\d+\b"
YEAR_PAGES = r"\(\d{4}\)\s*\d{2,5}\s*[–-]\s*\d{2,5}"
NO_TITLE = ("abstract", "keywords", "introduction", "doi", "isbn", "issn")


def is_list_item(text: Column) -> Column:
    return F.rlike(text, F.lit(LIST_ITEM))


def is_heading(text: Column, size: Column, emphatic: Column, body: Column) -> Column:
    """Numbered, in capitals, or emphatic and larger than the body without an end mark; at most 120 characters."""
    return T.bound(_title_marks(text), lambda m: _heads(m, size, emphatic, body))


def _heads(marks: Column, size: Column, emphatic: Column, body: Column) -> Column:
    return marks["titled"] | (marks["large"] & emphatic & (size >= body * LARGER))


def _title_marks(text: Column) -> Column:
    """titled: a heading by its words alone; large: one where it is emphatic and larger than the body."""

    def marks(t: Column) -> Column:
        capitals = (F.upper(t) == t) & (F.lower(t) != t) & (F.size(F.split(t, " ")) <= HEADING_WORDS)
        short = (t != "") & (F.length(t) <= HEADING_CHARS)
        return F.struct((short & (F.rlike(t, F.lit(NUMBERED_HEADING)) | capitals)).alias("titled"), (short & ~F.rlike(t, F.lit(r"[.!?]$"))).alias("large"))

    return T.bound(collapse(text), marks)


def paragraphs(lines: DataFrame, *page: str, order: str = "order_index") -> DataFrame:
    """page, paragraph_index (from 1), text, role (heading, list or paragraph), bbox and n_lines.

    A new paragraph starts where the gap exceeds the larger font size, the left edge moves by a
    column, a list or a heading begins, or an indented capital follows the end of a sentence.
    Words split over lines are joined again. Blank paragraphs give no row but keep their number;
    lines of equal order come by their text; null texts are blank, null sizes count as 0. A reader
    that leaves text and role out has them neither made nor their lines collected.
    """
    w = Window.partitionBy(*page).orderBy(order, "text")
    size = F.coalesce("font_size", F.lit(0.0))
    rows = lines.withColumns({"text": F.coalesce("text", F.lit("")), "_size": size, "_emphatic": F.coalesce(F.col("bold") | F.col("italic"), F.lit(False))})
    # What a line's text says is computed once a line; the windows hand on flags, not texts.
    flags = {"_item": is_list_item(F.col("text")), "_ends": F.rlike("text", F.lit(SENTENCE_END)), "_opens": F.rlike("text", F.lit(CAPITAL)), "_written": F.rlike("text", F.lit(WRITTEN)), "_title": _title_marks(F.col("text"))}
    rows = rows.withColumns(flags)
    # The ordered window comes first: those after it need no sort of their own.
    rows = rows.withColumn("_b", F.lag(F.struct("x0", "y1", "_size", "_item", "_ends")).over(w))
    rows = rows.withColumn("_body", F.coalesce(F.median(F.when(F.col("_size") > 0, F.col("_size"))).over(Window.partitionBy(*page)), F.lit(NO_SIZE)))
    p, shift = F.col("_b"), F.abs(F.col("x0") - F.col("_b.x0"))
    parts = any_of([
        F.col("y0") - p["y1"] > F.greatest(p["_size"], "_size", F.lit(LEAST_SIZE)),
        shift > COLUMN_SHIFT,
        F.col("_item") & ~p["_item"],
        _heads(F.col("_title"), F.col("_size"), F.col("_emphatic"), F.col("_body")),
        p["_ends"] & F.col("_opens") & (shift > INDENT),
    ])
    starts = p.isNull() | F.coalesce(parts, F.lit(False))
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("paragraph_index", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    # The lines of one paragraph meet, as its text is one value.
    line = F.struct("_n", "text", "_size", "_emphatic", "_body")
    got = rows.groupBy(*page, "paragraph_index").agg(F.array_sort(F.collect_list(line)).alias("l"), F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bbox"), F.count("*").alias("n_lines"), F.max("_written").alias("_written")).where("_written")
    own = F.filter(F.flatten(F.transform("l", lambda r: F.transform(F.split(r["text"], r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85  ]"), strip))), lambda s: s != "")

    def join(text: Column, s: Column) -> Column:
        split_word = F.endswith(text, F.lit("-")) & F.rlike(s, F.lit(r"^\p{Ll}"))
        return F.when(text == "", s).when(split_word, F.concat(F.rtrim(text, F.lit("-")), F.repeat(F.lit("-"), F.length(text) - F.length(F.rtrim(text, F.lit("-"))) - 1), s)).otherwise(F.concat(text, F.when(is_list_item(s), "\n").otherwise(" "), s))

    whole, first = F.array_join(F.filter(F.transform("l", lambda r: strip(r["text"])), lambda s: s != ""), " "), F.get("l", F.lit(0))
    role = F.when(is_list_item(whole), "list").when(is_heading(whole, first["_size"], first["_emphatic"], first["_body"]), "heading").otherwise("paragraph")
    return got.select(*page, "paragraph_index", T.clean(F.aggregate(own, F.lit(""), join)).alias("text"), role.alias("role"), "bbox", "n_lines")


def _identified(text: Column) -> Column:
    return any_of([F.rlike(text, F.lit(p)) for p in (DOI, ISBN, ISSN)])


def _of_publisher(text: Column) -> Column:
    return F.rlike(F.lower(text), F.lit(PUBLISHER)) | F.rlike(text, F.lit(YEAR_PAGES))


def first_pages(lines: DataFrame, *document: str, order: str = "order_index", height: str = "page_height") -> DataFrame:
    """title, authors, doi, isbn and issn of each document, from the lines of its first page; '' for what is not found.

    The title starts at the line of the highest score (larger than the body, bold, high up, of a
    title's length; the first of equals) and takes up to four lines that go on in about its size;
    authors are up to three of the seven lines after it, before an abstract. The lines of a first
    page meet in one row.
    """
    size = F.coalesce("font_size", F.lit(0.0))
    share = F.when(F.col(height) > 0, F.col("y0") / F.col(height)).otherwise(0.0)
    line = F.struct(F.col(order).alias("o"), strip(F.coalesce("text", F.lit(""))).alias("t"), "y0", "y1", size.alias("s"), F.coalesce("bold", F.lit(False)).alias("b"), share.alias("r"))
    pages = lines.groupBy(*document).agg(F.array_sort(F.collect_list(line)).alias("l"), F.coalesce(F.median(F.when(size > 0, size)), F.lit(NO_SIZE)).alias("body"))
    text = F.array_join(F.filter(F.transform("l", lambda x: x["t"]), lambda t: t != ""), "\n")

    def score(x: Column, i: Column) -> Column:
        t, n = x["t"], F.length(x["t"])
        fits = (x["r"] <= 0.60) & (n >= 12) & (n <= 260) & ~any_of([F.startswith(F.lower(t), F.lit(m)) for m in NO_TITLE]) & ~_identified(t) & ~F.rlike(F.lower(t), F.lit("https?://")) & ~_of_publisher(t)
        points = F.least(F.lit(5.0), F.greatest(F.lit(0.0), x["s"] - F.col("body")) * 0.9)
        for on, more in ((x["b"], 1.2), (x["r"] < 0.35, 1.0), (n.between(18, 180), 0.8), (~F.contains(t, F.lit("\n")), 0.3)):
            points = points + F.when(on, more).otherwise(0.0)
        return F.when(fits, F.struct(points.alias("score"), (-i).alias("i")))

    pages = pages.withColumn("seed", F.array_max(F.array_compact(F.transform("l", score)))).withColumn("at", -F.col("seed.i"))
    seed = F.get("l", F.col("at"))
    large = F.greatest(F.lit(1.0), F.when(seed["s"] != 0, seed["s"]).otherwise(F.col("body")))
    start = F.struct(F.array(seed["t"]).alias("parts"), seed["y1"].alias("y"), F.col("at").alias("end"), F.lit(False).alias("stop"), F.col("at").alias("j"))

    def goes_on(state: Column, x: Column) -> Column:
        j = state["j"] + 1
        passed = state["stop"] | (x["t"] == "") | _of_publisher(x["t"])
        close = F.abs(F.when(x["s"] != 0, x["s"]).otherwise(large) - large) <= F.greatest(F.lit(1.8), large * 0.22)
        fits = ~F.rlike(x["t"], F.lit(r"(?i)^(abstract|keywords)\b")) & (x["y0"] - state["y"] <= F.greatest(F.lit(12.0), large * 1.3)) & close & (F.length(x["t"]) <= 180)
        take = ~passed & F.coalesce(fits, F.lit(False))
        return F.struct(F.when(take, F.concat(state["parts"], F.array(x["t"]))).otherwise(state["parts"]).alias("parts"), F.when(take, x["y1"]).otherwise(state["y"]).alias("y"), F.when(take, j).otherwise(state["end"]).alias("end"), (state["stop"] | (~passed & ~take)).alias("stop"), j.alias("j"))

    pages = pages.withColumn("title", F.when(F.col("at").isNotNull(), F.aggregate(F.slice("l", F.col("at") + 2, F.lit(4)), start, goes_on)))
    nobody = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("stop"))

    def author(state: Column, x: Column) -> Column:
        low = F.lower(x["t"])
        ends = state["stop"] | ((x["t"] != "") & ((x["r"] > 0.82) | F.rlike(low, F.lit(r"^(abstract|keywords)\b"))))
        take = ~ends & (x["t"] != "") & ~_identified(x["t"]) & ~_of_publisher(x["t"]) & (F.length(x["t"]) <= 360) & (F.size(state["parts"]) < 3)
        return F.struct(F.when(take, F.concat(state["parts"], F.array(x["t"]))).otherwise(state["parts"]).alias("parts"), ends.alias("stop"))

    authors = F.when(F.col("at").isNotNull(), F.aggregate(F.slice("l", F.col("title.end") + 2, F.lit(7)), nobody, author)["parts"])
    joined = lambda parts: F.coalesce(collapse(F.array_join(parts, " ")), F.lit(""))
    return pages.select(*document, joined(F.col("title.parts")).alias("title"), joined(authors).alias("authors"), strip(F.regexp_extract(text, DOI, 0)).alias("doi"), strip(F.regexp_extract(text, ISBN, 1)).alias("isbn"), strip(F.regexp_extract(text, ISSN, 1)).alias("issn"))
