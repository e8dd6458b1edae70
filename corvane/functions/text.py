"""Text cleaning, classification and rendering as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.scopes import collapse, strip

# What starts a list line, an ordered item, an unordered item, a numbered heading, a caption.
LIST_LINE = r"(?i)^\s*(?:[-*•‣◦⁃∙]|(?:[0-9]+|[a-z]|[ivxlcdm]+)[.)])\s+"
ORDERED = r"^\s*(?:[0-9]+[.)]|[a-zA-Z][.)])\s+"
UNORDERED = r"^\s*[-*•]\s+"
NUMBERED = r"^\s*([0-9]+(?:\.[0-9]+)*)\b"
CAPTION = r"(?i)^\s*(figure|fig\.|table)\s+[0-9]+"


def newline(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n")


def is_list_line(x: Column) -> Column:
    return F.rlike(strip(x), F.lit(LIST_LINE))


def list_type(x: Column) -> Column:
    """ordered, unordered or none."""
    return F.when(F.rlike(x, F.lit(ORDERED)), "ordered").when(F.rlike(x, F.lit(UNORDERED)), "unordered").otherwise("none")


def normalize_line(x: Column) -> Column:
    """Line ends unified, words split over lines joined, blanks collapsed; no paragraph decisions."""
    return strip(F.regexp_replace(F.regexp_replace(newline(x), "-\n(?=[a-z])", ""), "[ \t]+", " "))


#: What clean changes: line ends, tabs, runs of blanks, white space at the ends.
_UNCLEAN = r"(?U)[\r\n\t]|  |^\s|\s$"


def clean(x: Column) -> Column:
    """Extracted text made readable.

    Line ends are unified, words split over lines joined, runs of blank lines cut to one, blanks
    collapsed. The lines of a paragraph become one, unless all are list items.
    """
    t = F.regexp_replace(newline(x), "-\n(?=[a-z])", "")
    t = F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "[ \t]+", " ")

    def paragraph(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, "\n"), strip), lambda s: s != "")
        return F.when(F.forall(lines, is_list_line), F.array_join(lines, "\n")).otherwise(F.array_join(lines, " "))

    full = strip(F.array_join(F.filter(F.transform(F.split(t, "\n\\s*\n"), paragraph), lambda p: p != ""), "\n\n"))
    # A line that is clean already goes through none of that.
    own = F.coalesce(x, F.lit(""))
    return F.when(F.rlike(own, F.lit(_UNCLEAN)), full).otherwise(own)


def paragraphs(x: Column) -> Column:
    """Cleaned paragraphs between blank lines; the cleaned lines where there is none."""
    text = newline(x)
    by_blank = F.filter(F.transform(F.split(text, "\n\\s*\n+"), clean), lambda p: p != "")
    by_line = F.filter(F.transform(F.split(text, "\n"), lambda s: collapse(s)), lambda p: p != "")
    return F.when(F.size(by_blank) > 0, by_blank).otherwise(by_line)


def rstrip_lines(x: Column) -> Column:
    """Line ends unified and white space removed before each."""
    return F.array_join(F.transform(F.split(newline(x), "\n"), lambda s: F.regexp_replace(s, r"(?U)\s+$", "")), "\n")


def heading_level(text: Column, explicit: Column | None = None, style: Column | None = None) -> Column:
    """An explicit level, that of a style such as 'Heading 3', or the parts of a leading number."""
    number = F.regexp_extract(F.coalesce(text, F.lit("")), NUMBERED, 1)
    out = F.when(number != "", F.size(F.split(number, r"\.")))
    if style is not None:
        s = F.lower(strip(F.coalesce(style, F.lit(""))))
        level = F.coalesce(F.trim(F.replace(s, F.lit("heading"), F.lit(""))).try_cast("int"), F.lit(1))
        out = F.when(F.startswith(s, F.lit("heading")), F.when(level == 0, 1).otherwise(level)).otherwise(out)
    return out if explicit is None else F.coalesce(F.when(explicit != 0, explicit), out)


def text_role(role: Column, text: Column, style: Column | None = None) -> Column:
    """heading, caption, list, note or paragraph."""
    r, t = F.lower(strip(F.coalesce(role, F.lit("")))), F.coalesce(text, F.lit(""))
    styled = F.startswith(F.lower(strip(F.coalesce(style, F.lit("")))), F.lit("heading")) if style is not None else F.lit(False)
    return (
        F.when((r == "heading") | styled, "heading")
        .when(r == "figure_caption", "caption")
        .when((r == "list_item") | (list_type(t) != "none"), "list")
        .when(r == "reference_entry", "note")
        .when(F.rlike(t, F.lit(CAPTION)), "caption")
        .otherwise("paragraph")
    )


def diagram_kind(text: Column) -> Column:
    """chart, image, figure or unknown, by the words of caption and subtype."""
    t = F.lower(collapse(F.coalesce(text, F.lit(""))))
    return (
        F.when(F.rlike(t, F.lit(r"\b(chart|graph|plot|axis|legend)\b")), "chart")
        .when(F.contains(t, F.lit("image")), "image")
        .when(t != "", "figure")
        .otherwise("unknown")
    )


def table_like(source_type: Column, role: Column, block_type: Column) -> Column:
    low = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    return (low(source_type) == "table") | (low(role) == "table") | (low(block_type) == "table_row")


def ends_open(x: Column) -> Column:
    """Whether a text stops in mid-sentence."""
    t = strip(F.coalesce(x, F.lit("")))
    return (t != "") & (F.endswith(t, F.lit("-")) | ~F.rlike(t, F.lit(r"[.!?;:)\]\"']\s*$")))


# Words that a sentence goes on with.
CONNECTIVES = "and|or|but|for|nor|so|yet|to|of|in|on|with|by|from|as|that|which|who|whose|where|when"


#: Where a word ends if only ASCII letters, digits and _ are of words.
ASCII_WORD_END = "(?![A-Za-z0-9_])"


def starts_like_continuation(x: Column, word_end: str = r"\b") -> Column:
    t = strip(F.coalesce(x, F.lit("")))
    return F.rlike(t, F.lit(r"^[a-z(\[\"'0-9]")) | F.rlike(t, F.lit(rf"(?i)^({CONNECTIVES}){word_end}"))


# What marks a line as running (of a journal, a volume), and months as they begin.
RUNNING = r"\b(?:issn|isbn|volume|vol\.|number|no\.|journal|conference|proceedings|procedia)\b"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec"
# What changes from page to page in a running line, and what stands for it, in this order.
CHANGING = (
    (r"\bissn\s*[:#]?\s*[\d\-x]+\b", "issn <id>"),
    (r"\bisbn\s*[:#]?\s*[\d\-x]+\b", "isbn <id>"),
    (r"\bpage\s+\d+\b", "page <n>"),
    (r"\bpp?\.?\s*\d+(?:\s*-\s*\d+)?\b", "pp <range>"),
    (r"\bvolume\s+\d+\b", "volume <n>"),
    (r"\bvol\.?\s*\d+\b", "vol <n>"),
    (r"\bnumber\s+\d+\b", "number <n>"),
    (r"\bno\.?\s*\d+\b", "no <n>"),
    (r"\(\d+\)", "(<n>)"),
    (r"\b(?:19|20)\d{2}\b", "<year>"),
    (rf"\b(?:{MONTHS})\w*\s+\d{{4}}\b", "<month-year>"),
    (r"\b\d{1,5}\s*-\s*\d{1,5}\b", "<range>"),
    (r"^\s*\d{1,5}\s+", "<n> "),
    (r"\s+\d{1,5}\s*$", " <n>"),
)


def canonical_running_line(x: Column) -> Column:
    """A running header or footer with marks for what changes from page to page; other lines keep their numbers."""

    def plain(base: Column, running: Column) -> Column:
        marked = dashed = F.translate(base, "–—", "--")
        for pattern, mark in CHANGING:
            marked = F.regexp_replace(marked, pattern, mark)
        return F.regexp_replace(F.when(running, marked).otherwise(dashed), r"[.,;:|/\\\[\]{}]+", " ")

    def without_ends(plain: Column) -> Column:
        ends = F.regexp_replace(F.regexp_replace(plain, r"^<n>\s+", ""), r"\s+<n>$", "")
        return collapse(F.when(strip(plain).isin("<n>", "(<n>)"), plain).otherwise(ends))

    def line(base: Column) -> Column:
        seen = F.rlike(base, F.lit(RUNNING)) | F.rlike(base, F.lit(r"^\d{1,5}\b|\b\d{1,5}$")) | F.contains(base, F.lit("/")) | F.contains(base, F.lit("et al"))

        def form(running: Column, out: Column) -> Column:
            number = running & F.rlike(base, F.lit(r"\d"))
            return F.when(F.rlike(base, F.lit(r"^\d{1,5}$")), "<n>").when((out == "") & number, "<n>").otherwise(out)

        marked = bound(seen, lambda running: bound(plain(base, running), lambda p: bound(without_ends(p), lambda out: form(running, out))))
        return F.when(base == "", "").otherwise(marked)

    # Each step is computed once a line, not once for each place that reads it.
    return bound(F.lower(strip(F.coalesce(x, F.lit("")))), line)


def doi(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(10\.\d{4,9}/[^\s\"<>]+)", 1), F.lit(""))


def reference_keys(x: Column) -> Column:
    """table:3, figure:2, section:1.4 for each mention, in that order of kinds."""
    def named(word: str, label: str, number: str = r"\d+") -> Column:
        return F.transform(F.regexp_extract_all(x, F.lit(rf"(?i)\b(?:{word})\s+({number})\b"), F.lit(1)), lambda n: F.concat(F.lit(label + ":"), n))

    return F.concat(named("table", "table"), named("figure|fig", "figure"), named("section", "section", r"\d+(?:\.\d+)*"))


def token_estimate_words(x: Column) -> Column:
    """Words times 1.3, rounded half to even, at least 1."""
    words = F.size(F.filter(F.split(collapse(x), " "), lambda w: w != ""))
    return F.greatest(F.lit(1), F.bround(words * F.lit(1.3), 0).cast("int"))


def token_estimate_chars(x: Column) -> Column:
    """A token for every four characters begun, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.length(x) + 3) / 4).cast("int"))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def retrieval_text(section_path: Column, role: Column, body: Column) -> Column:
    """Heading Path: a > b. Text Role: r. body"""
    path = F.when(F.size(section_path) > 0, F.concat(F.lit("Heading Path: "), F.array_join(section_path, " > "), F.lit(".")))
    return F.concat_ws(" ", path, F.concat(F.lit("Text Role: "), role, F.lit(".")), collapse(body))


def diagram_retrieval_text(caption: Column, ocr: Column, near: Column) -> Column:
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.concat_ws(
        " ",
        F.when(said(caption), F.concat(F.lit("Caption: "), caption, F.lit("."))),
        F.when(said(ocr), F.concat(F.lit("OCR: "), ocr, F.lit("."))),
        F.when(said(near), F.concat(F.lit("Nearby Context: "), near)),
        F.lit("Diagram semantic interpretation pending vision analysis."),
    )


def table_text(title: Column, caption: Column, headers: Column, rows: Column, footnotes: Column, context: Column) -> Column:
    """One line for a table: titles, headers, rows as header=value, footnotes, context.

    A cell beyond the headers is named Column i; rows without any headers list their cells.
    """
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    some = F.coalesce(F.size(headers), F.lit(0)) > 0
    same = F.lower(collapse(F.coalesce(caption, F.lit("")))) == F.lower(collapse(F.coalesce(title, F.lit(""))))

    def line(r: Column, i: Column, of: Column) -> Column:
        pairs = F.transform(r, lambda v, j: F.concat(F.coalesce(F.get(of, j), F.concat(F.lit("Column "), (j + 1).cast("string"))), F.lit("="), v))
        body = F.when(F.coalesce(F.size(of), F.lit(0)) > 0, F.array_join(pairs, "; ")).otherwise(F.array_join(r, " | "))
        return F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), body, F.lit("."))

    return F.concat_ws(
        " ",
        F.when(said(title), F.concat(F.lit("Table: "), title, F.lit("."))),
        F.when(said(caption) & ~same, F.concat(F.lit("Table: "), caption, F.lit("."))),
        F.when(some, F.concat(F.lit("Headers: "), F.array_join(headers, " | "), F.lit("."))),
        bound(headers, lambda of: F.transform(rows, lambda r, i: line(r, i, of))),
        F.transform(F.filter(footnotes, said), lambda f: F.concat(F.lit("Footnote: "), f, F.lit("."))),
        F.when(said(context), F.concat(F.lit("Context: "), context)),
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row; inside of a lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def markdown_table(matrix: Column) -> Column:
    """Rows of cells as a markdown table: columns as wide as their longest cell, 3 at least; the first row is the header."""

    def padded(places: Column) -> Column:
        return F.transform(matrix, lambda r: F.transform(places, lambda j: F.trim(F.coalesce(F.get(r, j), F.lit("")))))

    def widths(full: Column) -> Column:
        start = F.transform(F.get(full, F.lit(0)), lambda _: F.lit(3))
        return F.aggregate(full, start, lambda w, r: F.zip_with(w, r, lambda n, v: F.greatest(n, F.length(v))))

    def written(full: Column, wide: Column) -> Column:
        lines = F.transform(full, lambda r: F.concat(F.lit("| "), F.array_join(F.zip_with(r, wide, lambda v, n: F.rpad(v, n, F.lit(" "))), " | "), F.lit(" |")))
        rule = F.concat(F.lit("|"), F.array_join(F.transform(wide, lambda w: F.repeat(F.lit("-"), w + 2)), "|"), F.lit("|"))
        return bound(lines, lambda own: F.array_join(F.concat(F.slice(own, 1, 1), F.array(rule), F.slice(own, F.lit(2), F.size(own))), "\n"))

    places = F.sequence(F.lit(0), F.array_max(F.transform(matrix, F.size)) - 1)
    text = bound(places, lambda p: bound(padded(p), lambda full: bound(widths(full), lambda wide: written(full, wide))))
    return F.when(F.size(matrix) > 0, text).otherwise("")


def row_objects(headers: Column, rows: Column) -> Column:
    """Header to cell for each row; a blank header repeats the one before it, or is column_i."""
    filled = F.aggregate(
        headers,
        F.array().cast("array<string>"),
        lambda acc, h: F.concat(acc, F.array(F.when(F.coalesce(h, F.lit("")) != "", h).otherwise(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.concat(F.lit("column_"), (F.size(acc) + 1).cast("string")))))),
    )
    named = lambda r, of: F.transform(r, lambda _, j: F.coalesce(F.get(of, j), F.concat(F.lit("column_"), (j + 1).cast("string"))))
    return bound(filled, lambda of: F.transform(rows, lambda r: F.map_from_arrays(named(r, of), r)))


def pipe_matrix(text: Column) -> Column:
    """Cells of a pipe table: divider rows and empty cells are dropped."""
    lines = F.filter(F.split(newline(text), "\n"), lambda s: F.contains(s, F.lit("|")))
    lines = F.filter(lines, lambda s: ~F.rlike(s, F.lit(r"^[\s|:\-]+$")))
    return F.filter(F.transform(lines, lambda s: F.filter(F.transform(F.split(s, r"\|"), lambda c: F.trim(c)), lambda c: c != "")), lambda r: F.size(r) > 0)


def bounded_list(items: Column, max_items: int, max_chars: int) -> Column:
    """Trimmed, cut at a blank, first of equals kept whatever its case, at most max_items."""
    def cut(x: Column) -> Column:
        head = F.left(x, F.lit(max_chars))
        short = F.trim(F.regexp_replace(head, r" [^ ]*$", ""))
        return F.when(F.length(x) <= max_chars, x).otherwise(F.coalesce(F.nullif(short, F.lit("")), F.trim(head)))

    own = F.filter(F.transform(items, lambda s: cut(strip(F.regexp_replace(newline(s), "[ \t]+", " ")))), lambda s: s != "")
    firsts = F.filter(own, lambda s, i: ~F.exists(F.slice(own, F.lit(1), i), lambda o: F.lower(o) == F.lower(s)))
    return F.slice(firsts, 1, max_items)


def at_word(x: Column, limit: int) -> Column:
    """At most `limit` characters, cut at the last white space if that keeps more than 60 %."""
    head = strip(F.left(x, F.lit(limit)))
    back = F.reverse(head)
    places = [F.when(F.locate(c, back) > 0, F.length(head) - F.locate(c, back)).otherwise(-1) for c in (" ", "\n")]
    last = F.greatest(*places)
    return F.when(F.length(x) <= limit, x).otherwise(strip(F.when(last > int(limit * 0.6), F.left(head, last)).otherwise(head)))


def title_from_filename(name: Column) -> Column:
    """File name without extension, _ and - as blanks."""
    return F.left(collapse(F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), "[_-]", " ")), F.lit(120))


def page_numbers(spec: Column, per_range: int = 50, total: int = 200) -> Column:
    """Sorted distinct pages of "1-3,7": reversed ranges turned, long ones cut, what is below 1 dropped."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(spec, F.lit("")), r"\s", ""), ","), lambda p: F.rlike(p, F.lit(r"^\d{1,8}(-\d{1,8})?$")))

    def pages(p: Column) -> Column:
        a, b = F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.split_part(p, F.lit("-"), F.lit(-1)).cast("int")
        low, high = F.least(a, b), F.greatest(a, b)
        return F.sequence(low, F.least(high, low + (per_range - 1)))

    return F.slice(F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(parts, pages)), lambda n: n > 0))), 1, total)


def private_use_share(x: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(x, "[^-]", "")).cast("double"), F.length(x))


def file_type(name: Column, mime: Column) -> Column:
    """By extension first, then by MIME type."""
    # Extensions and MIME types of the kinds that are read.
    kinds = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "txt": "text", "md": "text", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image"}
    mimes = {"application/pdf": "pdf", "text/plain": "text", "text/markdown": "text", "image/png": "image", "image/jpeg": "image", "image/webp": "image"}
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(table(kinds), ext), F.try_element_at(table(mimes), F.lower(mime)), F.lit("unknown"))
