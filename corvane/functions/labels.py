"""Small value expressions: dates, merges, ratios, page modes, titles of conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.scopes import collapse, strip

# Words that no conversation is named by, and the name of one without documents.
TITLE_STOPWORDS = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "how", "in", "into", "is", "of", "on", "or", "paper", "study", "the", "to", "using", "with")
NEW_TITLE = "New conversation"


def summary_text(x: Column) -> Column:
    """One kind of line break, one blank for each run of blanks and tabs, no white space round lines."""
    lines = F.split(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n?", "\n"), r"[ \t]+", " "), "\n")
    return strip(F.array_join(F.transform(lines, strip), "\n"))


def ordered_ids(ids: Column) -> Column:
    """Ids without white space round them, blank ones out, each once where it comes first."""
    return F.array_distinct(F.filter(F.transform(ids, lambda i: strip(F.coalesce(i.cast("string"), F.lit("")))), lambda i: i != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(1.0)


def tokens(x: Column) -> Column:
    """Distinct lower-cased runs of letters and digits, and of the marks that stand for numbers (<n>)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9<>]+"), F.lit(0)))


def date_label(t: Column) -> Column:
    """Jan 05, 2024."""
    return F.date_format(t, "MMM dd, yyyy")


def epoch_millis(t: Column) -> Column:
    return F.unix_millis(t.cast("timestamp"))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait, from a number or an HTTP date; never negative, null if neither."""
    raw = strip(F.coalesce(value, F.lit("")))
    # The day's name says nothing more and is left out.
    date = F.try_to_timestamp(F.regexp_extract(raw, r"^[A-Za-z]{3},\s*(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("d MMM yyyy HH:mm:ss"))
    # Only digits are a number: NaN and Infinity, which a cast takes, say nothing.
    plain = F.when(F.rlike(raw, F.lit(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,2})?$")), raw.try_cast("double"))
    seconds = F.coalesce(plain, (F.unix_micros(date) - F.unix_micros(now.cast("timestamp"))) / 1e6)
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def merge_json(old: Column, new: Column) -> Column:
    """map<string, string> of old with the entries of new over it; a null map counts as empty."""
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(old, none), lambda k, v: ~F.map_contains_key(F.coalesce(new, none), k))
    return F.map_concat(kept, F.coalesce(new, none))


def page_mode(has_text: Column, image_ratio: Column) -> Column:
    """digital, scanned or hybrid, by a page's text layer and the share of it that images cover."""
    text, image = F.coalesce(has_text, F.lit(False)), F.coalesce(image_ratio, F.lit(0.0))
    return F.when(text & (image < 0.45), "digital").when(~text & (image > 0.2), "scanned").otherwise("hybrid")


def parser_status(found: Column, errors: Column) -> Column:
    """failed if a parser found no segment and no asset, partial if it also met errors, else success."""
    return F.when(F.coalesce(found, F.lit(0)) == 0, "failed").when(F.coalesce(errors, F.lit(0)) > 0, "partial").otherwise("success")


def stored_status(status: Column) -> Column:
    """What a table of documents shows: a partial result is a success."""
    return F.when(status == "partial", "success").otherwise(status)


def _title(x: Column) -> Column:
    return F.left(collapse(F.translate(x, "_-", "  ")), F.lit(120))


def conversation_title(titles: Column) -> Column:
    """Title of a conversation about documents with these titles (in order).

    One: itself. Two: both. More: up to three words that at least two titles share (most titles,
    then the longest, then by code point) as they are first written, else the first and a count.
    """
    own = F.array_distinct(F.filter(titles, lambda t: F.coalesce(t != "", F.lit(False))))
    words = F.flatten(F.transform(own, lambda t: F.regexp_extract_all(t, F.lit(r"[A-Za-z][A-Za-z0-9+.-]{2,}"), F.lit(0))))
    each = F.flatten(F.transform(own, lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[a-z][a-z0-9+.-]{2,}"), F.lit(0)))))
    useful = F.filter(each, lambda w: ~w.isin(*TITLE_STOPWORDS))
    counted = F.transform(F.array_distinct(useful), lambda w: F.struct((-F.size(F.filter(useful, lambda u: u == w))).alias("n"), (-F.length(w)).alias("l"), w.alias("w")))
    shared = F.slice(F.array_sort(F.filter(counted, lambda s: s["n"] <= -2)), 1, 3)
    topic = F.array_join(F.transform(shared, lambda s: F.get(F.filter(words, lambda w: F.lower(w) == s["w"]), F.lit(0))), " / ")
    n = F.size(own)
    first = F.get(own, F.lit(0))
    many = F.when(F.size(shared) > 0, topic).otherwise(F.concat(first, F.lit(" + "), (n - 1).cast("string"), F.lit(" more")))
    return F.when(F.coalesce(n, F.lit(0)) < 1, NEW_TITLE).when(n == 1, first).when(n == 2, _title(F.concat_ws(" + ", own))).otherwise(_title(many))
