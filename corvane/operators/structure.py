"""Order inside documents: segments, section paths, neighbours, parents, references, running text.

All of it partitions by document once; consecutive windows over the same partitioning share one
shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import canonical_running_line

#: Heading levels that a path can hold.
LEVELS = 6


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a line: key, reading_order (from 1), text."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("_p", "text")).select(key, (F.col("_p") + 1).alias("reading_order"), "text")


def section_paths(segments: DataFrame, doc: str, order: str, level: str, label: str, out: str = "section_path") -> DataFrame:
    """Add the titles of the open headings at each segment, outermost first.

    level is null for what is no heading. A heading closes those of its level and deeper. So level
    l is open if its last heading comes after the last heading of every level above it: one window
    a level, all over one sort.
    """
    upto = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.when(F.col(level).isNotNull(), F.least(F.greatest(F.col(level), F.lit(1)), F.lit(LEVELS)))
    last = {i: F.last(F.when(n == i, F.struct(F.col(order).alias("at"), F.col(label).alias("label"))), ignorenulls=True).over(upto) for i in range(1, LEVELS + 1)}
    out_df = segments.withColumns({f"_h{i}": c for i, c in last.items()})
    above: Column = F.lit(None).cast("long")
    parts = []
    for i in range(1, LEVELS + 1):
        at = F.col(f"_h{i}.at").cast("long")
        parts.append(F.when(at.isNotNull() & (above.isNull() | (at > above)), F.col(f"_h{i}.label")))
        above = F.greatest(above, at)
    return out_df.withColumn(out, F.array_compact(F.array(*parts))).drop(*[f"_h{i}" for i in range(1, LEVELS + 1)])


def neighbours(blocks: DataFrame, doc: str, order: str, key: str) -> DataFrame:
    """Add previous_id and next_id in the document."""
    w = Window.partitionBy(doc).orderBy(order)
    return blocks.withColumns({"previous_id": F.lag(key).over(w), "next_id": F.lead(key).over(w)})


def heading_parent(blocks: DataFrame, unit: list[str], order: str, key: str, is_heading: Column) -> DataFrame:
    """Add parent_id: the last heading before a block in its unit; headings have none."""
    before = Window.partitionBy(*unit).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("parent_id", F.when(~is_heading, F.last(F.when(is_heading, F.col(key)), ignorenulls=True).over(before)))


def children(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """(parent_id, child_ids) in reading order, from blocks with parent_id."""
    kids = blocks.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct(order, key))).alias("_c"))
    return kids.select("parent_id", F.transform("_c", lambda c: c[key]).alias("child_ids"))


def siblings(blocks: DataFrame, unit: list[str], key: str) -> DataFrame:
    """Add sibling_ids: the other blocks of the unit, sorted. Units are pages, of bounded size."""
    own = Window.partitionBy(*unit)
    return blocks.withColumn("sibling_ids", F.array_sort(F.array_except(F.collect_list(key).over(own), F.array(F.col(key)))))


def nearby_text(blocks: DataFrame, doc: str, unit: str, order: str, text: str, limit: int = 2000) -> DataFrame:
    """Add the texts of the previous and next row (of the rows given), on two lines, cut to `limit`."""
    w = Window.partitionBy(doc).orderBy(F.asc_nulls_last(unit), F.asc_nulls_last(order))
    return blocks.withColumn("nearby_text", F.left(F.concat_ws("\n", F.lag(text).over(w), F.lead(text).over(w)), F.lit(limit)))


def nearest_text(blocks: DataFrame, unit: list[str], order: str, key: str, is_text: Column) -> DataFrame:
    """Add nearby_ids: the nearest text block before and after a block on its unit."""
    w = Window.partitionBy(*unit).orderBy(order)
    mark = F.when(is_text, F.col(key))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(mark, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return blocks.withColumn("nearby_ids", F.array_compact(F.array(before, after)))


def resolve_references(refs: DataFrame, targets: DataFrame, key: str = "reference_key") -> DataFrame:
    """Add target_id (first in id order) and resolution_status to references by their normalised key."""
    first = targets.groupBy("doc_id", key).agg(F.min("target_id").alias("target_id"))
    return refs.join(first, ["doc_id", key], "left").withColumn("resolution_status", F.when(F.col("target_id").isNotNull(), "resolved").otherwise("unresolved"))


def repeated_lines(page_lines: DataFrame, doc: str, page: str, line: str, share: float = 0.35, least: int = 2) -> DataFrame:
    """Lines on at least share of a document's pages, least at fewest."""
    pages = page_lines.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    counts = page_lines.select(doc, page, line).distinct().groupBy(doc, line).agg(F.count("*").alias("n_pages"))
    bound = F.greatest(F.lit(least), F.floor(F.col("pages") * share).cast("int"))
    return counts.join(pages, doc).where(F.col("n_pages") >= bound).select(doc, line, "n_pages")


def running_text(page_lines: DataFrame, doc: str, page: str, line: str, y: str) -> DataFrame:
    """Running headers and footers of documents of 3 pages and more.

    A canonical line counts if it stands on a quarter of the pages (2 at least), near one height
    (deviation up to 0.06) and in the outer 15 % of the page.
    """
    pages = page_lines.groupBy(doc).agg(F.count_distinct(page).alias("pages")).where("pages >= 3")
    # As a generator the form of a line is computed once; as a filter's condition it would be twice.
    own = F.filter(F.array(canonical_running_line(F.col(line))), lambda c: c != "")
    marked = page_lines.select("*", F.explode(own).alias("canonical"))
    found = marked.groupBy(doc, "canonical").agg(F.count_distinct(page).alias("n_pages"), F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("spread"), F.avg(y).alias("mean_y"))
    kept = found.join(pages, doc).where((F.col("n_pages") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.25))) & (F.col("spread") <= 0.06) & ((F.col("mean_y") < 0.15) | (F.col("mean_y") > 0.85)))
    return kept.select(doc, "canonical", "n_pages", F.when(F.col("mean_y") < 0.15, "header").otherwise("footer").alias("place"))


def remove_running_text(page_lines: DataFrame, found: DataFrame, doc: str, page: str, line: str, order: str, y: str | None = None, protected: DataFrame | None = None) -> DataFrame:
    """Page texts without running lines (found, from running_text); pages that lose all lines give none.

    y: where lines stand (0 to 1): those in the middle of a page stay. protected (doc, line): titles
    and the like; lines of the same canonical form stay on a document's first page, and where they
    come first. Lines keep their order; null and blank lines are no running lines.
    """
    marked = page_lines.withColumn("canonical", canonical_running_line(F.col(line)))
    rows = marked.join(found.select(doc, "canonical").distinct().withColumn("_hit", F.lit(True)), [doc, "canonical"], "left")
    gone = F.coalesce("_hit", F.lit(False))
    if y is not None:
        gone = gone & ~F.coalesce(F.col(y).between(0.15, 0.85), F.lit(False))
    if protected is not None:
        kept = protected.select(doc, canonical_running_line(F.col(line)).alias("canonical")).where("canonical <> ''").distinct().withColumn("_safe", F.lit(True))
        nth = F.row_number().over(Window.partitionBy(doc, "canonical").orderBy(page, order))
        first = F.min(page).over(Window.partitionBy(doc))
        rows = rows.join(kept, [doc, "canonical"], "left").withColumns({"_nth": nth, "_first": first})
        gone = gone & ~(F.coalesce("_safe", F.lit(False)) & ((F.col("_nth") == 1) | (F.col(page) == F.col("_first"))))
    lines = rows.where(~gone).groupBy(doc, page).agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("_l"))
    return lines.select(doc, page, F.array_join(F.transform("_l", lambda x: x[line]), "\n").alias("text"))


def first_by_key(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
