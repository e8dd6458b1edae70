"""Table and diagram blocks from the intermediate blocks of documents.

blocks have the columns of operators.blocks.BLOCKS: path, page_index, order_index, block_type,
text, caption, footnotes, table_html, table_rows, image_path, bbox and the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.scopes import strip
from corvane.operators.blocks import anchor_key, table_parts

_STRINGS = "array<string>"


def _said(c: str | Column) -> Column:
    """Text without white space round it; null for none. Long texts are searched for it only where an end is white."""
    c = F.col(c) if isinstance(c, str) else c
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.nullif(F.when(F.rlike(ends, F.lit(r"(?U)\s")), strip(c)).otherwise(c), F.lit(""))


def reference_title(text: Column, prefix: str) -> Column:
    """'Table 3': the first mention of the kind with a number; null for none."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?i)\b({prefix}\s+\d+)\b", 1), F.lit(""))


def table_blocks(blocks: DataFrame) -> DataFrame:
    """One row a table: anchor, title, caption, header, body, row_objects, cells, footnotes, linearized and quality.

    The rows come from the table's markup; without any, from lines with bars in its text, whose
    other lines are caption and footnotes. The first row is the header. quality is native, or
    malformed where no rows were found. Tables without text and rows are left out.
    """
    tables = blocks.where(F.col("block_type") == "table").withColumn("raw", _said("text"))
    marked = F.size(F.coalesce("table_rows", F.array().cast("array<array<string>>"))) > 0
    tables = tables.withColumns({"_marked": marked, "_parts": table_parts(F.col("raw"))})
    none = F.array().cast(_STRINGS)
    tables = tables.withColumns({
        "matrix": F.when(F.col("_marked"), F.col("table_rows")).otherwise(T.pipe_matrix(F.col("raw"))),
        "caption": F.coalesce(_said("caption"), F.when(~F.col("_marked"), _said(F.col("_parts.caption")))),
        "notes": F.filter(F.transform(F.when(F.size(F.coalesce("footnotes", none)) > 0, F.col("footnotes")).when(F.col("_marked"), none).otherwise(F.col("_parts.footnotes")), _said), lambda s: s.isNotNull()),
    })
    tables = tables.where((F.size("matrix") > 0) | F.col("raw").isNotNull())
    header, body = F.coalesce(F.get("matrix", F.lit(0)), none), F.slice("matrix", 2, F.greatest(F.lit(0), F.size("matrix") - 1))
    tables = tables.withColumns({"header": header, "body": body, "title": reference_title(F.coalesce("caption", "raw"), "table")})
    cells = F.flatten(F.transform("matrix", lambda r, i: F.transform(r, lambda v, j: F.struct(i.alias("row_index"), j.alias("col_index"), v.alias("text"), (i == 0).alias("is_header")))))
    return tables.select(
        "path", "page_index", "order_index", anchor_key(F.col("path"), F.col("page_index"), F.col("order_index")).alias("anchor"),
        "title", "caption", "header", "body",
        F.when(F.size("body") > 0, T.row_objects(F.col("header"), F.col("body"))).otherwise(F.array().cast("array<map<string,string>>")).alias("row_objects"),
        cells.alias("cells"), F.col("notes").alias("footnotes"),
        T.table_text(F.col("title"), F.col("caption"), F.col("header"), F.col("body"), F.col("notes"), F.lit("")).alias("linearized"),
        F.when(F.col("_marked") | (F.size("matrix") > 0), "native").otherwise("malformed").alias("quality"),
        F.coalesce("caption", "raw").alias("display_text"), "bbox",
    )


def diagram_blocks(blocks: DataFrame) -> DataFrame:
    """One row an image with a path or a caption: anchor, kind, title, caption, near and retrieval_text.

    near is the nearest text before the image on its page, else the one after it; headers, footers
    and page numbers are no context.
    """
    texts = F.when(F.col("block_type").isin("paragraph", "heading"), _said("text"))
    w = Window.partitionBy("path", "page_index").orderBy("order_index")
    before = F.last(texts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(texts, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = blocks.withColumn("near", F.coalesce(before, after)).where((F.col("block_type") == "image") & (_said("image_path").isNotNull() | _said("caption").isNotNull()))
    caption = _said("caption")
    return rows.select(
        "path", "page_index", "order_index", anchor_key(F.col("path"), F.col("page_index"), F.col("order_index")).alias("anchor"),
        _said("image_path").alias("image_path"), T.diagram_kind(F.col("caption")).alias("kind"), reference_title(F.col("caption"), "fig(?:ure|\\.)").alias("title"),
        caption.alias("caption"), "near", T.diagram_retrieval_text(caption, F.lit(None).cast("string"), F.col("near")).alias("retrieval_text"), "bbox",
    )
