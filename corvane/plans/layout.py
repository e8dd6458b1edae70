"""Layout queries: lines of an order stand for the blocks of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import layout, pages, structure
from corvane.plans.registry import query, table


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 1000).alias("y"))


_B = "b AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey AS p, l_quantity AS x, l_discount * 1000 AS y FROM lineitem)"


@query("page_regions", f"""
WITH {_B}, f AS (SELECT *, CASE WHEN x - max(x + 3) OVER (PARTITION BY page ORDER BY x, n, p, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 4 THEN 1 ELSE 0 END AS fresh FROM b)
SELECT page, n, p, (sum(fresh) OVER (PARTITION BY page ORDER BY x, n, p, y ROWS UNBOUNDED PRECEDING))::BIGINT AS region FROM f""")
def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).withColumn("bottom", F.col("x") + 3)
    return layout.regions(rows, ["page"], "x", "bottom", 4.0, "n", "p", "y").select("page", "n", "p", "region")


@query("page_columns", f"""
WITH {_B}, f AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x, n, p, y) > 6 THEN 1 ELSE 0 END AS fresh FROM b)
SELECT page, n, p, least(sum(fresh) OVER (PARTITION BY page ORDER BY x, n, p, y ROWS UNBOUNDED PRECEDING), 2)::BIGINT AS "column",
  CASE WHEN abs(x - 10) <= abs(x - 30) AND abs(x - 10) <= abs(x - 45) THEN 0 WHEN abs(x - 30) <= abs(x - 45) THEN 1 ELSE 2 END AS nearest FROM f""")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = layout.nearest_center(F.col("x"), F.array(F.lit(10.0), F.lit(30.0), F.lit(45.0)))
    return layout.columns(_blocks(spark, sf_dir), ["page"], "x", 6.0, 3, "n", "p", "y").select("page", "n", "p", "column", near.alias("nearest"))


@query("outside_tables", f"""
WITH {_B}, t AS (SELECT page, x - 2 AS x0, y - 20 AS y0, x + 12 AS x1, y + 40 AS y1 FROM b WHERE n = 1)
SELECT page, n, p FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND b.x BETWEEN x0 AND x1 AND b.y BETWEEN y0 AND y1)""")
def outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir)
    boxes = rows.where("n = 1").select("page", (F.col("x") - 2).alias("x0"), (F.col("y") - 20).alias("y0"), (F.col("x") + 12).alias("x1"), (F.col("y") + 40).alias("y1"))
    return layout.outside_boxes(rows, boxes, "page").select("page", "n", "p")


_LINES = """
l AS (SELECT doc_id, i AS pos, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_matches(lines[i], '[A-Za-z]')),
g AS (SELECT doc_id, pos, line, (10 + (pos * 7 % 5) * 5 + CASE WHEN pos % 11 = 0 THEN 100 ELSE 0 END)::DOUBLE AS x0, (pos * 12 + (pos // 4) * 15)::DOUBLE AS y0, CASE WHEN pos % 9 = 1 THEN 14.0 ELSE 10.0 END::DOUBLE AS s, pos % 9 = 1 AS b FROM l)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with letters, laid out by their numbers: gaps, indents, columns and large bold ones."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("_p", "text")).where(F.rlike("text", F.lit("[A-Za-z]")))
    n = F.col("_p") + 1
    x, y = (10 + n * 7 % 5 * 5 + F.when(n % 11 == 0, 100).otherwise(0)).cast("double"), (n * 12 + F.floor(n / 4) * 15).cast("double")
    large = n % 9 == 1
    return rows.select("doc_id", n.alias("order_index"), "text", x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 10).alias("y1"), F.when(large, 14.0).otherwise(10.0).alias("font_size"), large.alias("bold"), F.lit(False).alias("italic"), F.lit(800.0).alias("page_height"))


@query("page_paragraphs", f"""
WITH {_LINES}, m AS (SELECT *, median(s) OVER (PARTITION BY doc_id) AS body, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t, regexp_matches(line, '^\\s*([-*•]|\\d+[.)]|[A-Za-z][.)])\\s+') AS item FROM g),
h AS (SELECT *, len(t) <= 120 AND (regexp_matches(t, '^(\\d+\\.\\d+\\b|\\d+\\.\\s*[A-Z]|\\d+\\s+[A-Z]|(?i:chapter|section))') OR (upper(t) = t AND lower(t) <> t AND len(string_split(t, ' ')) <= 12) OR (b AND s >= body * 1.04 AND NOT regexp_matches(t, '[.!?]$'))) AS head FROM m),
p AS (SELECT *, lag(x0) OVER w AS px, lag(y0) OVER w + 10 AS py, lag(s) OVER w AS ps, lag(item) OVER w AS pitem, lag(t) OVER w AS pt FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, px IS NULL OR y0 - py > greatest(ps, s, 8) OR abs(x0 - px) > 80 OR (item AND NOT pitem) OR head OR (regexp_matches(pt, '[.!?]$') AND regexp_matches(t, '^[A-Z]') AND abs(x0 - px) > 12) AS fresh FROM p),
n AS (SELECT *, (sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::INTEGER AS k FROM f)
SELECT doc_id, k AS paragraph_index, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(y0) + 10 AS y1 FROM n GROUP BY 1, 2""")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.paragraphs(_lines(spark, sf_dir), "doc_id")
    return found.select("doc_id", "paragraph_index", "n_lines", F.get("bbox", F.lit(0)).alias("x0"), F.get("bbox", F.lit(1)).alias("y0"), F.get("bbox", F.lit(3)).alias("y1"))


@query("first_page_titles")
def first_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, authors and identifiers of each document, its lines laid out as a first page."""
    return pages.first_pages(_lines(spark, sf_dir), "doc_id")


#: Pages of five lines of a document, each with a header and a footer.
_PAGED = """
b AS (SELECT doc_id, source, i AS pos, (i - 1) // 5 AS page, lines[i] AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE source IS NOT NULL)),
n AS (SELECT doc_id, any_value(source) AS source, count(DISTINCT page) AS pages FROM b GROUP BY 1)"""


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("_p", "line"))
    body = rows.select("doc_id", "source", F.floor(F.col("_p") / 5).alias("page"), (F.col("_p") + 1).alias("pos"), "line", F.lit(0.5).alias("y"))
    number = (F.col("page") + 1).cast("string")
    edge = body.select("doc_id", "source", "page").distinct()
    head = edge.select("doc_id", "source", "page", F.lit(0).alias("pos"), F.concat(F.lit("Report of "), "source", F.lit(" "), number).alias("line"), F.lit(0.05).alias("y"))
    foot = edge.select("doc_id", "source", "page", F.lit(10_000_000).alias("pos"), F.concat(F.lit("Page "), number).alias("line"), F.lit(0.95).alias("y"))
    return body.union(head).union(foot)


@query("running_lines", f"""
WITH {_PAGED} SELECT doc_id, 'report of ' || lower(source) AS canonical, pages AS n_pages, 'header' AS place FROM n WHERE pages >= 3 UNION ALL SELECT doc_id, 'page', pages, 'footer' FROM n WHERE pages >= 3""")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and footers of documents of three pages and more."""
    return structure.running_text(_paged(spark, sf_dir), "doc_id", "page", "line", "y")


@query("pages_without_running_lines", f"""
WITH {_PAGED}, t AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY pos) AS body FROM b GROUP BY 1, 2)
SELECT doc_id, page, CASE WHEN pages < 3 OR page = 0 THEN 'Report of ' || source || ' ' || page + 1 || chr(10) ELSE '' END || body || CASE WHEN pages < 3 THEN chr(10) || 'Page ' || page + 1 ELSE '' END AS text FROM t JOIN n USING (doc_id)""")
def pages_without_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages; the header is the document's title too, so the first page keeps it."""
    rows = _paged(spark, sf_dir)
    found = structure.running_text(rows, "doc_id", "page", "line", "y")
    titles = rows.where("pos = 0 AND page = 0").select("doc_id", "line")
    return structure.remove_running_text(rows, found, "doc_id", "page", "line", "pos", "y", titles)
