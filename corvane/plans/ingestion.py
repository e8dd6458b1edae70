"""Document queries: segments, cleaning, roles, section paths, neighbours, references, running text, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import gate, geometry, text
from corvane.functions.scopes import collapse
from corvane.operators import folds, structure
from corvane.operators import html as H
from corvane.plans.registry import query, table

_LINES = """
lines AS (
  SELECT doc_id, i AS reading_order, string_split(text, chr(10))[i] AS text
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
)"""
_COLLAPSE = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.lines(table(spark, sf_dir, "documents"))


@query("segments_lines", f"WITH {_LINES} SELECT doc_id, reading_order::INTEGER AS reading_order, text FROM lines")
def segments_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


@query("segments_paragraphs", r"""
WITH t AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents),
p AS (SELECT doc_id, [x FOR x IN [trim(regexp_replace(q, '\s+', ' ', 'g')) FOR q IN string_split(text, chr(10))] IF x <> ''] AS ps FROM t)
SELECT doc_id, i::INTEGER AS paragraph_index, ps[i] AS text FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)""")
def segments_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line by line, as texts without blank lines are cut."""
    docs = table(spark, sf_dir, "documents")
    own = F.filter(F.transform(F.split(text.newline(F.col("text")), "\n"), collapse), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(own).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("paragraph_index"), "text")


# Paragraphs joined or kept by line as their lines say; words split over lines are joined first.
_LIST = r"^\s*(?:[-*•‣◦⁃∙]|(?:[0-9]+|[a-z]|[ivxlcdm]+)[.)])\s+"


@query("clean_text", rf"""
WITH t AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '-\n([a-z])', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g') AS t
  FROM documents
), p AS (SELECT doc_id, regexp_split_to_array(t, '\n\s*\n') AS ps FROM t)
SELECT doc_id, array_to_string([r FOR r IN [
  CASE WHEN len([l FOR l IN string_split(q, chr(10)) IF trim(l) <> '' AND NOT regexp_matches(trim(l), '{_LIST}', 'i')]) = 0
    THEN array_to_string([trim(l) FOR l IN string_split(q, chr(10)) IF trim(l) <> ''], chr(10)) ELSE array_to_string([trim(l) FOR l IN string_split(q, chr(10)) IF trim(l) <> ''], ' ') END
  FOR q IN ps] IF r <> ''], chr(10) || chr(10)) AS cleaned FROM p""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("line_classes", rf"""
WITH {_LINES}
SELECT doc_id, reading_order::INTEGER AS reading_order, regexp_matches(trim(text), '{_LIST}', 'i') AS list_line,
  CASE WHEN regexp_matches(text, '^\s*([0-9]+[.)]|[a-zA-Z][.)])\s+') THEN 'ordered' WHEN regexp_matches(text, '^\s*[-*•]\s+') THEN 'unordered' ELSE 'none' END AS list_type,
  CASE WHEN regexp_extract(text, '^\s*([0-9]+(?:\.[0-9]+)*)\b', 1) <> '' THEN len(string_split(regexp_extract(text, '^\s*([0-9]+(?:\.[0-9]+)*)\b', 1), '.'))::INTEGER END AS heading_level,
  CASE WHEN regexp_matches(text, '^\s*([0-9]+[.)]|[a-zA-Z][.)])\s+') OR regexp_matches(text, '^\s*[-*•]\s+') THEN 'list' WHEN regexp_matches(text, '^\s*(figure|fig\.|table)\s+[0-9]+', 'i') THEN 'caption' ELSE 'paragraph' END AS text_role
FROM lines""")
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _lines(spark, sf_dir).select("doc_id", "reading_order", text.is_list_line(t).alias("list_line"), text.list_type(t).alias("list_type"), text.heading_level(t).alias("heading_level"), text.text_role(F.lit(""), t).alias("text_role"))


@query("continuation_predicates", r"""
WITH """ + _LINES + r""", t AS (SELECT *, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS s FROM lines)
SELECT doc_id, reading_order::INTEGER AS reading_order, s <> '' AND (ends_with(s, '-') OR NOT regexp_matches(s, '[.!?;:)\]"'']$')) AS ends_open,
  regexp_matches(s, '^[a-z(\["''0-9]') OR regexp_matches(s, '^(and|or|but|for|nor|so|yet|to|of|in|on|with|by|from|as|that|which|who|whose|where|when)($|[^\p{L}\p{N}_])', 'i') AS goes_on FROM t""")
def continuation_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _lines(spark, sf_dir).select("doc_id", "reading_order", text.ends_open(t).alias("ends_open"), text.starts_like_continuation(t).alias("goes_on"))


@query("token_estimates", rf"""
WITH {_LINES}, w AS (SELECT doc_id, reading_order, text, len([x FOR x IN string_split({_COLLAPSE.format(x='text')}, ' ') IF x <> '']) AS n FROM lines)
SELECT doc_id, reading_order::INTEGER AS reading_order, greatest(1, round_even(n * 1.3::DOUBLE, 0)::INTEGER) AS by_words, greatest(1, ((len(text) + 3) // 4)::INTEGER) AS by_chars FROM w""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _lines(spark, sf_dir).select("doc_id", "reading_order", text.token_estimate_words(t).alias("by_words"), text.token_estimate_chars(t).alias("by_chars"))


@query("content_hashes", f"""
WITH {_LINES} SELECT doc_id, reading_order::INTEGER AS reading_order, sha256('line|' || text || '|v1') AS content_hash FROM lines""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "reading_order", text.content_hash(F.lit("line"), F.col("text"), F.lit("v1")).alias("content_hash"))


@query("block_dedupe", f"""
WITH {_LINES}, b AS (SELECT *, CASE WHEN contains(text, '|') THEN 0 WHEN len(text) > 80 THEN 1 ELSE 2 END AS prio, sha256(text) AS h FROM lines WHERE trim(text) <> '')
SELECT h AS content_hash, doc_id, reading_order::INTEGER AS reading_order, n_copies FROM (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY prio, doc_id, reading_order) AS rn, count(*) OVER (PARTITION BY h) AS n_copies FROM b) WHERE rn = 1""")
def block_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables before texts before short lines; the first of equal content stays.

    Least struct and count combine before the shuffle, so a line on every page is no hot key.
    """
    t = F.col("text")
    rows = _lines(spark, sf_dir).where(F.trim(t) != "").select(F.sha2(t, 256).alias("content_hash"), F.struct(F.when(F.contains(t, F.lit("|")), 0).when(F.length(t) > 80, 1).otherwise(2).alias("prio"), "doc_id", "reading_order").alias("s"))
    best = rows.groupBy("content_hash").agg(F.min("s").alias("s"), F.count("*").alias("n_copies"))
    return best.select("content_hash", "s.doc_id", "s.reading_order", "n_copies")


# Pages: headings and paragraphs in document order.
_ITEMS = r"""
items AS (
  SELECT page_id, i AS pos, x[i] AS raw FROM (
    SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i
    FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>|<p>.*?</p>') AS x FROM pages))
), segs AS (
  SELECT page_id, pos, TRY_CAST(nullif(regexp_extract(raw, '^<[hH]([1-6])', 1), '') AS INTEGER) AS level,
    trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM items
)"""


def _page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.page_segments(table(spark, sf_dir, "pages"))


@query("html_headings", f"WITH {_ITEMS} SELECT page_id, pos::INTEGER AS pos, level, label FROM segs WHERE level IS NOT NULL")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_segments(spark, sf_dir).where("level IS NOT NULL")


_STACK = ", ".join(f"last_value(CASE WHEN level = {i} THEN pos END IGNORE NULLS) OVER w AS p{i}, last_value(CASE WHEN level = {i} THEN label END IGNORE NULLS) OVER w AS l{i}" for i in range(1, 7))
_OPEN = ", ".join(f"CASE WHEN p{i} IS NOT NULL" + "".join(f" AND (p{j} IS NULL OR p{i} > p{j})" for j in range(1, i)) + f" THEN l{i} END" for i in range(1, 7))


@query("section_path", f"""
WITH {_ITEMS}, st AS (SELECT *, {_STACK} FROM segs WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT page_id, pos::INTEGER AS pos, [x FOR x IN [{_OPEN}] IF x IS NOT NULL] AS section_path FROM st""")
def section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.section_paths(_page_segments(spark, sf_dir), "page_id", "pos", "level", "label").select("page_id", "pos", "section_path")


@query("heading_parent", f"""
WITH {_ITEMS} SELECT page_id, pos::INTEGER AS pos, CASE WHEN level IS NULL THEN last_value(CASE WHEN level IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END::INTEGER AS parent_id FROM segs""")
def heading_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_parent(_page_segments(spark, sf_dir), ["page_id"], "pos", "pos", F.col("level").isNotNull()).select("page_id", "pos", "parent_id")


@query("heading_children", f"""
WITH {_ITEMS}, p AS (SELECT page_id, pos, CASE WHEN level IS NULL THEN last_value(CASE WHEN level IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM segs)
SELECT page_id || ':' || parent AS parent_id, list(page_id || ':' || pos ORDER BY pos) AS child_ids FROM p WHERE parent IS NOT NULL GROUP BY page_id, parent""")
def heading_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _page_segments(spark, sf_dir).withColumn("id", F.concat_ws(":", F.col("page_id").cast("string"), F.col("pos").cast("string")))
    return structure.children(structure.heading_parent(rows, ["page_id"], "pos", "id", F.col("level").isNotNull()), "id", "pos")


@query("prev_next", f"""
WITH {_ITEMS} SELECT page_id, pos::INTEGER AS pos, (lag(pos) OVER w)::INTEGER AS previous_id, (lead(pos) OVER w)::INTEGER AS next_id FROM segs WINDOW w AS (PARTITION BY page_id ORDER BY pos)""")
def prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.neighbours(_page_segments(spark, sf_dir), "page_id", "pos", "pos").select("page_id", "pos", "previous_id", "next_id")


@query("nearest_text_blocks", f"""
WITH {_ITEMS}
SELECT page_id, pos::INTEGER AS pos, [x::INTEGER FOR x IN [last_value(CASE WHEN level IS NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  first_value(CASE WHEN level IS NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)] IF x IS NOT NULL] AS nearby_ids FROM segs""")
def nearest_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.nearest_text(_page_segments(spark, sf_dir), ["page_id"], "pos", "pos", F.col("level").isNull()).select("page_id", "pos", "nearby_ids")


@query("siblings", f"""
WITH {_LINES}, u AS (SELECT doc_id, reading_order, (reading_order - 1) // 5 AS unit FROM lines)
SELECT doc_id, reading_order::INTEGER AS reading_order, [x::INTEGER FOR x IN list_sort(list(reading_order) OVER (PARTITION BY doc_id, unit)) IF x <> reading_order] AS sibling_ids FROM u""")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("unit", F.floor((F.col("reading_order") - 1) / 5))
    return structure.siblings(rows, ["doc_id", "unit"], "reading_order").select("doc_id", "reading_order", "sibling_ids")


@query("nearby_lag_lead", f"""
WITH {_LINES}, d AS (SELECT * FROM lines WHERE contains(text, '|'))
SELECT doc_id, reading_order::INTEGER AS reading_order, left(concat_ws(chr(10), lag(text) OVER w, lead(text) OVER w), 2000) AS nearby_text
FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY reading_order NULLS LAST)""")
def nearby_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among the diagram-like blocks alone, as the filter stands before the window."""
    rows = _lines(spark, sf_dir).where(F.contains("text", F.lit("|"))).withColumn("unit", F.lit(1))
    return structure.nearby_text(rows, "doc_id", "unit", "reading_order", "text").select("doc_id", "reading_order", "nearby_text")


@query("reference_resolution", r"""
WITH """ + _LINES + r""", r AS (SELECT doc_id, reading_order, unnest(regexp_extract_all(text, '([0-9]{2})', 1)) AS k FROM lines),
t AS (SELECT doc_id, lpad((reading_order + 9)::VARCHAR, 2, '0') AS k, min(reading_order) AS target FROM lines GROUP BY 1, 2)
SELECT r.doc_id, r.reading_order::INTEGER AS reading_order, r.k AS reference_key, t.target::INTEGER AS target_id, CASE WHEN t.target IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS resolution_status
FROM r LEFT JOIN t ON r.doc_id = t.doc_id AND r.k = t.k""")
def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-digit mentions against line labels: the left join that resolves references."""
    rows = _lines(spark, sf_dir)
    refs = rows.select("doc_id", "reading_order", F.explode(F.regexp_extract_all("text", F.lit("([0-9]{2})"), F.lit(1))).alias("reference_key"))
    targets = rows.select("doc_id", F.lpad((F.col("reading_order") + 9).cast("string"), 2, "0").alias("reference_key"), F.col("reading_order").alias("target_id"))
    return structure.resolve_references(refs, targets).select("doc_id", "reading_order", "reference_key", "target_id", "resolution_status")


@query("repeated_lines", f"""
WITH {_LINES}, p AS (SELECT DISTINCT d.source, l.doc_id, l.text FROM lines l JOIN documents d USING (doc_id) WHERE trim(l.text) <> ''),
n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM p GROUP BY 1)
SELECT source, text, count(*) AS n_pages FROM p JOIN n USING (source) GROUP BY source, text, pages HAVING count(*) >= greatest(2, floor(pages * 0.05::DOUBLE)::INTEGER)""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source stand for the pages of a document; 5 % of them make a line repeated."""
    rows = _lines(spark, sf_dir).where(F.trim("text") != "").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return structure.repeated_lines(rows, "source", "doc_id", "text", share=0.05)


@query("suppressed_counts", f"""
WITH {_LINES} SELECT doc_id, count(*) FILTER (reading_order = 1) AS headers, count(*) FILTER (regexp_matches(trim(text), '^[0-9]+$')) AS page_numbers, count(*) FILTER (trim(text) = '') AS blank_lines, count(*) AS n_lines FROM lines GROUP BY doc_id""")
def suppressed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.trim("text")
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("reading_order") == 1).alias("headers"), F.count_if(F.rlike(t, F.lit("^[0-9]+$"))).alias("page_numbers"), F.count_if(t == "").alias("blank_lines"), F.count("*").alias("n_lines"))


@query("nearest_rank_p95", f"""
WITH {_LINES}, v AS (SELECT doc_id, list_sort(list(len(text)::DOUBLE) FILTER (len(text) > 1.5)) AS xs FROM lines GROUP BY doc_id)
SELECT doc_id, xs[least(len(xs), floor(len(xs) * 0.95::DOUBLE)::INTEGER + 1)] AS p95 FROM v""")
def nearest_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.length("text").cast("double")).alias("xs"))
    return rows.select("doc_id", geometry.nearest_rank(F.col("xs")).alias("p95"))


@query("bbox_union", """
SELECT l_orderkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity + l_tax) AS x1, max(l_discount + l_tax) AS y1 FROM lineitem GROUP BY l_orderkey""")
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey").agg(F.min("l_quantity").alias("x0"), F.min("l_discount").alias("y0"), F.max(F.col("l_quantity") + F.col("l_tax")).alias("x1"), F.max(F.col("l_discount") + F.col("l_tax")).alias("y1"))


@query("bbox_normalise", """
SELECT l_orderkey, l_linenumber, [round(l_quantity / 612, 6), round(l_partkey / 792::DOUBLE, 6), round((l_quantity + 40) / 612, 6), round((l_partkey + 12) / 792::DOUBLE, 6)] AS bbox,
  CASE WHEN (l_quantity + 40) / 612 - l_quantity / 612 >= 0.72 THEN 'full' WHEN (l_quantity + 20) / 612 <= 0.42 THEN 'left' WHEN (l_quantity + 20) / 612 >= 0.58 THEN 'right' ELSE 'center' END AS bucket FROM lineitem""")
def bbox_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_partkey").cast("double")
    box = geometry.normalise_bbox(F.array(q, p, q + 40, p + 12), F.lit(612.0), F.lit(792.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("bbox"), geometry.column_bucket(box).alias("bucket"))


def _gate_sql() -> str:
    def count(t: str, words: tuple[str, ...]) -> str:
        return " + ".join(f"contains({t}, '{w}')::INTEGER" for w in words)

    return f"""
WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'chart' WHEN 1 THEN 'image' WHEN 2 THEN 'flow' WHEN 3 THEN 'unknown' ELSE '' END AS k,
  CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'figure ' || doc_id WHEN doc_id % 2 = 0 THEN 'system workflow chart of the photo network' ELSE 'the logo' END AS c,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'results shown in figure with trend ' || lower(trim(left(regexp_replace(text, '\\s+', ' ', 'g'), 80))) END AS n FROM documents)
SELECT doc_id, round(greatest(0.0, least(1.0, CASE WHEN k IN ('chart', 'figure') THEN 0.22 WHEN k = 'image' THEN -0.18 WHEN k NOT IN ('', 'unknown') THEN 0.12 ELSE 0.0 END::DOUBLE
  + CASE WHEN c <> '' THEN 0.10::DOUBLE + CASE WHEN len(string_split(c, ' ')) >= 5 THEN 0.08 ELSE 0.0 END ELSE 0.0 END::DOUBLE
  + least(0.28::DOUBLE, 0.07::DOUBLE * ({count("(c || chr(10) || n)", gate.POSITIVE)})) + least(0.18::DOUBLE, 0.06::DOUBLE * ({count("n", gate.REFERENCE)}))
  - least(0.40::DOUBLE, 0.12::DOUBLE * ({count("(c || chr(10) || n)", gate.NEGATIVE)}))
  - CASE WHEN regexp_matches(c, '^(figure|fig\\.?)\\s*[0-9]+[a-z]?:?$') THEN 0.10 ELSE 0.0 END::DOUBLE - CASE WHEN c = '' AND n = '' THEN 0.12 ELSE 0.0 END::DOUBLE)), 3) AS score FROM d"""


@query("gate_score", _gate_sql())
def gate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kind = F.when(d % 5 == 0, "chart").when(d % 5 == 1, "image").when(d % 5 == 2, "flow").when(d % 5 == 3, "unknown").otherwise("")
    caption = F.when(d % 7 == 0, "").when(d % 3 == 0, F.concat(F.lit("figure "), d.cast("string"))).when(d % 2 == 0, "system workflow chart of the photo network").otherwise("the logo")
    near = F.when(d % 4 == 0, "").otherwise(F.concat(F.lit("results shown in figure with trend "), F.lower(F.trim(F.left(F.regexp_replace("text", r"\s+", " "), F.lit(80))))))
    return table(spark, sf_dir, "documents").select("doc_id", gate.gate_score(kind, caption, near).alias("score"))


@query("retrieval_texts", f"""
WITH {_ITEMS}, st AS (SELECT *, {_STACK} FROM segs WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
p AS (SELECT page_id, pos, level, label, [x FOR x IN [{_OPEN}] IF x IS NOT NULL] AS path FROM st)
SELECT page_id, pos::INTEGER AS pos, concat_ws(' ', CASE WHEN len(path) > 0 THEN 'Heading Path: ' || array_to_string(path, ' > ') || '.' END, 'Text Role: ' || CASE WHEN level IS NOT NULL THEN 'heading' ELSE 'paragraph' END || '.', label) AS retrieval_text FROM p""")
def retrieval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.section_paths(_page_segments(spark, sf_dir), "page_id", "pos", "level", "label")
    role = F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph")
    return rows.select("page_id", "pos", text.retrieval_text(F.col("section_path"), role, F.col("label")).alias("retrieval_text"))


@query("table_linearise", """
WITH r AS (SELECT l_orderkey, l_linenumber, [l_returnflag, l_linestatus, l_linenumber::VARCHAR, l_suppkey::VARCHAR] AS cells FROM lineitem),
m AS (SELECT l_orderkey, list(cells ORDER BY l_linenumber, cells) AS rows_ FROM r GROUP BY 1)
SELECT l_orderkey, 'Table: Order ' || l_orderkey || '. Headers: flag | status | line. ' || array_to_string(['Row ' || i || ': flag=' || rows_[i][1] || '; status=' || rows_[i][2] || '; line=' || rows_[i][3] || '; Column 4=' || rows_[i][4] || '.' FOR i IN range(1, len(rows_) + 1)], ' ') || ' Footnote: fn.' AS table_text,
  len(rows_)::INTEGER AS n_rows FROM m""")
def table_linearise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped rows become one table block: order, headers, rows, footnote."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("cells")).alias("r"))
    tables = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["cells"]).alias("rows"))
    headers = F.array(F.lit("flag"), F.lit("status"), F.lit("line"))
    title = F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"))
    return tables.select("l_orderkey", text.table_text(title, title, headers, F.col("rows"), F.array(F.lit("fn"), F.lit("")), F.lit("")).alias("table_text"), F.size("rows").alias("n_rows"))


@query("markdown_tables", """
SELECT r_regionkey, '| key | name        |' || chr(10) || '|-----|-------------|' || chr(10) || '| ' || rpad(r_regionkey::VARCHAR, 3, ' ') || ' | ' || rpad(r_name, 11, ' ') || ' |' || chr(10) || '|     | total width |' AS md FROM region""")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = F.array(F.array(F.lit("key"), F.lit("name")), F.array(F.col("r_regionkey").cast("string"), F.col("r_name")), F.array(F.lit(""), F.lit("total width")))
    return table(spark, sf_dir, "region").select("r_regionkey", text.markdown_table(matrix).alias("md"))


@query("pipe_tables", f"""
WITH {_LINES} SELECT doc_id, reading_order::INTEGER AS reading_order, [trim(c) FOR c IN string_split(text, '|') IF trim(c) <> ''] AS cells FROM lines WHERE contains(text, '|') AND NOT regexp_matches(text, '^[\\s|:\\-]+$')
  AND len([c FOR c IN string_split(text, '|') IF trim(c) <> '']) > 0""")
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("doc_id", "reading_order", text.pipe_matrix(F.col("text")).alias("m"))
    return rows.where(F.size("m") > 0).select("doc_id", "reading_order", F.get("m", F.lit(0)).alias("cells"))


@query("file_types", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'text' WHEN 2 THEN 'image' WHEN 3 THEN 'image' WHEN 4 THEN 'pdf' ELSE 'unknown' END AS file_type FROM documents""")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("a.PDF", "b.txt", "c.jpeg", "noext", "x.bin", "y")))
    mimes = F.array(*map(F.lit, ("", "", "application/pdf", "image/png", "application/pdf", "video/mp4")))
    i = (F.col("doc_id") % 6).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", text.file_type(F.get(names, i), F.get(mimes, i)).alias("file_type"))


@query("page_ranges", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN [1, 2, 3, 7] WHEN 1 THEN [2, 3, 4, 5] WHEN 2 THEN range(10, 60) ELSE [] END::INTEGER[] AS pages FROM documents""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = F.array(*map(F.lit, ("1-3, 7,3", "5-2", "10-500", "")))
    return table(spark, sf_dir, "documents").select("doc_id", text.page_numbers(F.get(specs, (F.col("doc_id") % 4).cast("int"))).alias("pages"))


@query("bounded_lists", f"""
WITH {_LINES}, w AS (SELECT doc_id, list(trim(regexp_replace(text, '[ \\t]+', ' ', 'g')) ORDER BY reading_order) AS xs FROM lines WHERE len(trim(text)) BETWEEN 1 AND 40 GROUP BY 1)
SELECT doc_id, list_slice([xs[i] FOR i IN range(1, len(xs) + 1) IF list_position([lower(y) FOR y IN xs], lower(xs[i])) = i], 1, 5) AS items FROM w""")
def bounded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).where(F.length(F.trim("text")).between(1, 40)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("reading_order", "text"))).alias("xs"))
    return rows.select("doc_id", text.bounded_list(F.transform("xs", lambda x: x["text"]), 5, 60).alias("items"))


@query("greedy_chunks", f"""
WITH RECURSIVE {_LINES}, w AS (SELECT doc_id, reading_order, greatest(1, (len(text) + 3) // 4) AS tokens FROM lines),
f AS (
  SELECT doc_id, reading_order, tokens, tokens AS used, 0 AS chunk FROM w WHERE reading_order = 1
  UNION ALL
  SELECT w.doc_id, w.reading_order, w.tokens, CASE WHEN f.used + w.tokens > 400 THEN w.tokens ELSE f.used + w.tokens END, CASE WHEN f.used + w.tokens > 400 THEN f.chunk + 1 ELSE f.chunk END
  FROM f JOIN w ON w.doc_id = f.doc_id AND w.reading_order = f.reading_order + 1
)
SELECT doc_id, reading_order::INTEGER AS reading_order, tokens, chunk::INTEGER AS chunk FROM f""")
def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.pack(_lines(spark, sf_dir), "doc_id", "reading_order", text.token_estimate_chars(F.col("text")), 400)


@query("continuation_merge")
def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines make a page; headings come from numbered lines."""
    rows = _lines(spark, sf_dir)
    role = F.when(text.heading_level(F.col("text")).isNotNull(), "heading").when(F.contains("text", F.lit("|")), "table").otherwise("paragraph")
    segments = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.lpad(F.col("reading_order").cast("string"), 6, "0").alias("segment_id"), F.floor((F.col("reading_order") - 1) / 5).cast("int").alias("page_index"), F.col("reading_order").alias("order_index"), role.alias("role"), "text", F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("array<string>").alias("section_path"))
    return folds.merge_continuations(segments.where(F.trim("text") != ""))


@query("title_tokens", """
WITH t AS (SELECT source, doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+.-]{2,}') AS ws FROM documents),
d AS (SELECT source, doc_id, unnest(list_distinct([lower(w) FOR w IN ws])) AS token FROM t),
c AS (SELECT source, token, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT source, token, n, rank FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY n DESC, len(token) DESC, token))::INTEGER AS rank FROM c) WHERE rank <= 3""")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tokens that most texts of a group share."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z0-9+.-]{2,}"), F.lit(0)), F.lower))
    counts = table(spark, sf_dir, "documents").select("source", F.explode(words).alias("token")).groupBy("source", "token").agg(F.count("*").alias("n")).where("n >= 2")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), F.desc(F.length("token")), "token"))
    return counts.withColumn("rank", rank).where("rank <= 3")


@query("block_type_counts", f"""
WITH {_LINES} SELECT doc_id, count(*) FILTER (contains(text, '|')) AS "table", count(*) FILTER (NOT contains(text, '|') AND regexp_matches(text, '[0-9]')) AS diagram, count(*) FILTER (NOT contains(text, '|') AND NOT regexp_matches(text, '[0-9]')) AS "text", count(*) AS total FROM lines GROUP BY doc_id""")
def block_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.contains("text", F.lit("|")), "table").when(F.rlike("text", F.lit("[0-9]")), "diagram").otherwise("text")
    wide = _lines(spark, sf_dir).withColumn("kind", kind).groupBy("doc_id").pivot("kind", ["table", "diagram", "text"]).count().na.fill(0)
    return wide.withColumn("total", F.col("table") + F.col("diagram") + F.col("text"))


@query("review_text", r"""
SELECT doc_id, array_to_string([regexp_replace(l, '\s+$', '') FOR l IN string_split(text, chr(10))], chr(10)) AS normalized FROM documents""")
def review_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.rstrip_lines(F.col("text")).alias("normalized"))


@query("page_texts")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of pages as grids (none in some data), with title and text without markup."""
    return H.page_tables(table(spark, sf_dir, "pages"))

