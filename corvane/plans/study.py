"""Queries of prompt profiles, study aids, estimates and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import study
from corvane.functions.text import file_type
from corvane.operators import review, structure
from corvane.plans.registry import query, table


def _profile_sql() -> str:
    tests = {"query": "contains(q, '{p}')", "context": "contains(h, '{p}')", "start": "starts_with(q, '{p}')"}
    return " ".join(f"WHEN {' OR '.join(tests[where].format(p=p) for p in phrases)} THEN '{name}'" for name, where, phrases in study.PROFILES)


@query("prompt_profile", rf"""
WITH t AS (SELECT conv_id, turn, lower(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) AS q, concat_ws(' ', lag(text, 2) OVER w, lag(text) OVER w) AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT conv_id, turn, q, lower(concat_ws(' ', nullif(c, ''), q)) AS h FROM t)
SELECT conv_id, turn, CASE {_profile_sql()} ELSE 'default' END AS profile FROM u""")
def prompt_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("c", F.concat_ws(" ", F.lag("text", 2).over(w), F.lag("text").over(w)))
    return rows.select("conv_id", "turn", study.prompt_profile(F.col("text"), F.col("c")).alias("profile"))


@query("processing_estimates", """
WITH f AS (SELECT source, least(900, greatest(20, floor(18 + n_chars * 400.0::DOUBLE / 1048576 * 4.2::DOUBLE + 0.5)))::BIGINT AS s FROM documents),
t AS (SELECT source, sum(s)::BIGINT AS total, floor(sum(s) * 0.75::DOUBLE + 0.5)::BIGINT AS lo, floor(sum(s) * 1.35::DOUBLE + 0.5)::BIGINT AS hi FROM f GROUP BY 1)
SELECT source, total, lo AS min_seconds, hi AS max_seconds, floor(lo / 60.0::DOUBLE + 0.5)::BIGINT || CASE WHEN floor(lo / 60.0::DOUBLE + 0.5) = 1 THEN ' min' ELSE ' mins' END || ' - ' || floor(hi / 60.0::DOUBLE + 0.5)::BIGINT || CASE WHEN floor(hi / 60.0::DOUBLE + 0.5) = 1 THEN ' min' ELSE ' mins' END AS label FROM t""")
def processing_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("source", study.processing_seconds(F.col("n_chars") * 400.0).alias("s"))
    low, high = study.half_up(F.col("total") * 0.75), study.half_up(F.col("total") * 1.35)
    return each.groupBy("source").agg(F.sum("s").alias("total")).select("source", "total", low.alias("min_seconds"), high.alias("max_seconds"), F.concat(study.duration_label(low), F.lit(" - "), study.duration_label(high)).alias("label"))


@query("flashcards", """
SELECT doc_id, ['q' || doc_id || ':a', source || ':' || lang] AS cards FROM documents""")
def flashcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = lambda f, b: F.struct(f.alias("front"), b.alias("back"))
    raw = F.array(card(F.concat(F.lit(" q"), F.col("doc_id").cast("string")), F.lit("a ")), card(F.lit("only front"), F.lit(" ")), card(F.col("source"), F.col("lang")), card(F.lit("x"), F.lit("y")))
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(study.valid_cards(raw, 2), lambda c: F.concat_ws(":", c["front"], c["back"])).alias("cards"))


@query("mindmap_nodes", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['a<-root', 'b<a-' || source] ELSE ['b<-' || source, 'c<b-leaf'] END AS nodes FROM documents""")
def mindmap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda i, p, t: F.struct(F.lit(i).alias("id"), F.lit(p).cast("string").alias("parent_id"), t.alias("text"))
    rooted = F.array(node("a", None, F.lit("root")), node("b", "a", F.col("source")), node("b", "a", F.lit("again")), node("", "a", F.lit("x")))
    unrooted = F.array(node("b", "zz", F.col("source")), node("c", "b", F.lit("leaf")), node("d", "b", F.lit(" ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(study.valid_nodes(F.when(F.col("doc_id") % 2 == 0, rooted).otherwise(unrooted)), lambda n: F.concat(n["id"], F.lit("<"), F.coalesce(n["parent_id"], F.lit("")), F.lit("-"), n["text"])).alias("nodes"))


@query("sentence_like", f"""
WITH l AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS ls FROM documents),
m AS (SELECT doc_id, len(ls) AS n, len([x FOR x IN ls IF len(regexp_extract_all(lower(x), '[a-z'']+')) >= 6]) AS a,
  len([x FOR x IN ls IF list_has_any(regexp_extract_all(lower(x), '[a-z'']+'), [{", ".join(f"'{w}'" for w in study.HELPERS)}])]) AS b, len([x FOR x IN ls IF regexp_matches(x, '[.!?,:;]')]) AS c FROM l)
SELECT doc_id, n > 0 AND a / greatest(1, n) >= 0.5 AND b / greatest(1, n) >= 0.5 AND c / greatest(1, n) >= 0.2 AS sentence_like FROM m""")
def sentence_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    return table(spark, sf_dir, "documents").select("doc_id", study.sentence_like(lines).alias("sentence_like"))


@query("intro_texts", r"""
WITH s AS (SELECT source, count(*) AS n, min(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 40)) AS summary FROM documents GROUP BY 1)
SELECT source, 'Your ' || n || ' documents are processed and ready for Q&A.' || chr(10) || chr(10) || 'Conversation summary: ' || trim(summary) || chr(10) || chr(10) || 'Key points:' || chr(10) || '- one' || chr(10) || '- two' AS intro FROM s""")
def intro_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.left(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(40))
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min(head).alias("summary"))
    return rows.select("source", study.intro_text(F.col("n"), F.col("summary"), F.array(F.lit(" one"), F.lit(" "), F.lit("two"))).alias("intro"))


@query("upload_warnings", """
WITH f AS (SELECT source, list(doc_id || '.bin' ORDER BY doc_id) FILTER (lang IS NULL OR lang NOT IN ('en', 'de')) AS names FROM documents GROUP BY 1)
SELECT source, 'Some files were skipped due to unsupported format: ' || array_to_string(names[1:2], ', ') || CASE WHEN len(names) > 2 THEN ' and ' || (len(names) - 2) || ' more' ELSE '' END || '.' AS warning FROM f WHERE names IS NOT NULL""")
def upload_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads are named by the document's language; the warning names those whose extension no parser takes."""
    docs = table(spark, sf_dir, "documents")
    end = F.when(F.col("lang") == "en", ".pdf").when(F.col("lang") == "de", ".txt").otherwise(".bin")
    return _skipped(docs.where(file_type(F.concat(F.col("doc_id").cast("string"), end), F.lit("")) == "unknown"))


def _skipped(bad: DataFrame) -> DataFrame:
    """source and warning: two names and a count a source, never all of its ids in one place."""
    first = bad.select("source", "doc_id").withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("_n <= 2")
    ids = first.groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    totals = bad.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("total"))
    names = F.transform("ids", lambda i: F.concat(i.cast("string"), F.lit(".bin")))
    return ids.join(totals, F.col("source").eqNullSafe(F.col("_source"))).select("source", study.skipped_files(names, F.col("total")).alias("warning"))


@query("review_diff", """
WITH l AS (SELECT doc_id, i AS reading_order, string_split(text, chr(10))[i] AS text FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
SELECT doc_id, reading_order::INTEGER AS reading_order, reading_order = 2 AND doc_id % 2 = 0 AS changed, CASE WHEN reading_order = 2 AND doc_id % 2 = 0 THEN text || '!' ELSE text END AS text FROM l""")
def review_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.lines(table(spark, sf_dir, "documents")).withColumn("block_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("reading_order").cast("string")))
    edits = rows.where("reading_order = 2").select("block_id", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return review.apply_edits(rows, edits).select("doc_id", "reading_order", "changed", "text")


@query("review_impact", """
WITH RECURSIVE l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents),
hit AS (SELECT doc_id, pos FROM l WHERE pos = 3 UNION SELECT l.doc_id, l.pos FROM hit JOIN l ON l.doc_id = hit.doc_id AND l.pos = hit.pos + 2)
SELECT doc_id, pos::INTEGER AS block_id FROM hit""")
def review_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's context is the block two before: a change of block 3 reaches 5, 7 and so on."""
    rows = structure.lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("reading_order").alias("block_id"))
    links = rows.select("doc_id", "block_id", F.col("block_id").alias("pos"), (F.col("block_id") - 2).alias("context_id"))
    return review.impacted(links, rows.where("block_id = 3"))
