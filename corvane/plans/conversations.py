"""Conversation queries: as-of parents, branches, versions, context tails, citations, guardrails, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.scopes import collapse
from corvane.functions.text import at_word, title_from_filename
from corvane.operators import conversation as C
from corvane.plans.registry import query, table

_TURNS = "turns AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant'))"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))


@query("asof_parent", f"""
WITH {_TURNS} SELECT conv_id, turn, (last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS parent_turn FROM turns""")
def asof_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest assistant message before each message."""
    return C.latest_before(_turns(spark, sf_dir), "conv_id", "turn", "turn", F.col("role") == "assistant", "parent_turn").select("conv_id", "turn", "parent_turn")


@query("asof_join_events", """
WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT a.event_id, b.event_id AS last_view FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view at or before each purchase of a user."""
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return C.as_of_join(bought, views, "user_id", "ts", "event_id", "last_view").select("event_id", "last_view")


# Messages with versions: every third user turn was edited once, so its family has two versions.
_MESSAGES = f"""
{_TURNS}, v AS (SELECT *, unnest(CASE WHEN role = 'user' AND turn % 3 = 0 THEN [1, 2] ELSE [1] END) AS ver FROM turns),
messages AS (
  SELECT conv_id::VARCHAR AS conversation_id, conv_id || '-' || lpad(turn::VARCHAR, 4, '0') || '-' || ver AS message_id, role, turn, ver,
    lag_turn, CASE WHEN role = 'user' THEN parent END AS branch_parent, CASE WHEN role = 'assistant' THEN parent END AS reply_to, (ver = 2 OR NOT (role = 'user' AND turn % 3 = 0)) AS active
  FROM (SELECT v.*, l.lag_turn, CASE WHEN l.lag_turn IS NULL THEN NULL ELSE v.conv_id || '-' || lpad(l.lag_turn::VARCHAR, 4, '0') || '-' || CASE WHEN l.lag_role = 'user' AND l.lag_turn % 3 = 0 THEN 2 ELSE 1 END END AS parent
    FROM v JOIN (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS lag_turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS lag_role FROM turns) l ON l.conv_id = v.conv_id AND l.turn = v.turn)
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a message tree: a message hangs on the last version of the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = _turns(spark, sf_dir).withColumns({"_t": F.lag("turn").over(w), "_r": F.lag("role").over(w)})
    ident = lambda t, v: F.concat_ws("-", F.col("conv_id").cast("string"), F.lpad(t.cast("string"), 4, "0"), v.cast("string"))
    edited = (F.col("role") == "user") & (F.col("turn") % 3 == 0)
    parent = F.when(F.col("_t").isNotNull(), ident(F.col("_t"), F.when((F.col("_r") == "user") & (F.col("_t") % 3 == 0), 2).otherwise(1)))
    rows = turns.withColumn("family_version_number", F.explode(F.when(edited, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        ident(F.col("turn"), F.col("family_version_number")).alias("message_id"),
        "role", "turn", "text", "family_version_number",
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("family_id"),
        F.col("turn").alias("created_at"),
        F.when(F.col("role") == "user", parent).alias("branch_parent_message_id"),
        F.when(F.col("role") == "assistant", parent).alias("reply_to_message_id"),
        (~edited | (F.col("family_version_number") == 2)).alias("is_active_in_family"),
    )


@query("branch_walk", f"""
WITH RECURSIVE {_MESSAGES}, ranked AS (
  SELECT conversation_id, coalesce(branch_parent, reply_to) AS parent, message_id, row_number() OVER (PARTITION BY conversation_id, coalesce(branch_parent, reply_to), role ORDER BY ver DESC, turn DESC, message_id DESC) AS rn, role
  FROM messages WHERE role <> 'user' OR active
), path AS (
  SELECT conversation_id, 1 AS step, message_id FROM ranked WHERE parent IS NULL AND role = 'user' AND rn = 1
  UNION ALL
  SELECT p.conversation_id, p.step + 1, r.message_id FROM path p JOIN ranked r ON r.conversation_id = p.conversation_id AND r.parent = p.message_id AND r.rn = 1
)
SELECT * FROM path""")
def branch_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.active_branch(messages(spark, sf_dir))


@query("version_counts", f"""
WITH {_MESSAGES} SELECT conversation_id, turn, role, count(DISTINCT ver) AS versions, max(ver)::INTEGER + 1 AS next_version FROM messages GROUP BY 1, 2, 3""")
def version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    return rows.groupBy("conversation_id", "turn", "role").agg(F.count_distinct("family_version_number").alias("versions"), (F.max("family_version_number") + 1).alias("next_version"))


@query("message_numbers", f"""
WITH {_MESSAGES} SELECT message_id, (row_number() OVER (PARTITION BY conversation_id ORDER BY turn, conversation_id || '-' || turn NULLS LAST, ver NULLS LAST, CASE WHEN role = 'user' THEN 0 ELSE 1 END, message_id))::INTEGER AS seq FROM messages""")
def message_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("message_id", F.row_number().over(Window.partitionBy("conversation_id").orderBy(*C.message_order())).alias("seq"))


@query("recent_context", f"""
WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM turns)
SELECT conv_id, turn, role, left(text, 500) AS text FROM r WHERE n <= 4""")
def recent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 4 entries, 500 characters each."""
    return C.latest(_turns(spark, sf_dir), "conv_id", 4, F.desc("turn")).select("conv_id", "turn", "role", F.left("text", F.lit(500)).alias("text"))


@query("distinct_roles", "SELECT DISTINCT role FROM conversations")
def distinct_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("role").distinct()


_ANSWERS = """
answers AS (
  SELECT conv_id AS answer_id, ['b' || conv_id % 7, 'b' || conv_id % 7, 'missing', 'b' || conv_id % 3] AS cited, ['b' || conv_id % 3, 'b5', 'b6'] AS results, 'high' AS confidence FROM conversations WHERE role = 'user' AND turn = 0
)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lambda n: F.concat(F.lit("b"), (F.col("conv_id") % n).cast("string"))
    first = table(spark, sf_dir, "conversations").where("role = 'user' AND turn = 0")
    ids = F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("missing"))).otherwise(F.array(b(7), b(7), F.lit("missing"), b(3)))
    return first.select(F.col("conv_id").alias("answer_id"), ids.alias("citation_block_ids"), F.array(b(3), F.lit("b5"), F.lit("b6")).alias("result_ids"), F.lit("high").alias("confidence"), F.lit("said").alias("answer_text"), F.lit("v1").alias("prompt_version"))


_KEPT = "[x FOR x IN CASE WHEN answer_id % 5 = 0 THEN ['missing'] WHEN answer_id % 7 = answer_id % 3 THEN [cited[1]] ELSE [cited[1], cited[4]] END IF list_contains(results, x)]"


@query("guardrail", f"""
WITH {_ANSWERS}, k AS (SELECT *, {_KEPT} AS kept FROM answers)
SELECT answer_id, kept AS citation_block_ids, CASE WHEN len(kept) = 0 THEN 'insufficient' ELSE confidence END AS confidence, CASE WHEN len(kept) = 0 THEN '{C.REFUSAL_VERSION}' ELSE 'v1' END AS prompt_version FROM k""")
def guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.guardrail(_answers(spark, sf_dir)).select("answer_id", "citation_block_ids", "confidence", "prompt_version")


@query("citation_map", f"""
WITH {_ANSWERS}, k AS (SELECT answer_id, {_KEPT} AS kept FROM answers)
SELECT answer_id, i::INTEGER AS citation_index, kept[i] AS block_id, 'd' || kept[i] AS document_id, 'p. ' || (answer_id % 9) AS page_label FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS i FROM k)""")
def citation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = C.guardrail(_answers(spark, sf_dir))
    results = answers.select("answer_id", F.explode("result_ids").alias("block_id")).distinct().withColumns({"document_id": F.concat(F.lit("d"), "block_id"), "page": F.col("answer_id") % 9})
    return C.citations(answers, results)


@query("citation_markers", r"""
SELECT doc_id, [x::INTEGER FOR x IN regexp_extract_all('see [' || doc_id % 13 || '] and [2][x] [' || doc_id % 5 || '].', '\[([0-9]{1,9})\]', 1)] AS marks FROM documents""")
def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.format_string("see [%d] and [2][x] [%d].", F.col("doc_id") % 13, F.col("doc_id") % 5)
    return table(spark, sf_dir, "documents").select("doc_id", C.markers(said).alias("marks"))


@query("citation_containment", """
SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)""")
def citation_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain the whole text of a benchmark item."""
    return C.containment(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("evidence_lines", """
SELECT doc_id, left('[' || doc_id % 9 || '] ' || source || CASE WHEN doc_id % 4 <> 0 THEN ' (p. ' || doc_id % 4 || ')' ELSE '' END || ': ' || text, 2000) AS line FROM documents""")
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", C.evidence_line(d % 9, F.col("source"), F.nullif(d % 4, F.lit(0)), F.col("text")).alias("line"))


@query("first_message_titles", r"""
WITH f AS (SELECT conv_id, min_by(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, trim(left(trim(regexp_replace(t, '\s+', ' ', 'g')), 120)) AS title FROM f""")
def first_message_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", F.trim(F.left(collapse(F.col("t")), F.lit(120))).alias("title"))


@query("word_boundary_cut", """
WITH h AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS t FROM documents), c AS (SELECT doc_id, t, trim(left(t, 200), ' ' || chr(10)) AS head FROM h),
l AS (SELECT *, greatest(CASE WHEN contains(head, ' ') THEN len(head) - position(' ' IN reverse(head)) ELSE -1 END, CASE WHEN contains(head, chr(10)) THEN len(head) - position(chr(10) IN reverse(head)) ELSE -1 END) AS last_ FROM c)
SELECT doc_id, CASE WHEN len(t) <= 200 THEN t WHEN last_ > 120 THEN trim(left(head, last_), ' ' || chr(10)) ELSE head END AS cut FROM l""")
def word_boundary_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", at_word(F.regexp_replace("text", r"^[ \n]+|[ \n]+$", ""), 200).alias("cut"))


@query("filename_titles", r"""
SELECT doc_id, left(trim(regexp_replace(replace(replace(regexp_replace(source || '_annual-report ' || doc_id || '.v2.pdf', '\.[^.]+$', ''), '_', ' '), '-', ' '), '\s+', ' ', 'g')), 120) AS title FROM documents""")
def filename_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit("_annual-report "), F.col("doc_id").cast("string"), F.lit(".v2.pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", title_from_filename(name).alias("title"))
