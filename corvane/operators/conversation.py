"""Versioned conversations: as-of links, active branches, citations, guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.shared import written

#: What an answer without supported evidence says, and its prompt version.
REFUSAL, REFUSAL_VERSION = "The selected documents do not contain enough information to answer this question.", "insufficient-evidence"


def message_order() -> list[Column]:
    """created, family and version (nulls last), user first, id."""
    return [F.asc("created_at"), F.asc_nulls_last("family_id"), F.asc_nulls_last("family_version_number"), F.when(F.col("role") == "user", 0).otherwise(1), F.asc("message_id")]


def latest_before(rows: DataFrame, group: str, order: str, value: str, where: Column, out: str) -> DataFrame:
    """As-of join of a table with itself: the last value that satisfies a condition strictly before each row."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(F.when(where, F.col(value)), ignorenulls=True).over(before))


def as_of_join(left: DataFrame, right: DataFrame, on: str, time: str, value: str, out: str) -> DataFrame:
    """Add to each left row the right table's last value at or before its time (null if none).

    Both sides are merged in one sort by key and time, so nothing is joined by range: right rows
    come first at equal times, and the last non-null value runs on.
    """
    both = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_left": F.lit(1)}).unionByName(right.select(on, time, F.col(value).alias("_v"), F.lit(0).alias("_left")), allowMissingColumns=True)
    upto = Window.partitionBy(on).orderBy(time, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(upto)).where("_left = 1").drop("_v", "_left")


def best_children(messages: DataFrame) -> DataFrame:
    """The child each message continues with: (parent_id, child_id).

    Users are children of branch_parent_message_id (null: the root) and must be active; assistants
    answer reply_to_message_id and fall back to inactive ones. Of several the highest (version,
    created, id) is taken.
    """
    parent = F.when(F.col("role") == "user", F.col("branch_parent_message_id")).otherwise(F.col("reply_to_message_id"))
    rows = messages.where(F.col("role").isin("user", "assistant")).where((F.col("role") != "user") | F.coalesce("is_active_in_family", F.lit(True)))
    rank = F.struct((F.coalesce("is_active_in_family", F.lit(True)) | (F.col("role") == "user")).cast("int").alias("a"), F.coalesce("family_version_number", F.lit(0)).alias("v"), "created_at", "message_id")
    return rows.withColumn("parent_id", parent).groupBy("conversation_id", "parent_id", "role").agg(F.max_by("message_id", rank).alias("child_id"))


def active_branch(messages: DataFrame) -> DataFrame:
    """(conversation_id, step, message_id) of the active path of every conversation.

    Pointers are doubled: each message knows an ancestor and how far up it is, and takes that one's
    ancestor in each round, so a path of n messages needs log2(n) joins whatever n is. Messages
    whose way up does not end at a root (a user message without parent) are on no path. Every
    round is written to the shared folder.
    """
    edges = best_children(messages).where("parent_id IS NOT NULL OR role = 'user'")
    now = written(edges.select("conversation_id", F.col("child_id").alias("message_id"), F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("step")))
    # A way up that is longer than there are messages is a circle, which no root reaches.
    rounds = max(1, now.count()).bit_length() + 1
    for _ in range(rounds):
        if now.where("up IS NOT NULL").isEmpty():
            break
        above = now.select("conversation_id", F.col("message_id").alias("up"), F.col("up").alias("top"), F.col("step").alias("more"))
        moved = now.where("up IS NOT NULL").join(above, ["conversation_id", "up"]).select("conversation_id", "message_id", F.col("top").alias("up"), (F.col("step") + F.col("more")).alias("step"))
        now = written(now.where("up IS NULL").union(moved))
    return now.where("up IS NULL").select("conversation_id", F.col("step").cast("int").alias("step"), "message_id")


def latest(rows: DataFrame, group: str, n: int, *newest_first: Column) -> DataFrame:
    """The newest n rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*newest_first))).where(F.col("_n") <= n).drop("_n")


def supported(ids: Column, support: Column) -> Column:
    """Distinct cited ids that the retrieval returned, in order."""
    return F.filter(F.array_distinct(F.filter(ids, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))), lambda x: F.array_contains(support, x))


def guardrail(answers: DataFrame) -> DataFrame:
    """Keep supported citations; without any, refuse. answers: citation_block_ids, result_ids, answer_text, confidence, prompt_version.

    A single citation does not lower the confidence; an unknown or missing one counts as partial.
    """
    kept = supported(F.col("citation_block_ids"), F.col("result_ids"))
    out = answers.withColumn("citation_block_ids", kept)
    none = F.size("citation_block_ids") == 0
    stated = F.lower(F.trim(F.coalesce("confidence", F.lit(""))))
    return out.withColumns(
        {
            "answer_text": F.when(none, REFUSAL).otherwise(F.col("answer_text")),
            "confidence": F.when(none, "insufficient").when(stated.isin("high", "partial", "insufficient"), stated).otherwise("partial"),
            "prompt_version": F.when(none, REFUSAL_VERSION).otherwise(F.col("prompt_version")),
        }
    )


def citations(answers: DataFrame, results: DataFrame) -> DataFrame:
    """A row a citation in the model's order: index (from 1), block, document and page label."""
    cited = answers.select("answer_id", F.posexplode("citation_block_ids").alias("_p", "block_id"))
    label = F.when(F.col("page").isNotNull(), F.concat(F.lit("p. "), F.col("page").cast("string"))).otherwise("")
    return cited.join(results, ["answer_id", "block_id"]).select("answer_id", (F.col("_p") + 1).alias("citation_index"), "block_id", "document_id", label.alias("page_label"))


def markers(text: Column) -> Column:
    """Numbers of the [n] marks of an answer, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))


def evidence_line(index: Column, name: Column, page: Column, text: Column, limit: int = 2000) -> Column:
    """[1] name (p. 3): text, cut to `limit` characters."""
    place = F.when(page.isNotNull(), F.concat(F.lit(" (p. "), page.cast("string"), F.lit(")"))).otherwise("")
    return F.left(F.concat(F.lit("["), index.cast("string"), F.lit("] "), name, place, F.lit(": "), text), F.lit(limit))


#: Characters of the piece that keys an item of few words.
GRAM = 8


def containment(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id of each row of items (item_id, text) and of docs (doc_id, text) that contains its whole text.

    Hash joins instead of all pairs. The longest pair of neighbouring words inside an item stands
    whole in any text that contains it and keys both sides. An item of fewer than four words has
    no pair that is sure to be whole: characters from its middle key it, against those of every
    text. contains() confirms. Texts join only candidates; every pair of rows comes out once.
    """
    held = items.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("_item"), "item_id", F.col("text").alias("_held"))
    own = docs.where("text IS NOT NULL").select("doc_id", "text")
    worded = held.withColumn("_w", F.split("_held", r"\s+"))
    pairs_of = lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda x, y: F.concat_ws(" ", x, y))
    # The first and last word of an item may be parts of longer words, so pairs are taken from between.
    pairs = F.slice(pairs_of(F.col("_w")), F.lit(2), F.greatest(F.size("_w") - 3, F.lit(0)))
    longest = F.array_max(F.transform(pairs, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    keyed = worded.where(F.size("_w") >= 4).select("_item", "item_id", "_held", longest.alias("_key"))
    words = own.select("doc_id", F.split("text", r"\s+").alias("_w")).where(F.size("_w") > 1)
    found = words.select("doc_id", F.explode(F.array_distinct(pairs_of(F.col("_w")))).alias("_key")).join(keyed, "_key").select("doc_id", "_item", "item_id", "_held")
    n = F.least(F.length("_held"), F.lit(GRAM))
    short = worded.where(F.size("_w") < 4).select("_item", "item_id", "_held", n.alias("_n"), F.substring(F.col("_held"), F.floor((F.length("_held") - n) / 2).cast("int") + 1, n).alias("_key"))
    for (size,) in short.select("_n").distinct().collect():
        # A lookahead finds the pieces that begin at every character in one pass.
        pieces = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))) if size else F.array(F.lit(""))
        at = own.select("doc_id", F.explode(pieces).alias("_key")).join(short.where(F.col("_n") == size), "_key")
        found = found.union(at.select("doc_id", "_item", "item_id", "_held"))
    found = found.distinct().withColumnRenamed("doc_id", "_doc")
    return found.join(own, F.col("_doc").eqNullSafe(F.col("doc_id"))).where(F.contains("text", F.col("_held"))).select("item_id", "doc_id")
