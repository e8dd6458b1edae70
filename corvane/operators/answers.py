"""Retrieval for many conversations at once: scope, lanes, fusion, limits and payloads in one plan.

Every step is keyed by query_id, so a table of queries is one job: the keyword lane comes from the
positional index, the dense lane meets only blocks of the documents that a query may see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import scopes
from corvane.operators import postings
from corvane.operators import retrieval as R
from corvane.shared import written


def scoped(queries: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, document_id): documents of each query's conversation that are not deleted."""
    held = links.join(documents.where(~F.col("is_deleted")).select("document_id"), "document_id").select("conversation_id", "document_id").distinct()
    return queries.select("query_id", "conversation_id").join(held, "conversation_id").select("query_id", "document_id")


def limits(queries: DataFrame, scope: DataFrame, k: int) -> DataFrame:
    """queries with scope_kind, documents, target_k, per_document and per_unit: result_limits for each row."""
    counted = queries.join(scope.groupBy("query_id").agg(F.count("*").alias("documents")), "query_id", "left").fillna(0, ["documents"])
    rows = counted.withColumn("scope_kind", scopes.query_scope(F.col("query")))
    broad, n = F.col("scope_kind") == "broad", F.col("documents")
    single = F.greatest(F.lit(k), F.when(broad, R.SINGLE_BROAD_K).otherwise(R.SINGLE_K))
    each = F.when(broad, R.PER_DOC_BROAD_K).otherwise(R.PER_DOC_K)
    return rows.withColumns({
        "target_k": F.when(n <= 0, k).when(n == 1, single).otherwise(F.greatest(F.lit(k), n * each)).cast("int"),
        "per_document": F.when(n == 1, single).when(n > 1, each).cast("int"),
        "per_unit": F.when(broad & (n > 0), R.UNIT_LIMIT).cast("int"),
    })


def lanes(queries: DataFrame, scope: DataFrame, blocks: DataFrame, index: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dense, sparse): the best blocks of each query in each lane, inside its scope.

    queries: query_id, query_vector (null: no dense lane). blocks: block_id, document_id,
    document_name, embedding; only those that may be seen. terms: query_id, term.
    """
    order = [F.asc_nulls_last("document_name"), F.asc("block_id")]
    sparse = postings.best(index, terms, blocks.select("block_id", "document_id", "document_name"), order, R.SPARSE_N, scope)
    dense = R.dense_topk_in(blocks, queries.select("query_id", "query_vector"), scope, R.DENSE_N)
    return dense, sparse


def fused(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of each query's lanes, with match_sources; the best FUSION_N."""
    part = lambda c: F.coalesce(1.0 / (R.RRF_K + F.col(c)), F.lit(0.0))
    both = dense.join(sparse, ["query_id", "block_id"], "full_outer")
    sources = F.array_compact(F.array(F.when(F.col("sparse_rank").isNotNull(), "keyword"), F.when(F.col("dense_rank").isNotNull(), "vector")))
    return postings.topk(both.withColumns({"rrf_score": part("dense_rank") + part("sparse_rank"), "match_sources": sources}), R.FUSION_N, _best(), "fused_rank")


def _best() -> list[Column]:
    return [F.desc("rrf_score"), F.desc_nulls_last("vector_score"), F.desc_nulls_last("keyword_score"), F.asc("block_id")]


def limited(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The diversity limits of each query (target_k, per_document, per_unit of asked), and the rank that results get.

    Rows without document are not limited by it; rows without unit only by document. Rows of a
    query meet in one shuffle, which serves the join and all windows.
    """
    rows = rows.repartition("query_id").join(asked.select("query_id", "target_k", "per_document", "per_unit"), "query_id")
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    for keys, most, free in ((["document_id", "unit"], "per_unit", blank("document_id") | blank("unit")), (["document_id"], "per_document", blank("document_id"))):
        n = F.row_number().over(Window.partitionBy("query_id", *keys).orderBy(*_best()))
        rows = rows.withColumn("_n", n).where(free | F.col(most).isNull() | (F.col("_n") <= F.col(most))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*_best()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= F.col("target_k")).drop("target_k", "per_document", "per_unit")


def retrieve(queries: DataFrame, links: DataFrame, documents: DataFrame, blocks: DataFrame, index: DataFrame, terms: DataFrame, k: int = R.DEFAULT_K, include_filtered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(asked, results) of a table of queries: conversation_id, query_id, query, query_vector.

    documents: document_id, is_deleted. blocks: block_id, document_id, document_name, unit, text,
    block_type, subtype, role, section_path, embedding. asked has each query with its limits,
    strategy and candidate counts; results the rows that come back, by rank, with snippets of their
    texts. Candidates carry ids, ranks and scores alone: what a block says is cut to its snippet
    once, and meets only rows that come back.
    """
    k = R.parse_k(k)
    normal = queries.withColumn("query", scopes.normalize_query(F.col("query")))
    scope = written(scoped(normal, links, documents))
    asked = limits(normal, scope, k)
    reasoned = blocks.where(scopes.non_blank(F.col("text"))).withColumn("filter_reason", scopes.filter_reason(F.col("role"), F.col("section_path")))
    shown = reasoned if include_filtered else reasoned.where("filter_reason = ''")
    dense, sparse = (written(lane) for lane in lanes(normal, scope, shown, index, terms))
    # Blocks are counted by document once, not by query.
    held = reasoned.groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(F.col("filter_reason") == "").alias("included"))
    counts = scope.join(held, "document_id").groupBy("query_id").agg(F.sum("total").alias("total"), F.sum("included").alias("included"))
    per = lambda rows, name: rows.groupBy("query_id").agg(F.count("*").alias(name))
    asked = asked.join(counts, "query_id", "left").join(per(dense, "dense_candidates"), "query_id", "left").join(per(sparse, "sparse_candidates"), "query_id", "left")
    asked = asked.fillna(0, ["total", "included", "dense_candidates", "sparse_candidates"])
    strategy = F.when(F.col("query") == "", "empty_query").when(F.col("documents") == 0, "empty_scope").when(F.col("query_vector").isNull(), "keyword_fallback").otherwise("rrf")
    asked = written(asked.withColumn("strategy", strategy).drop("query_vector"))
    live = asked.where("query <> '' AND documents > 0")
    said = written(shown.withColumns({"snippet": scopes.snippet(F.col("text")), "_row": F.monotonically_increasing_id()}).drop("embedding", "text"))
    rows = fused(dense, sparse).join(said.select("block_id", "document_id", "unit", "_row"), "block_id")
    return asked, limited(rows, live).join(said.drop("block_id", "document_id", "unit"), "_row").drop("_row")


def serialized(rows: DataFrame) -> DataFrame:
    """Results with is_filtered and relevance_reason, as answers carry them."""
    kind, subtype, role = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("block_type", "subtype", "role"))
    path = F.filter(F.transform(F.coalesce("section_path", F.array().cast("array<string>")), scopes.strip), lambda s: s != "")
    rows = rows.withColumns({"block_type": kind, "subtype": subtype, "text_role": role, "section_path": path, "is_filtered": F.col("filter_reason") != ""})
    return rows.withColumn("relevance_reason", scopes.relevance_reason(F.col("block_type"), F.col("subtype"), F.col("text_role"), F.col("section_path"), F.col("filter_reason")))


#: Fields of a result in a payload, in this order.
RESULT = ("rank", "block_id", "document_id", "document_name", "score", "snippet", "block_type", "subtype", "text_role", "section_path", "is_filtered", "filter_reason", "relevance_reason", "vector_score", "keyword_score", "rrf_score", "dense_rank", "sparse_rank", "match_sources")


def payloads(asked: DataFrame, results: DataFrame, k: int, include_filtered: bool = False) -> DataFrame:
    """(query_id, payload): one JSON object a query, also for queries without results.

    A query has at most target_k results, so its list is bounded.
    """
    rows = serialized(results).withColumn("score", F.col("rrf_score"))
    got = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*RESULT))).alias("results"), F.count_distinct("document_id").alias("documents_covered"), F.count_distinct(F.struct("document_id", "unit")).alias("source_units_covered"))
    every = asked.join(got, "query_id", "left").fillna(0, ["documents_covered", "source_units_covered"])
    summary = F.struct(
        F.col("total").alias("total_candidate_count"),
        F.col("included").alias("included_candidate_count"),
        F.greatest(F.lit(0), F.col("total") - F.col("included")).alias("excluded_candidate_count"),
        F.col("total" if include_filtered else "included").alias("visible_candidate_count"),
        F.lit(include_filtered).alias("include_filtered"),
    )
    candidates = F.struct("dense_candidates", "sparse_candidates", "documents_covered", "source_units_covered")
    none = F.array().cast(got.schema["results"].dataType)
    fields = F.struct("query", F.lit(k).alias("requested_k"), F.col("target_k").alias("k"), "strategy", F.coalesce(F.size("results"), F.lit(0)).alias("returned_count"), summary.alias("filter_summary"), candidates.alias("candidate_summary"), F.coalesce("results", none).alias("results"), F.lit(include_filtered).alias("include_filtered"))
    return every.select("query_id", F.to_json(fields).alias("payload"))
