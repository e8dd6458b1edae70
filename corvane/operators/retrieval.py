"""Hybrid retrieval: dense and keyword lanes, fusion, diversity limits and reranking.

Everything is a lazy plan over DataFrames. Top-k selections become TakeOrderedAndProject or
windows with a group limit, so a lane moves k rows a task, not the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vectors import clamp01, cosine, similarity, valid
from corvane.shared import written

# Defaults of the ranking.
DEFAULT_K, MAX_K = 5, 20
POOL_FACTOR, POOL_FLOOR, POOL_CAP = 3, 15, 50
DENSE_N, SPARSE_N, FUSION_N, RRF_K = 50, 50, 100, 60
VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
SINGLE_K, SINGLE_BROAD_K, PER_DOC_K, PER_DOC_BROAD_K, UNIT_LIMIT = 10, 14, 5, 6, 2


@dataclass(frozen=True)
class Limits:
    target_k: int
    per_document: int | None
    per_unit: int | None


def parse_k(k: int | str | None) -> int:
    """1..MAX_K; the default for nothing."""
    if k in (None, ""):
        return DEFAULT_K
    n = int(k)
    if not 1 <= n <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")
    return n


def pool_size(k: int) -> int:
    return min(POOL_CAP, max(POOL_FACTOR * k, POOL_FLOOR))


def result_limits(k: int, documents: int, scope: str) -> Limits:
    """How many results, and how many of one document and source unit, a query may return."""
    broad = scope == "broad"
    unit = UNIT_LIMIT if broad else None
    if documents <= 0:
        return Limits(k, None, None)
    if documents == 1:
        n = max(k, SINGLE_BROAD_K if broad else SINGLE_K)
        return Limits(n, n, unit)
    each = PER_DOC_BROAD_K if broad else PER_DOC_K
    return Limits(max(k, documents * each), each, unit)


def scope_documents(links: DataFrame, documents: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Documents of a conversation that are not deleted; requested ids outside it are an error."""
    scope = links.join(documents.where(~F.col("is_deleted")), "document_id").select("document_id").distinct()
    if requested is None:
        return scope
    outside = requested.join(scope, "document_id", "left_anti").limit(3).collect()
    if outside:
        raise ValueError(f"documents outside the conversation: {[r['document_id'] for r in outside]}")
    return scope.join(requested, "document_id", "left_semi")


def dense_topk(blocks: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "block_id", clamp_only: bool = False) -> DataFrame:
    """The k blocks of largest cosine, with vector_score and dense_rank; ties to the smaller key.

    clamp_only: score clamp(cosine), as an external index reports it, instead of (cosine + 1) / 2.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    score = clamp01(cosine(F.col(vector), q)) if clamp_only else similarity(F.col(vector), q)
    top = blocks.where(F.col(vector).isNotNull()).withColumn("vector_score", score).orderBy(F.desc_nulls_last("vector_score"), key).limit(k)
    return top.withColumn("dense_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("vector_score"), key)))


#: Rows of queries and of blocks in a tile, and scores computed at a time.
TILE, CELLS = 4096, 1 << 20


def _tile(k: int, others: bool = True):
    """others: a query does not find the block of its own id."""

    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        if len(queries) and len(blocks):
            q, b = (np.array(t["v"].combine_chunks().flatten(), np.float64).reshape(len(t), -1) for t in (queries, blocks))
            (q_row, q_id), b_id = (queries[c].to_numpy() for c in ("row", "id")), blocks["id"].to_numpy()
            # Squares and products are added in order of the components, as expressions add them.
            length = lambda m: np.sqrt(sum(m[:, c] * m[:, c] for c in range(m.shape[1])))
            q_len, b_len = length(q), length(b)
            near = (b / b_len[:, None]).T
            step = max(1, CELLS // len(b))
            for at in range(0, len(q), step):
                own = slice(at, at + step)
                rough = (q[own] / q_len[own, None]) @ near
                if others:
                    rough[q_id[own, None] == b_id[None, :]] = -np.inf
                limit = np.partition(rough, -k, axis=1)[:, -k] if len(b) >= k else np.full(len(rough), -np.inf)
                # Rounding of the product is far below 1e-9: nothing that belongs to the k is left out.
                i, j = np.nonzero((rough >= limit[:, None] - 1e-9) & (rough > -np.inf))
                i += at
                cos = sum(q[i, c] * b[j, c] for c in range(q.shape[1])) / (b_len[j] * q_len[i])
                score = np.clip((cos + 1.0) / 2.0, 0.0, 1.0)
                order = np.lexsort((b_id[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append(pa.table([q_row[i[first]], q_id[i[first]], b_id[j[first]], score[first]], names=["_row", "query_id", "block_id", "vector_score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=["_row", "query_id", "block_id", "vector_score"])

    return run


def _topk_of_all(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """An equal block join: every tile of queries meets every tile of blocks, and leaves k rows a query."""

    def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
        v = F.col(vector)
        good = rows.where(F.col(key).isNotNull() & valid(v)).where(F.exists(v, lambda x: x != 0))
        return good.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return rows.select("*", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    asked, held = usable(queries, "query_id", "query_vector"), usable(blocks, "block_id", "embedding")
    n, m = (-(-rows.count() // TILE) or 1 for rows in (asked, held))
    keys = ("dim", "_q", "_b")
    found = dealt(asked, "_q", n, "_b", m).groupBy(*keys).cogroup(dealt(held, "_b", m, "_q", n).groupBy(*keys)).applyInArrow(_tile(k), "_row long, query_id long, block_id long, vector_score double")
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("vector_score"), "block_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("_row")


def dense_topk_in(blocks: DataFrame, queries: DataFrame, scope: DataFrame, k: int, rank: str = "dense_rank") -> DataFrame:
    """(query_id, block_id, vector_score, rank): the k blocks of largest similarity in the documents of each query.

    blocks: block_id, document_id, embedding; queries: query_id, query_vector; scope: query_id,
    document_id. Tiles of a document's queries meet tiles of its blocks. Vectors without a length,
    or of another than the first query's, meet one by one; their null scores come last.
    """
    held = blocks.where("embedding IS NOT NULL AND block_id IS NOT NULL").select("document_id", F.col("block_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = scope.join(queries.where("query_vector IS NOT NULL"), "query_id").select("document_id", F.col("query_id").cast("long").alias("id"), F.col("query_vector").cast("array<double>").alias("v"))
    some = asked.select(F.size("v")).first()
    dim = some[0] if some else 0
    plain = lambda rows: rows.withColumn("_plain", valid(F.col("v"), dim) & F.exists("v", lambda x: x != 0))
    held, asked = written(plain(held)), written(plain(asked))

    # A row is copied as often as its own document has tiles on the other side.
    tiles = lambda rows, name: rows.where("_plain").groupBy("document_id").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    sizes = written(tiles(asked, "_n").join(tiles(held, "_m"), "document_id"))

    def dealt(rows: DataFrame, own: str, n: str, other: str, m: str) -> DataFrame:
        return rows.where("_plain").join(sizes, "document_id").select(F.monotonically_increasing_id().alias("row"), "document_id", "id", "v", F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other))

    keys = ("document_id", "_q", "_b")
    found = dealt(asked, "_q", "_n", "_b", "_m").groupBy(*keys).cogroup(dealt(held, "_b", "_m", "_q", "_n").groupBy(*keys)).applyInArrow(_tile(k, False), "_row long, query_id long, block_id long, vector_score double")
    q, b = asked.toDF("document_id", "query_id", "_qv", "_qp"), held.toDF("document_id", "block_id", "_bv", "_bp")
    score = similarity(F.col("_bv"), F.col("_qv")).alias("vector_score")
    odd = q.where("NOT _qp").join(b, "document_id").union(q.where("_qp").join(b.where("NOT _bp"), "document_id")).select("query_id", "block_id", score)
    every = found.drop("_row").union(odd)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("vector_score"), F.asc("block_id")))
    return every.withColumn(rank, nth).where(F.col(rank) <= k)


def dense_topk_per_query(blocks: DataFrame, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """Top k for each row of queries (query_id, query_vector); a query never finds itself.

    scope: a column of both, to search only blocks of the query's scope. Without it all blocks
    are searched; vectors that are null, zero or not finite take no part, and those of different
    length are never compared.
    """
    if scope is None:
        return _topk_of_all(blocks, queries, k)
    pairs = blocks.join(queries, scope).where(F.col("block_id") != F.col("query_id"))
    scored = pairs.withColumn("vector_score", similarity(F.col("embedding"), F.col("query_vector")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("vector_score"), "block_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def cover_density(hits: Column, n: Column) -> Column:
    """Sum of 0.1 / (1 + other words) over the shortest stretches with all of n terms, at most 1; null without any.

    hits: sorted numbers place * n + term, terms from 0.
    """
    start = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(-1).alias("p"), F.lit(0.0).alias("total"))

    def step(state: Column, hit: Column) -> Column:
        # The last place of each term; the stretch from the least of them to here is a cover, and a
        # new one where that least place moves.
        q = F.floor(hit / n).cast("int")
        last = F.transform(state["last"], lambda at, i: F.when(i == hit % n, q).otherwise(at))
        p = F.array_min(last)
        more = F.when((p >= 0) & (p != state["p"]), F.lit(0.1) / (q - p + 2 - n)).otherwise(0.0)
        return F.struct(last.alias("last"), p.alias("p"), (state["total"] + more).alias("total"))

    return F.aggregate(hits, start, step, lambda state: F.when(state["p"] >= 0, F.least(F.lit(1.0), state["total"])))


def keyword_matches(blocks: DataFrame, terms: list[str], text: str = "text", normal=lambda c: c) -> DataFrame:
    """keyword_score of every block that has all terms: cover density, at most 1.

    Each shortest stretch of text that holds all terms counts 0.1 / (1 + other words in it). A
    block's places of terms are folded within its row, so nothing is shuffled. normal maps a
    token column to what is compared (a stemmer, say); terms must be mapped already.
    """
    wanted = list(dict.fromkeys(terms))
    if not wanted:
        return blocks.limit(0).withColumn("keyword_score", F.lit(0.0))
    n = len(wanted)

    def place(token: Column, i: Column) -> Column:
        # One number for place and term; null for any other word.
        t, found = normal(token), F
        for at, term in enumerate(wanted):
            found = found.when(t == term, i * n + at)
        return found

    score = cover_density(F.array_compact(F.transform(tokens(F.col(text)), place)), F.lit(n))
    # As a generator the score is computed once; as a filter's condition it would be twice.
    return blocks.select("*", F.explode(F.array_compact(F.array(score))).alias("keyword_score"))


def keyword_topk(blocks: DataFrame, terms: list[str], k: int, text: str = "text", key: str = "block_id", name: str = "document_name", normal=lambda c: c) -> DataFrame:
    """The k best keyword matches with sparse_rank: by score, document name, key."""
    return keyword_topk_of(keyword_matches(blocks, terms, text, normal), k, key, name)


def keyword_topk_of(scored: DataFrame, k: int, key: str = "block_id", name: str = "document_name") -> DataFrame:
    """The k best of rows that have their keyword_score."""
    order = (F.desc("keyword_score"), F.asc_nulls_last(name), F.asc(key))
    top = scored.orderBy(*order).limit(k)
    return top.withColumn("sparse_rank", F.row_number().over(Window.orderBy(*order)))


def _merged(dense: DataFrame, sparse: DataFrame, key: str, shared: list[str]) -> DataFrame:
    """Full outer join of two lanes; attributes come from the dense lane first."""
    d = dense.select(key, "vector_score", "dense_rank", *[F.col(c).alias(f"_d_{c}") for c in shared])
    s = sparse.select(key, "keyword_score", "sparse_rank", *[F.col(c).alias(f"_s_{c}") for c in shared])
    both = d.join(s, key, "full_outer")
    sources = F.array_compact(F.array(F.when(F.col("sparse_rank").isNotNull(), "keyword"), F.when(F.col("dense_rank").isNotNull(), "vector")))
    return both.select(key, "vector_score", "keyword_score", "dense_rank", "sparse_rank", sources.alias("match_sources"), *[F.coalesce(f"_d_{c}", f"_s_{c}").alias(c) for c in shared])


def fuse_weighted(dense: DataFrame, sparse: DataFrame, k: int, key: str = "block_id", shared: list[str] | None = None, vector_weight: float = VECTOR_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT) -> DataFrame:
    """Weighted sum of the lanes' scores (a missing lane counts 0), best k."""
    total = vector_weight + keyword_weight
    wv, wk = (vector_weight / total, keyword_weight / total) if total > 0 else (VECTOR_WEIGHT, KEYWORD_WEIGHT)
    v, w = F.coalesce("vector_score", F.lit(0.0)), F.coalesce("keyword_score", F.lit(0.0))
    fused = _merged(dense, sparse, key, shared or []).withColumns({"vector_score": v, "keyword_score": w}).withColumn("score", clamp01(wv * v + wk * w))
    return fused.orderBy(F.desc("score"), F.desc("vector_score"), F.desc("keyword_score"), key).limit(k)


def fuse_rrf(dense: DataFrame, sparse: DataFrame, n: int = FUSION_N, key: str = "block_id", shared: list[str] | None = None, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (constant + rank) over the lanes, best n."""
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    fused = _merged(dense, sparse, key, shared or []).withColumn("rrf_score", part("dense_rank") + part("sparse_rank"))
    return fused.orderBy(F.desc("rrf_score"), F.desc_nulls_last("vector_score"), F.desc_nulls_last("keyword_score"), key).limit(n)


def apply_limits(rows: DataFrame, order: list[Column], limits: Limits, document: str = "document_id", unit: str | None = None) -> DataFrame:
    """The greedy diversity limit, as two passes of row numbers.

    A unit belongs to one document, so cutting each unit first and each document next keeps what
    the greedy walk keeps. Rows without document are not limited; rows without unit only by document.
    """
    blank = F.coalesce(F.trim(F.col(document)) == "", F.lit(True))
    out = rows
    if limits.per_unit and unit:
        n = F.row_number().over(Window.partitionBy(document, unit).orderBy(*order))
        out = out.withColumn("_n", n).where(blank | F.coalesce(F.trim(F.col(unit)) == "", F.lit(True)) | (F.col("_n") <= limits.per_unit)).drop("_n")
    if limits.per_document:
        n = F.row_number().over(Window.partitionBy(document).orderBy(*order))
        out = out.withColumn("_n", n).where(blank | (F.col("_n") <= limits.per_document)).drop("_n")
    return out.orderBy(*order).limit(limits.target_k)


def source_unit(*fields: Column) -> Column:
    """First of page, page number, page index, slide, slide number and anchor that says something; 0 does not."""
    said = [F.when((F.trim(f.cast("string")) != "") & (f.cast("string") != "0"), F.trim(f.cast("string"))) for f in fields]
    return F.coalesce(*said, F.lit(None).cast("string"))


def rerank(rows: DataFrame, k: int, scorer=None, key: str = "block_id") -> DataFrame:
    """Order by a pair scorer (a Column function of the row), then rrf_score; without one the order stays."""
    score = scorer() if scorer else F.coalesce("rrf_score", F.lit(0.0))
    return rows.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), F.desc("rrf_score"), key).limit(k)


def keyword_fallback(sparse: DataFrame, k: int, key: str = "block_id", name: str = "document_name") -> DataFrame:
    """What is returned when no query vector can be had: the keyword lane alone."""
    return sparse.withColumns({"vector_score": F.lit(0.0), "score": F.col("keyword_score")}).orderBy(F.desc("keyword_score"), F.asc_nulls_last(name), key).limit(k)


def candidate_counts(blocks: DataFrame, filtered: Column, include_filtered: bool) -> DataFrame:
    """Total, included, excluded and visible candidates."""
    n = blocks.agg(F.count("*").alias("total_candidate_count"), F.count_if(~filtered).alias("included_candidate_count"))
    n = n.withColumn("excluded_candidate_count", F.greatest(F.lit(0), F.col("total_candidate_count") - F.col("included_candidate_count")))
    return n.withColumn("visible_candidate_count", F.col("total_candidate_count" if include_filtered else "included_candidate_count"))
