"""Retrieval queries over documents as blocks, embeddings as their vectors and sources as their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import scopes
from corvane.functions.vectors import pad, similarity, valid
from corvane.operators import ivf
from corvane.operators import retrieval as R
from corvane.operators.stem import stem_tokens
from corvane.plans.registry import query, table

#: The query: the vector of one stored block, and two words.
QUERY_ID, TERMS, K = 0, ["the", "of"], 5

#: DuckDB: cosine in double precision, vectors as double lists.
_COS = "list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
_SIM = "least(1.0, greatest(0.0, (" + _COS + " + 1.0) / 2.0))"
_Q = f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {QUERY_ID})"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block is a document; its document is its source; a unit is a tenth of the ids."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), F.col("source").alias("document_id"), F.concat(F.col("source"), F.lit(".txt")).alias("document_name"), (F.col("doc_id") % 10).cast("string").alias("unit"), "text", "lang")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their vectors, null where there is none."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block_id"), "embedding")
    return _texts(spark, sf_dir).join(vectors, "block_id", "left")


_BLOCKS = """
blocks AS (
  SELECT d.doc_id AS block_id, d.source AS document_id, d.source || '.txt' AS document_name, (d.doc_id % 10)::VARCHAR AS unit, d.text, d.lang, e.embedding::DOUBLE[] AS v
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
)"""


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector that a query's embedder would give: a parameter of the plan, not a join."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_ID).select("embedding").first()[0]]


@query("dense_topk", f"""
SELECT vec_id AS block_id, label, round({_SIM.format(a='v', b='q')}, 6) AS vector_score, (row_number() OVER (ORDER BY {_SIM.format(a='v', b='q')} DESC, vec_id))::INTEGER AS dense_rank
FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v, {_Q} AS q FROM embeddings) ORDER BY {_SIM.format(a='v', b='q')} DESC, vec_id LIMIT 10""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "block_id")
    return R.dense_topk(vectors, query_vector(spark, sf_dir), 10).select("block_id", "label", F.round("vector_score", 6).alias("vector_score"), "dense_rank")


@query("dense_topk_scoped", f"""
SELECT vec_id AS block_id, label, round({_SIM.format(a='v', b='q')}, 6) AS vector_score
FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v, {_Q} AS q FROM embeddings WHERE label IN (1, 3, 5)) ORDER BY {_SIM.format(a='v', b='q')} DESC, vec_id LIMIT 10""")
def dense_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 3, 5)).withColumnRenamed("vec_id", "block_id")
    return R.dense_topk(vectors, query_vector(spark, sf_dir), 10).select("block_id", "label", F.round("vector_score", 6).alias("vector_score"))


@query("dense_topk_index_score", f"""
SELECT vec_id AS block_id, round(least(1.0, greatest(0.0, {_COS.format(a='v', b='q')})), 6) AS vector_score
FROM (SELECT vec_id, embedding::DOUBLE[] AS v, {_Q} AS q FROM embeddings) ORDER BY least(1.0, greatest(0.0, {_COS.format(a='v', b='q')})) DESC, vec_id LIMIT 10""")
def dense_topk_index_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "block_id")
    return R.dense_topk(vectors, query_vector(spark, sf_dir), 10, clamp_only=True).select("block_id", F.round("vector_score", 6).alias("vector_score"))


@query("dense_topk_per_query", f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
scored AS (SELECT q.vec_id AS query_id, b.vec_id AS block_id, {_SIM.format(a='b.v', b='q.v')} AS s FROM e b JOIN e q ON q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, block_id))::INTEGER AS rank FROM scored)
SELECT query_id, block_id, rank, round(s, 6) AS vector_score FROM ranked WHERE rank <= 5""")
def dense_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all rows for each row whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "block_id")
    asked = vectors.where(F.col("block_id") % 20 == 0).select(F.col("block_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return R.dense_topk_per_query(vectors, asked, 5).select("query_id", "block_id", "rank", F.round("vector_score", 6).alias("vector_score"))


# Keyword lane: covers of the two words, found by the last position of each word at every hit.
_KEYWORD = """
toks AS (
  SELECT block_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM blocks
), hits AS (
  SELECT block_id, i - 1 AS pos, t[i] AS term FROM (SELECT block_id, t, unnest(range(1, len(t) + 1)) AS i FROM toks WHERE list_has_all(t, ['the', 'of'])) WHERE t[i] IN ('the', 'of')
), marked AS (
  SELECT block_id, pos AS q, max(CASE WHEN term = 'the' THEN pos END) OVER w AS a, max(CASE WHEN term = 'of' THEN pos END) OVER w AS b
  FROM hits WINDOW w AS (PARTITION BY block_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), covers AS (
  SELECT block_id, least(a, b) AS p, min(q) AS q FROM marked WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2
), keyword AS (
  SELECT block_id, least(1.0::DOUBLE, sum(0.1::DOUBLE / (1 + q - p + 1 - 2))) AS keyword_score FROM covers GROUP BY 1
), sparse AS (
  SELECT block_id, keyword_score, (row_number() OVER (ORDER BY round(keyword_score, 9) DESC, document_name, block_id))::INTEGER AS sparse_rank, document_id, document_name, unit
  FROM keyword JOIN blocks USING (block_id) QUALIFY sparse_rank <= __N__
)"""


def _sparse(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    # Sums of fractions are rounded before they are ranked: their last bits hang on the order of addition.
    scored = R.keyword_matches(_texts(spark, sf_dir), TERMS).withColumn("keyword_score", F.round("keyword_score", 9))
    return R.keyword_topk_of(scored, n)


@query("keyword_cover_density", f"WITH {_BLOCKS}, {_KEYWORD.replace('__N__', str(50))} SELECT block_id, document_name, round(keyword_score, 9) AS keyword_score, sparse_rank FROM sparse")
def keyword_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir, R.SPARSE_N).select("block_id", "document_name", "keyword_score", "sparse_rank")


@query("keyword_and_match", r"""
SELECT doc_id AS block_id, len(list_filter(t, lambda x: x IN ('the', 'of')))::INTEGER AS n_hits
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents) WHERE list_has_all(t, ['the', 'of'])""")
def keyword_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R.tokens(F.col("text"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), own.alias("t"))
    hit = docs.where(F.array_contains("t", "the") & F.array_contains("t", "of"))
    return hit.select("block_id", F.size(F.filter("t", lambda x: x.isin(TERMS))).alias("n_hits"))


@query("keyword_stemmed")
def keyword_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stemmed lane: tokens and terms reduced by rule, stop words dropped."""
    stemmed = stem_tokens(_texts(spark, sf_dir).select("block_id", "document_name", "text"), "text", "stems")
    return R.keyword_topk(stemmed.withColumn("text", F.array_join("stems", " ")), ["thing", "stat"], R.SPARSE_N).select("block_id", "keyword_score", "sparse_rank")


_DENSE = f"""
dense AS (
  SELECT block_id, {_SIM.format(a='v', b='q')} AS vector_score, (row_number() OVER (ORDER BY {_SIM.format(a='v', b='q')} DESC, block_id))::INTEGER AS dense_rank, document_id, document_name, unit
  FROM (SELECT *, {_Q} AS q FROM blocks WHERE v IS NOT NULL) QUALIFY dense_rank <= {{n}}
)"""
_MERGED = """
merged AS (
  SELECT coalesce(d.block_id, s.block_id) AS block_id, coalesce(d.document_id, s.document_id) AS document_id, coalesce(d.unit, s.unit) AS unit,
    d.vector_score, round(s.keyword_score, 9) AS keyword_score, d.dense_rank, s.sparse_rank,
    [x FOR x IN [CASE WHEN s.block_id IS NOT NULL THEN 'keyword' END, CASE WHEN d.block_id IS NOT NULL THEN 'vector' END] IF x IS NOT NULL] AS match_sources
  FROM dense d FULL OUTER JOIN sparse s ON d.block_id = s.block_id
)"""
_SHARED = ["document_id", "document_name", "unit"]


def _fused(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    pool = R.pool_size(k)
    dense = R.dense_topk(blocks(spark, sf_dir), query_vector(spark, sf_dir), pool)
    return R.fuse_weighted(dense, _sparse(spark, sf_dir, pool), k, shared=_SHARED)


_HYBRID_ORDER = "score DESC, vector_score DESC, keyword_score DESC, block_id"
_HYBRID = f"""
WITH {_BLOCKS}, {_KEYWORD.replace('__N__', str(R.pool_size(K)))}, {_DENSE.format(n=R.pool_size(K))}, {_MERGED},
scored AS (
  SELECT block_id, document_id, unit, match_sources, coalesce(vector_score, 0.0) AS vector_score, coalesce(keyword_score, 0.0) AS keyword_score,
    least(1.0, greatest(0.0, 0.7::DOUBLE * coalesce(vector_score, 0.0) + 0.3::DOUBLE * coalesce(keyword_score, 0.0))) AS score
  FROM merged
), cut AS (SELECT * FROM scored ORDER BY {_HYBRID_ORDER} LIMIT __K__)"""


@query("retrieval_hybrid", _HYBRID.replace('__K__', '10') + f""",
by_unit AS (SELECT *, row_number() OVER (PARTITION BY document_id, unit ORDER BY {_HYBRID_ORDER}) AS nu FROM cut),
by_doc AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY {_HYBRID_ORDER}) AS nd FROM by_unit WHERE nu <= 2)
SELECT block_id, document_id, round(score, 6) AS score, round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score, match_sources
FROM by_doc WHERE nd <= 6 ORDER BY {_HYBRID_ORDER.replace('score', 'by_doc.score', 1)} LIMIT 10""")
def retrieval_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool of k each, weighted fusion cut to k, then the diversity limits of a broad query over several documents."""
    order = [F.desc("score"), F.desc("vector_score"), F.desc("keyword_score"), F.asc("block_id")]
    pool = R.pool_size(K)
    dense = R.dense_topk(blocks(spark, sf_dir), query_vector(spark, sf_dir), pool)
    fused = R.fuse_weighted(dense, _sparse(spark, sf_dir, pool), 10, shared=_SHARED)
    out = R.apply_limits(fused, order, R.Limits(10, R.PER_DOC_BROAD_K, R.UNIT_LIMIT), unit="unit")
    return out.select("block_id", "document_id", *[F.round(c, 6).alias(c) for c in ("score", "vector_score", "keyword_score")], "match_sources")


@query("fusion_weighted", _HYBRID.replace('__K__', str(K)) + " SELECT block_id, round(score, 6) AS score, match_sources FROM cut")
def fusion_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, K).select("block_id", F.round("score", 6).alias("score"), "match_sources")


_RRF_ORDER = "rrf_score DESC, vector_score DESC NULLS LAST, keyword_score DESC NULLS LAST, block_id"
_RRF = f"""
WITH {_BLOCKS}, {_KEYWORD.replace('__N__', str(50))}, {_DENSE.format(n=50)}, {_MERGED},
fused AS (SELECT *, coalesce(1.0::DOUBLE / (60 + dense_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0.0) AS rrf_score FROM merged ORDER BY {_RRF_ORDER} LIMIT 100)"""


def _rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = R.dense_topk(blocks(spark, sf_dir), query_vector(spark, sf_dir), R.DENSE_N)
    return R.fuse_rrf(dense, _sparse(spark, sf_dir, R.SPARSE_N), shared=_SHARED)


@query("fusion_rrf", _RRF + " SELECT block_id, dense_rank, sparse_rank, round(rrf_score, 9) AS rrf_score FROM fused")
def fusion_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rrf(spark, sf_dir).select("block_id", "dense_rank", "sparse_rank", F.round("rrf_score", 9).alias("rrf_score"))


@query("retrieval_rrf_rerank", _RRF + f""",
ranked AS (SELECT *, rrf_score AS rerank_score FROM fused ORDER BY rrf_score DESC, block_id LIMIT 100),
by_doc AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rrf_score DESC, block_id) AS nd FROM ranked)
SELECT block_id, document_id, round(rerank_score, 9) AS rerank_score FROM by_doc WHERE nd <= 5 ORDER BY by_doc.rerank_score DESC, block_id LIMIT 20""")
def retrieval_rrf_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion, rerank (disabled: the order stays), then the per-document limit."""
    ranked = R.rerank(_rrf(spark, sf_dir), 100)
    out = R.apply_limits(ranked, [F.desc("rerank_score"), F.asc("block_id")], R.Limits(20, R.PER_DOC_K, None))
    return out.select("block_id", "document_id", F.round("rerank_score", 9).alias("rerank_score"))


@query("keyword_fallback", f"WITH {_BLOCKS}, {_KEYWORD.replace('__N__', str(15))} SELECT block_id, round(keyword_score, 9) AS score, 0.0::DOUBLE AS vector_score FROM sparse ORDER BY round(keyword_score, 9) DESC, document_name, block_id LIMIT {K}")
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_fallback(_sparse(spark, sf_dir, R.pool_size(K)), K).select("block_id", "score", "vector_score")


@query("diversity_limit", f"""
WITH e AS (SELECT vec_id, label, (vec_id % 7)::VARCHAR AS unit, {_SIM.format(a='embedding::DOUBLE[]', b=_Q)} AS s FROM embeddings),
u AS (SELECT *, row_number() OVER (PARTITION BY label, unit ORDER BY s DESC, vec_id) AS nu FROM e),
d AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS nd FROM u WHERE nu <= 2)
SELECT vec_id AS block_id, label AS document_id, unit FROM d WHERE nd <= 6 ORDER BY s DESC, vec_id LIMIT 40""")
def diversity_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*map(F.lit, query_vector(spark, sf_dir)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block_id"), F.col("label").alias("document_id"), (F.col("vec_id") % 7).cast("string").alias("unit"), similarity(F.col("embedding"), q).alias("s"))
    return R.apply_limits(rows.withColumn("d", F.col("document_id").cast("string")), [F.desc("s"), F.asc("block_id")], R.Limits(40, 6, 2), document="d", unit="unit").select("block_id", "document_id", "unit")


def _roles(d: Column) -> Column:
    return F.when(d % 11 == 0, "note").when(d % 7 == 0, "heading").when(d % 5 == 0, "caption").otherwise("paragraph")


def _sections(d: Column) -> Column:
    return F.when(d % 13 == 0, F.array(F.lit("Abstract"), F.lit("1 Intro"))).when(d % 17 == 0, F.array(F.lit("Body"), F.lit(" Works Cited 2"))).when(d % 3 == 0, F.array(F.lit("Methods"))).otherwise(F.array().cast("array<string>"))


_ROLE_SQL = "CASE WHEN doc_id % 11 = 0 THEN 'note' WHEN doc_id % 7 = 0 THEN 'heading' WHEN doc_id % 5 = 0 THEN 'caption' ELSE 'paragraph' END"
_REASON_SQL = f"CASE WHEN {_ROLE_SQL} = 'note' THEN 'reference_note' WHEN doc_id % 13 = 0 THEN 'abstract' WHEN doc_id % 17 = 0 THEN 'works_cited' ELSE '' END"


@query("filter_and_relevance", f"""
SELECT doc_id, role, reason, CASE WHEN reason = 'reference_note' THEN 'filtered reference note' WHEN reason <> '' THEN 'filtered ' || replace(reason, '_', ' ')
  WHEN doc_id % 4 = 0 THEN 'matched table context' WHEN doc_id % 4 = 1 THEN 'matched diagram caption or nearby context' WHEN role = 'caption' THEN 'matched caption text'
  WHEN role = 'heading' THEN 'matched section heading' WHEN doc_id % 3 = 0 THEN 'matched body paragraph within section' WHEN doc_id % 2 = 0 THEN 'matched figure' ELSE 'matched body paragraph' END AS relevance
FROM (SELECT doc_id, {_ROLE_SQL} AS role, {_REASON_SQL} AS reason FROM documents)""")
def filter_and_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", _roles(d).alias("role"), _sections(d).alias("sections"))
    rows = rows.withColumn("reason", scopes.filter_reason(F.col("role"), F.col("sections")))
    kind = F.when(d % 4 == 0, "table").when(d % 4 == 1, "diagram").otherwise("text")
    return rows.select("doc_id", "role", "reason", scopes.relevance_reason(kind, F.when(d % 2 == 0, "figure").otherwise(""), F.col("role"), F.col("sections"), F.col("reason")).alias("relevance"))


@query("candidate_counts", f"""
SELECT count(*) AS total_candidate_count, count(*) FILTER (WHERE reason = '') AS included_candidate_count,
  greatest(0, count(*) - count(*) FILTER (WHERE reason = '')) AS excluded_candidate_count, count(*) FILTER (WHERE reason = '') AS visible_candidate_count
FROM (SELECT {_REASON_SQL} AS reason FROM documents JOIN embeddings ON vec_id = doc_id WHERE trim(text) <> '')""")
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("block_id")
    rows = blocks(spark, sf_dir).where(scopes.non_blank(F.col("text")) & F.col("embedding").isNotNull())
    return R.candidate_counts(rows, scopes.filter_reason(_roles(d), _sections(d)) != "", include_filtered=False)


@query("coverage_counts", f"""
WITH {_BLOCKS}, {_DENSE.format(n=50)}
SELECT count(DISTINCT document_id) AS documents_covered, count(DISTINCT (document_id, unit)) AS units_covered FROM dense""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.dense_topk(blocks(spark, sf_dir), query_vector(spark, sf_dir), 50)
    return top.agg(F.count_distinct("document_id").alias("documents_covered"), F.count_distinct(F.struct("document_id", "unit")).alias("units_covered"))


_SCOPE_TEXT = r"trim(regexp_replace(coalesce(text, ''), '[\s\v]+', ' ', 'g'))"


_BROAD_SQL = f"""CASE WHEN t = '' THEN 'narrow' WHEN len(t) - len(replace(t, '?', '')) > 1 THEN 'broad'
  WHEN {' OR '.join(f"starts_with(t, '{m}')" for m in scopes.FOLLOW_UPS)} THEN 'broad'
  WHEN {' OR '.join(f"contains(t, '{p}')" for p in scopes.BROAD_PHRASES)} THEN 'broad'
  WHEN len(string_split(t, ' ')) >= 15 THEN 'broad' ELSE 'narrow' END"""


@query("query_scope", f"""
SELECT conv_id, turn, {_BROAD_SQL} AS scope, t AS normalized
FROM (SELECT conv_id, turn, lower(trim(regexp_replace({_SCOPE_TEXT}, '[?.]$', ''))) AS t FROM conversations)""")
def query_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("normalized", F.lower(scopes.normalize_query(F.col("text"))))
    return rows.select("conv_id", "turn", scopes.query_scope(F.col("normalized")).alias("scope"), "normalized")


@query("snippets", r"""
SELECT doc_id, CASE WHEN len(t) <= 900 THEN t ELSE regexp_replace(left(t, 900), '\s+$', '') || '...' END AS snippet
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM documents)""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scopes.snippet(F.col("text")).alias("snippet"))


@query("vector_validation", """
SELECT vec_id, len(embedding) > 0 AND len([x FOR x IN embedding IF NOT isfinite(x)]) = 0 AND len(embedding) = 64 AS valid, 96 AS padded_size, round(list_sum(embedding::DOUBLE[]), 6) AS padded_sum FROM embeddings""")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = pad(F.col("embedding"), 96)
    return table(spark, sf_dir, "embeddings").select("vec_id", valid(F.col("embedding"), 64).alias("valid"), F.size(padded).alias("padded_size"), F.round(F.aggregate(padded.cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("padded_sum"))


@query("source_unit_key", """
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 5)::VARCHAR WHEN doc_id % 3 <> 0 THEN (doc_id % 3)::VARCHAR WHEN source <> '' THEN source END AS unit FROM documents""")
def source_unit_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", R.source_unit(d % 5, d % 3, F.col("source")).alias("unit"))


#: Lists of the vector index, and lists that a query meets: these vectors have next to no clusters, so most are.
LISTS, PROBES = 24, 20


def _vector_index(spark: SparkSession, sf_dir: str) -> tuple[ivf.Index, DataFrame]:
    """The index of all embeddings, filtered by label, and every tenth row as a query for its label's neighbours."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "block_id")
    wanted = F.when(F.col("block_id") % 20 == 0, F.col("label")).cast("string")
    asked = vectors.where(F.col("block_id") % 10 == 0).select(F.col("block_id").alias("query_id"), F.col("embedding").alias("query_vector"), wanted.alias("wanted"))
    return ivf.build(vectors, LISTS, "label"), asked


@query("vector_index_exact", f"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
scored AS (SELECT q.vec_id AS query_id, b.vec_id AS block_id, {_SIM.format(a='b.v', b='q.v')} AS s FROM e b JOIN e q ON q.vec_id % 10 = 0 AND b.vec_id <> q.vec_id AND (q.vec_id % 20 <> 0 OR b.label = q.label)),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, block_id))::INTEGER AS rank FROM scored)
SELECT query_id, block_id, rank, round(s, 6) AS vector_score FROM ranked WHERE rank <= 10""")
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists: what the index holds, half of the queries filtered by label."""
    index, asked = _vector_index(spark, sf_dir)
    return index.search(asked, 10).select("query_id", "block_id", "rank", F.round("vector_score", 6).alias("vector_score"))


@query("vector_index_probed")
def vector_index_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest lists alone; tests hold its recall at 10."""
    index, asked = _vector_index(spark, sf_dir)
    return index.search(asked, 10, PROBES).select("query_id", "block_id", "rank", F.round("vector_score", 6).alias("vector_score"))
