"""All user turns of the conversations answered in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import answers, postings
from corvane.operators import retrieval as R
from corvane.plans.registry import query, table
from corvane.plans.retrieval import _BROAD_SQL, _SCOPE_TEXT, _SIM, _roles, _ROLE_SQL, _sections, blocks
from corvane.shared import written

#: A turn is long: its keyword query is the words that stand in the most documents.
WIDEST = 3
K = 5


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as queries; the vector that their embedder would give is that of a stored block, if there is one."""
    own = F.col("conv_id") * 5 + F.col("turn")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("conv_id").alias("conversation_id"), F.col("text").alias("query"), F.when(F.col("turn") % 4 != 2, own).alias("vec_id"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("query_vector"))
    return turns.join(vectors, "vec_id", "left").drop("vec_id")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a conversation: none to three sources."""
    conv = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id")).distinct()
    numbers = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: i < F.col("conversation_id") % 4)
    return conv.select("conversation_id", F.explode(F.transform(numbers, lambda i: F.concat(F.lit("src"), ((F.col("conversation_id") + i * 3) % 20).cast("string")))).alias("document_id"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("document_id")).where("document_id IS NOT NULL").distinct().withColumn("is_deleted", F.col("document_id") == "src7")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("block_id")
    kind = F.when(d % 4 == 0, "table").when(d % 4 == 1, "diagram").otherwise("text")
    return blocks(spark, sf_dir).select("*", kind.alias("block_type"), F.when(d % 2 == 0, "figure").otherwise("").alias("subtype"), _roles(d).alias("role"), _sections(d).alias("section_path"))


def _terms(turns: DataFrame, index: DataFrame) -> DataFrame:
    words = turns.select("query_id", F.explode(R.tokens(F.col("query"))).alias("term"))
    return postings.widest(words, index, WIDEST)


_BASE = rf"""
toks AS (SELECT doc_id AS block_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM documents),
places AS (SELECT block_id, i - 1 AS pos, t[i] AS term FROM (SELECT block_id, t, unnest(range(1, len(t) + 1)) AS i FROM toks)),
df AS (SELECT term, count(DISTINCT block_id) AS n FROM places GROUP BY 1),
turns AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, turn, text FROM conversations WHERE role = 'user'),
words AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM turns),
terms AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS nth FROM words JOIN df USING (term) QUALIFY nth <= {WIDEST}),
sizes AS (SELECT query_id, count(*) AS n FROM terms GROUP BY 1),
hits AS (SELECT query_id, n, block_id, pos, nth FROM terms JOIN places USING (term) JOIN sizes USING (query_id)),
marked AS (
  SELECT query_id, n, block_id, pos AS q, max(pos) FILTER (nth = 1) OVER w AS a, max(pos) FILTER (nth = 2) OVER w AS b, max(pos) FILTER (nth = 3) OVER w AS c
  FROM hits WINDOW w AS (PARTITION BY query_id, block_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), covers AS (
  SELECT query_id, n, block_id, least(a, coalesce(b, a), coalesce(c, a)) AS p, min(q) AS q FROM marked
  WHERE a IS NOT NULL AND (n < 2 OR b IS NOT NULL) AND (n < 3 OR c IS NOT NULL) GROUP BY ALL
), matched AS (
  SELECT query_id, block_id, round(least(1.0::DOUBLE, sum(0.1::DOUBLE / (q - p + 2 - n))), 9) AS keyword_score FROM covers GROUP BY 1, 2
)"""


@query("keyword_index", r"""
SELECT term, count(*) AS blocks, sum(len(positions))::BIGINT AS places, sum(list_sum(positions))::BIGINT AS position_sum FROM (
  SELECT block_id, term, list(pos) AS positions FROM (SELECT doc_id AS block_id, t[i] AS term, i - 1 AS pos FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents))) GROUP BY 1, 2
) GROUP BY 1""")
def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the positional index of all documents holds of each term."""
    index = postings.build(table(spark, sf_dir, "documents"), key="doc_id")
    return index.groupBy("term").agg(F.count("*").alias("blocks"), F.sum(F.size("positions")).alias("places"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)).alias("position_sum"))


@query("keyword_topk_of_turns", f"""WITH {_BASE}
SELECT query_id, block_id, keyword_score, (row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, source || '.txt' NULLS LAST, block_id))::INTEGER AS sparse_rank
FROM matched JOIN documents ON doc_id = block_id QUALIFY sparse_rank <= {R.SPARSE_N}""")
def keyword_topk_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best keyword matches of every user turn, from one index."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), F.concat("source", F.lit(".txt")).alias("document_name"), "text")
    index = written(postings.build(texts))
    return postings.best(index, _terms(_turns(spark, sf_dir), index), texts.drop("text"), [F.asc_nulls_last("document_name"), F.asc("block_id")], R.SPARSE_N)


_REASON = f"CASE WHEN {_ROLE_SQL} = 'note' THEN 'reference_note' WHEN doc_id % 13 = 0 THEN 'abstract' WHEN doc_id % 17 = 0 THEN 'works_cited' ELSE '' END"
_ANSWERS = f"""WITH {_BASE},
reasoned AS (SELECT doc_id AS block_id, source AS document_id, source || '.txt' AS document_name, (doc_id % 10)::VARCHAR AS unit, {_REASON} AS reason, embedding::DOUBLE[] AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE trim(text, E' \\t\\n\\r') <> ''),
shown AS (SELECT * FROM reasoned WHERE reason = ''),
links AS (SELECT DISTINCT conv_id, 'src' || ((conv_id + i * 3) % 20)::VARCHAR AS document_id FROM conversations, (SELECT unnest([0, 1, 2]) AS i) WHERE i < conv_id % 4),
scope AS (SELECT query_id, document_id FROM turns JOIN links USING (conv_id) WHERE document_id <> 'src7' AND document_id IN (SELECT source FROM documents)),
asked AS (
  SELECT query_id, t AS query, {_BROAD_SQL} AS scope_kind, coalesce(d, 0) AS documents, turn % 4 <> 2 AND e.vec_id IS NOT NULL AS has_vector, e.embedding::DOUBLE[] AS qv
  FROM (SELECT *, lower(trim(regexp_replace({_SCOPE_TEXT}, '[?.]$', ''))) AS t FROM turns) LEFT JOIN (SELECT query_id, count(*) AS d FROM scope GROUP BY 1) USING (query_id) LEFT JOIN embeddings e ON e.vec_id = conv_id * 5 + turn
), limits AS (
  SELECT query_id, documents, has_vector, qv, query, scope_kind, CASE WHEN documents = 0 THEN {K} WHEN documents = 1 THEN CASE scope_kind WHEN 'broad' THEN 14 ELSE 10 END ELSE greatest({K}, documents * CASE scope_kind WHEN 'broad' THEN 6 ELSE 5 END) END AS target_k,
    CASE WHEN documents = 1 THEN CASE scope_kind WHEN 'broad' THEN 14 ELSE 10 END ELSE CASE scope_kind WHEN 'broad' THEN 6 ELSE 5 END END AS per_document, CASE WHEN scope_kind = 'broad' THEN 2 ELSE 1000000 END AS per_unit
  FROM asked
), sparse AS (
  SELECT query_id, block_id, keyword_score, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, document_name NULLS LAST, block_id) AS sparse_rank
  FROM matched JOIN shown USING (block_id) JOIN scope USING (query_id, document_id) QUALIFY sparse_rank <= {R.SPARSE_N}
), dense AS (
  SELECT query_id, block_id, {_SIM.format(a='v', b='qv')} AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY {_SIM.format(a='v', b='qv')} DESC, block_id) AS dense_rank
  FROM limits JOIN scope USING (query_id) JOIN shown USING (document_id) WHERE has_vector AND v IS NOT NULL QUALIFY dense_rank <= {R.DENSE_N}
), fused AS (
  SELECT query_id, block_id, vector_score, keyword_score, dense_rank, sparse_rank, coalesce(1.0::DOUBLE / (60 + dense_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0.0) AS rrf_score
  FROM dense FULL JOIN sparse USING (query_id, block_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, vector_score DESC NULLS LAST, keyword_score DESC NULLS LAST, block_id) <= {R.FUSION_N}
), by_unit AS (
  SELECT f.*, document_id, unit, l.target_k, l.per_document, l.per_unit, row_number() OVER (PARTITION BY query_id, document_id, unit ORDER BY rrf_score DESC, vector_score DESC NULLS LAST, keyword_score DESC NULLS LAST, block_id) AS nu
  FROM fused f JOIN shown USING (block_id) JOIN limits l USING (query_id) WHERE query <> ''
), by_doc AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rrf_score DESC, vector_score DESC NULLS LAST, keyword_score DESC NULLS LAST, block_id) AS nd FROM by_unit WHERE nu <= per_unit
), results AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, vector_score DESC NULLS LAST, keyword_score DESC NULLS LAST, block_id))::INTEGER AS rank FROM by_doc WHERE nd <= per_document QUALIFY rank <= target_k
)"""


def _answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = _turns(spark, sf_dir)
    held = _blocks(spark, sf_dir)
    index = written(postings.build(held))
    return answers.retrieve(turns, _links(spark, sf_dir), _documents(spark, sf_dir), held, index, _terms(turns, index), K)


@query("retrieval_of_turns", _ANSWERS + " SELECT query_id, rank, block_id, document_id, round(rrf_score, 9) AS rrf_score, round(vector_score, 6) AS vector_score, keyword_score, dense_rank::INTEGER AS dense_rank, sparse_rank::INTEGER AS sparse_rank FROM results")
def retrieval_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn answered inside its conversation's documents: both lanes, fusion, limits."""
    _, results = _answered(spark, sf_dir)
    return results.select("query_id", "rank", "block_id", "document_id", F.round("rrf_score", 9).alias("rrf_score"), F.round("vector_score", 6).alias("vector_score"), "keyword_score", "dense_rank", "sparse_rank")


@query("payloads_of_turns", _ANSWERS + f""",
counts AS (SELECT query_id, count(*) AS total, count(*) FILTER (reason = '') AS included FROM scope JOIN reasoned USING (document_id) GROUP BY 1),
got AS (SELECT query_id, count(*) AS returned, count(DISTINCT document_id) AS docs, count(DISTINCT (document_id, unit)) AS units, list(block_id ORDER BY rank) AS ids FROM results GROUP BY 1)
SELECT l.query_id, CASE WHEN query = '' THEN 'empty_query' WHEN documents = 0 THEN 'empty_scope' WHEN has_vector THEN 'rrf' ELSE 'keyword_fallback' END AS strategy, target_k::INTEGER AS k, coalesce(returned, 0)::INTEGER AS returned_count,
  coalesce(total, 0)::BIGINT AS total, coalesce(total - included, 0)::BIGINT AS excluded, coalesce(docs, 0)::BIGINT AS documents_covered, coalesce(units, 0)::BIGINT AS units_covered, coalesce(ids, []::BIGINT[]) AS ids
FROM limits l LEFT JOIN counts USING (query_id) LEFT JOIN got USING (query_id)""")
def payloads_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload of each turn, with what can be compared taken out of its JSON again."""
    asked, results = _answered(spark, sf_dir)
    made = answers.payloads(asked, results, K)
    at = lambda path, kind: F.get_json_object("payload", path).cast(kind)
    ids = F.transform(F.from_json(F.get_json_object("payload", "$.results"), "array<struct<block_id: long>>"), lambda r: r["block_id"])
    return made.select("query_id", at("$.strategy", "string").alias("strategy"), at("$.k", "int").alias("k"), at("$.returned_count", "int").alias("returned_count"), at("$.filter_summary.total_candidate_count", "long").alias("total"), at("$.filter_summary.excluded_candidate_count", "long").alias("excluded"), at("$.candidate_summary.documents_covered", "long").alias("documents_covered"), at("$.candidate_summary.source_units_covered", "long").alias("units_covered"), ids.alias("ids"))
