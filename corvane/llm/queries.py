"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import ann, bpe, embdedup, langid, lm, minhash, mixing, packing, repeats, secrets, toxicity, whitening, wordpiece
from corvane.llm._common import materialize, word_count


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digest(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sizes are counted once and written: the sums, the choice at the cut and the rest read them.
    sized = materialize(_read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mixing.mix(sized, F.array("source"), F.col("size"))
    return mixed.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


OP3_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), hashed AS (
  SELECT *, md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size::VARCHAR) AS h, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits FROM sized
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source
), rounds AS (
  SELECT 0 AS r, source, source_size, w, false AS full_, (sum(source_size) OVER ())::DOUBLE / sum(w) OVER () AS level FROM per_source
  UNION ALL
  SELECT r + 1, source, source_size, w, now_full,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (now_full) OVER (), 0))::DOUBLE / nullif(sum(w) FILTER (NOT now_full) OVER (), 0)
  FROM (SELECT *, full_ OR level * w > 3 * source_size AS now_full, bool_or(NOT full_ AND level * w > 3 * source_size) OVER () AS changed FROM rounds)
  WHERE changed
), quota AS (
  SELECT source, source_size, CASE WHEN full_ THEN (3 * source_size)::DOUBLE ELSE level * w END AS target
  FROM rounds WHERE r = (SELECT max(r) FROM rounds)
), plan AS (
  SELECT *, least(3 * source_size, floor(target + 0.5)::BIGINT) AS words FROM quota
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole,
    CASE WHEN source_size > 0 THEN words % source_size ELSE 0 END AS rest,
    CASE WHEN source_size > 0 THEN format('{:03x}', (words % source_size) * 4096 // source_size) ELSE '000' END AS share
  FROM plan
), lengths AS (
  SELECT c.source, b.bits, coalesce(sum(d.size) FILTER (d.bits = b.bits), 0)::BIGINT AS words, coalesce(sum(d.size) FILTER (d.bits = b.bits AND h[1:3] < c.share), 0)::BIGINT AS part,
    coalesce(sum(d.size) FILTER (d.bits < b.bits), 0)::BIGINT AS below
  FROM cut c CROSS JOIN (SELECT unnest(range(63)) AS bits) b JOIN hashed d ON d.source IS NOT DISTINCT FROM c.source
  GROUP BY c.source, b.bits
), walk AS (
  SELECT source, 63::BIGINT AS bits, rest::BIGINT AS left_, 'start' AS way FROM cut
  UNION ALL
  SELECT source, bits, (CASE way WHEN 'share' THEN left_ - part WHEN 'all' THEN greatest(left_ - words, 0) WHEN 'none' THEN least(left_, below) ELSE left_ END)::BIGINT, way
  FROM (
    SELECT w.source, l.bits, w.left_, l.words, l.part, l.below,
      CASE WHEN left_ - part BETWEEN 0 AND below THEN 'share' WHEN left_ <= below THEN 'none' WHEN left_ >= words THEN 'all'
        WHEN left_ - below <= words - left_ AND 4 * (left_ - below) <= 1::BIGINT << l.bits THEN 'none'
        WHEN 4 * (words - left_) <= 1::BIGINT << l.bits THEN 'all' ELSE 'short' END AS way
    FROM walk w JOIN lengths l ON l.source IS NOT DISTINCT FROM w.source AND l.bits = w.bits - 1 WHERE w.way <> 'short'
  )
), short AS (
  SELECT source, coalesce(max(bits) FILTER (way = 'short'), -1) AS short, coalesce(max(left_) FILTER (way = 'short'), 0) AS missing FROM walk GROUP BY source
), placed AS (
  SELECT d.doc_id, d.size, c.source_size, c.target, c.whole, d.bits > s.short AS is_long, w.way = 'all' OR w.way = 'share' AND d.h[1:3] < c.share AS is_taken, s.missing,
    sum(d.size) OVER (PARTITION BY d.source, d.bits > s.short ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before_
  FROM hashed d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source JOIN short s ON d.source IS NOT DISTINCT FROM s.source
    LEFT JOIN walk w ON d.source IS NOT DISTINCT FROM w.source AND w.bits = d.bits
)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN is_long THEN is_taken::INT WHEN missing > 0 AND 2 * before_ + size <= 2 * missing THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), words=4, percent=80)


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS s
  FROM words
), flat AS (
  SELECT doc_id, unnest(s) AS shingle FROM shingled
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN shingled p ON p.doc_id = x JOIN shingled q ON q.doc_id = y
  WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, min(y) AS component_id, doc_id = min(y) AS kept
FROM shingled JOIN reach ON x = doc_id GROUP BY doc_id, s
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.evaluate(_read(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_read(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


_GOOD = "embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0"

OP4_SQL = f"""
WITH good AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {_GOOD}),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 10
"""


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.98)


OP9_SQL = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND {_GOOD}
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.98
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, min(y) AS component_id, vec_id = min(y) AS kept
FROM embeddings JOIN reach ON x = vec_id GROUP BY vec_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return wordpiece.count_tokens(_read(spark, sf_dir, "documents"), wordpiece.Automaton(*wordpiece.vocabulary(ranks)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    chain = toxicity.train(docs, _read(spark, sf_dir, "labels"), toxicity.default_categories())
    return toxicity.classify(docs, chain, keep=["doc_id"]).select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(_read(spark, sf_dir, "embeddings"), components=16, scale=64, shift=1_000_000)
    # The contract's long; null where the exact number has no room in one.
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words: one document in ten repeats a period from some word on; none without id."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.periodic_runs(_read(spark, sf_dir, "documents"), shortest=24, times=3, rewrite=planted)
    # The greatest exact quotient of two longs: compared by products, which fit a decimal.
    product = lambda a, b: a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    better = lambda a, b: F.coalesce(product(b["length"], a["period"]) > product(a["length"], b["period"]), F.lit(True))
    # Runs come by start and period, so the first of equals stays.
    top = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, b: F.when(better(a, b), b).otherwise(a))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    wide = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return wide.select("doc_id", "n_runs", "top.*", F.expr("(1000 * top.length) div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_token_counts": op2_token_counts,
        "op3_source_mix": op3_source_mix,
        "op4_nearest": op4_nearest,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_language": op6_language,
        "op7_toxicity": op7_toxicity,
        "op8_secrets": op8_secrets,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_lm_score": op10_lm_score,
        "op11_whitening": op11_whitening,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": OP3_SQL, "op4_nearest": OP4_SQL, "op5_minhash_dedup": OP5_SQL, "op9_embedding_dedup": OP9_SQL}
