"""A corpus pipeline of five stages over documents.

toxicity -> MinHash near-dedup -> secret scans -> mixing sources -> byte-level BPE. Each stage
takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared
folder and reads it again as the next stage's docs, so a lost executor costs one stage at most.
What a stage wrote for itself, and the docs before, are removed then. All stages but the last
return the columns of documents, whatever further ones there are and however they are named.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import bpe, minhash, mixing, secrets, toxicity
from corvane.llm._common import discard, materialize, packed_row, quoted, scratch, word_count


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is at least one half go; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(docs, labels, toxicity.default_categories())
    prefix = _free(docs, "p_")
    scored = toxicity.classify(docs, chain, prefix=prefix)
    return scored.where(F.col(f"{prefix}toxic") < 0.5).select(*[quoted(c) for c in docs.columns])


def _free(docs: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of docs begins with it."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    return name


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Rows that share an id are one document, which stays or goes as a whole: each of its different
    texts comes out once, with the smallest of the other columns that come with it. Rows without id stay.
    """
    found = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL")
    times, nth = _free(docs, "times"), _free(docs, "nth")
    kept = found.groupBy("doc_id").agg(F.count("*").alias(times))
    columns = [quoted(c) for c in docs.columns]
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id")
    # Texts and other columns are compared only where an id comes more than once.
    again = lambda c: F.when(F.col(times) > 1, c)
    rest = [quoted(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]
    order = Window.partitionBy("doc_id", again(F.col("text"))).orderBy(again(F.struct(*rest)))
    once = named.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return once.select(*columns).union(docs.where("doc_id IS NULL").select(*columns))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays. n_chars follows where there is one."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none to three times. Texts are not shuffled."""
    wide = docs.select(packed_row(docs).alias("whole"), "doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("tie"))
    mixed = mixing.mix(wide, F.array("source"), F.col("words"), tie=F.col("tie")).where("_repeats > 0")
    return mixed.select("whole", F.explode(F.sequence(F.lit(1), F.col("_repeats")))).select("whole.*")


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, checked by decoding."""
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digest(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("toxicity", _toxicity), ("near_dedup", _near_dedup), ("secrets", _secrets), ("mix", _mix), ("byte_bpe", _bpe)]

#: Learned models, flows and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of sf_dir. The result is a table in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark) as written:
            docs = materialize(stage(spark, docs, sf_dir), spark)
            written.pop()
        if before is not None:
            discard(before)
        before = docs
    return docs
