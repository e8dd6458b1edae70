"""Places where models plug in, with offline defaults that always give the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import token_estimate_chars
from corvane.operators import folds
from corvane.operators.retrieval import tokens


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Generator(Protocol):
    """Texts in, texts out: a summary of each."""

    def __call__(self, texts: pd.Series) -> pd.Series: ...


def hashing_embedder(dimension: int = 64) -> Embedder:
    """Words hashed to signed places: a deterministic stand-in for a model, native expressions alone."""

    def embed(text: Column) -> Column:
        places = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(2 * dimension)))
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (F.size(F.filter(places, lambda p: p == i)) - F.size(F.filter(places, lambda p: p == i + dimension))).cast("float"))

    return embed


def model_embedder(batch: Callable[[list[str]], list[list[float]]], size: int = 64) -> Embedder:
    """A model that embeds batches of texts, loaded once a worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = texts.fillna("").tolist()
            out: list[list[float]] = []
            for at in range(0, len(rows), size):
                out += batch(rows[at : at + size])
            yield pd.Series(out, index=texts.index)

    return lambda text: F.pandas_udf(run, T.ArrayType(T.FloatType()), functionType=F.PandasUDFType.SCALAR_ITER)(text)


def overlap_reranker(query: str) -> Callable[[], Column]:
    """Share of the query's words that a row's text has."""
    words = list(dict.fromkeys(query.lower().split()))

    def score() -> Column:
        return F.size(F.array_intersect(tokens(F.col("text")), F.array(*map(F.lit, words)))) / float(max(1, len(words)))

    return score


def first_sentences(texts: pd.Series) -> pd.Series:
    """The first 200 characters of each line, a stand-in for a generator."""
    return texts.map(lambda t: " ".join(line[:200] for line in (t or "").split("\n\n"))[:2000])


def summarise(blocks: DataFrame, generate: Generator = first_sentences, doc: str = "doc_id", order: str = "reading_order", text: str = "text", chunk_tokens: int = folds.CHUNK_TOKENS, batch_tokens: int = folds.BATCH_TOKENS, rounds: int = 8) -> DataFrame:
    """One text a document: chunks are summarised, then merged in batches until one is left.

    Each round packs greedily and calls the generator once a chunk, spread over the cluster. The
    loop ends when every document has one text; rounds only guards against a generator that does
    not shorten, whose last texts are then joined in one call a document.
    """
    line = F.format_string("[source:%s order:%s] %s", F.col(doc).cast("string"), F.col(order).cast("string"), F.col(text))
    now = blocks.where(F.trim(text) != "").select(F.col(doc).alias("doc"), F.col(order).cast("long").alias("pos"), line.alias("text"))
    run = F.pandas_udf(generate, T.StringType())
    target = chunk_tokens
    for i in range(rounds):
        packed = folds.pack(now, "doc", "pos", token_estimate_chars(F.col("text")), target if i < rounds - 1 else 1 << 60)
        groups = now.join(packed.select("doc", "pos", "chunk"), ["doc", "pos"]).groupBy("doc", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
        now = groups.select("doc", F.col("chunk").cast("long").alias("pos"), run(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")).alias("text"))
        if i < rounds - 1 and now.groupBy("doc").count().where("count > 1").isEmpty():
            break
        target = batch_tokens
    return now.select(F.col("doc").alias(doc), F.col("text").alias("summary"))

