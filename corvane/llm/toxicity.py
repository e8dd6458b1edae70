"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over the words of a text. Each
model also sees the probabilities that the chain gave to the earlier categories; in training
these come from out-of-fold predictions, so that later models learn how far they can be trusted.
Models are fitted on a bounded sample of labelled documents (SAMPLE rows of each class, drawn by
hash, weighted back to the share of their class), each with its whole text, as numbers of the
most frequent words of the sample; every document is scored whole.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import extend, materialize

#: Labelled rows of each class of the last category that are fitted at most.
SAMPLE = 2500
#: A word is a feature if so many sampled texts have it.
MIN_TEXTS = 5
FOLDS, STEPS, RATE, PENALTY = 3, 100, 0.15, 0.5
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased runs of letters."""
    return set(_WORDS.findall(text.lower())) if text else set()


@dataclass
class Chain:
    """Word numbers, and for each category: word weights, weights of earlier probabilities, intercept."""

    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    links: list[tuple[np.ndarray, np.ndarray, float]]

    def predict(self, words: set[str]) -> list[float]:
        get = self.vocabulary.get
        own = np.array([i for w in words if (i := get(w)) is not None], np.int64)
        seen: list[float] = []
        for weights, earlier, bias in self.links:
            z = float(weights[own].sum() + np.dot(earlier, seen) + bias)
            seen.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
        return seen


class _Sums:
    """Sums of one number a word over rows, and of one number a row over words."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, width: int):
        self.sides = []
        for into, of, size in ((rows, cols, n), (cols, rows, width)):
            order = np.argsort(into, kind="stable")
            some, start = np.unique(into[order], return_index=True)
            self.sides.append((of[order], some, start, size))

    def _sum(self, values: np.ndarray, side: int) -> np.ndarray:
        of, some, start, size = self.sides[side]
        out = np.zeros(size)
        if len(of):
            out[some] = np.add.reduceat(values[of], start)
        return out

    def by_row(self, values: np.ndarray) -> np.ndarray:
        return self._sum(values, 0)

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return self._sum(values, 1)


def _fit(sums: _Sums, width: int, dense: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Penalised logistic regression on binary words and dense columns, by Adam on the whole sample."""
    theta = np.zeros(width + dense.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = weight / weight.sum()
    for t in range(1, STEPS + 1):
        z = sums.by_row(theta[:width]) + dense @ theta[width:-1] + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * scale
        grad = np.concatenate([sums.by_word(error), error @ dense, [error.sum()]])
        grad[:-1] += PENALTY / len(y) * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:width], theta[width:-1], float(theta[-1])


def fit_chain(features: list[np.ndarray], vocabulary: dict[str, int], labels: np.ndarray, weight: np.ndarray, fold: np.ndarray, categories: tuple[str, ...]) -> Chain:
    """features: the numbers of each row's words; labels: [row, category] of 0 and 1.

    A category of one class only gets a constant model.
    """
    n, width = len(features), len(vocabulary)
    rows = np.repeat(np.arange(n), [len(own) for own in features])
    sums = _Sums(rows, np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64), n, width)
    earlier = np.zeros((n, 0))
    links = []
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        if len(y) == 0 or y.min() == y.max():
            links.append((np.zeros(width), np.zeros(k), 40.0 if len(y) and y[0] else -40.0))
            out_of_fold = y
        else:
            links.append(_fit(sums, width, earlier, y, weight))
            out_of_fold = np.zeros(len(y))
            for f in range(FOLDS):
                other = fold != f
                if not other.any() or other.all():
                    continue
                w, d, b = _fit(sums, width, earlier, y, np.where(other, weight, 0.0))
                z = sums.by_row(w) + earlier @ d + b
                out_of_fold[~other] = 1 / (1 + np.exp(-np.clip(z[~other], -40, 40)))
        earlier = np.column_stack([earlier, out_of_fold])
    return Chain(categories, vocabulary, links)


def _word_sets(batches):
    for batch in batches:
        words = [sorted(words_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(words, pa.list_(pa.string()))], ["row", "words"])


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE, min_texts: int = MIN_TEXTS, vocabulary_size: int | None = 65_536) -> Chain:
    """Fit the chain. categories: name to 0/1 column over labels, in the chain's order; labels has doc_id.

    Rows with a null id or a null category, and documents with null or empty text, are left out;
    repeated rows count once, in the sample and in the totals that weigh it. A word is a feature
    if min_texts of the sampled texts have it (all of them, where the sample is smaller), and one
    of the vocabulary_size most frequent, equals by code point; None takes all of them. The sample is drawn by a hash of id and labels, so reruns agree; ties
    go to the smaller id. The words of the sampled documents, however long, are counted in the
    cluster; the driver gets the vocabulary and the numbers of each sampled row's words. Without
    labelled documents every probability is that of the constant model, 0.
    """
    spark = docs.sparkSession
    names = list(categories)
    marked = labels.select("doc_id", *[c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())]).dropna().distinct()
    last = f"y{len(names) - 1}"
    # A top-k for each class: every task keeps `sample` rows at most, so no class is a hot key.
    order = [F.md5(F.concat_ws("|", *marked.columns)), F.col("doc_id")]
    first, second = (marked.where(F.col(last) == c).orderBy(*order).limit(sample) for c in (0, 1))
    total = {r[last]: r["count"] for r in marked.groupBy(last).count().collect()}
    # At most 2 * sample rows: a bounded broadcast.
    texts = docs.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(first.union(second)), "doc_id").select(*marked.columns, "text")
    drawn = materialize(extend(texts, {"text": "text"}, "words array<string>", _word_sets, marked.columns).dropDuplicates())
    counts = drawn.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") >= min(min_texts, max(1, drawn.count())))
    ranked = counts.orderBy(F.desc("count"), "word")
    vocabulary = {w: i for i, w in enumerate(sorted(r["word"] for r in (ranked if vocabulary_size is None else ranked.limit(vocabulary_size)).collect()))}
    known = spark.sparkContext.broadcast(vocabulary)

    def number(batches):
        get = known.value.get
        for batch in batches:
            own = [[i for w in words if (i := get(w)) is not None] for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(own, pa.list_(pa.int32()))], ["row", "own"])

    rows = extend(drawn, {"words": F.col("words")}, "own array<int>", number).drop("words").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["own"], *[r[c] for c in marked.columns[1:]]))
    y = np.array([[r[c] for c in marked.columns[1:]] for r in rows], np.int64).reshape(-1, len(names))
    decisive = y[:, -1]
    weight = np.array([total[c] / (decisive == c).sum() for c in decisive.tolist()])
    fold = np.array([zlib.crc32(str(r["doc_id"]).encode()) % FOLDS for r in rows])
    return fit_chain([np.array(r["own"], np.int64) for r in rows], vocabulary, y, weight, fold, tuple(names))


def classify(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_", keep: list[str] | None = None) -> DataFrame:
    """Add p_<category> for each category. Texts that are null or without letters get probability 0.

    Repeated rows each come out; the input's columns stay as they are, but those of the added
    names are replaced. keep names the columns that come out (all).
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"{prefix}{c}" for c in chain.categories]

    def run(batches):
        own = held.value
        for batch in batches:
            rows = [own.predict(w) if (w := words_of(t)) else [0.0] * len(names) for t in batch.column("text").to_pylist()]
            columns = np.array(rows, float).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, columns)], ["row", *names])

    return extend(docs, {"text": text_col}, ", ".join(f"`{n}` double" for n in names), run, keep)


def default_categories() -> dict[str, Column]:
    """The chain over the table labels: low quality first, then toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
