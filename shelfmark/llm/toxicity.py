"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. Each classifier is a logistic regression over the distinct words of
a document, the beginnings of its words, and the probabilities of the categories before it. While the chain is fitted,
these probabilities are out-of-fold predictions, so a later classifier meets them as wrong as they will be on new
documents: what is chosen by labels (words, terms, and the categories derived from these) is chosen anew for each fold,
from the documents outside of it.

The chain is fitted on a bounded sample of labelled documents (``sample``, by hash of the id) and their ``words`` most
telling words; words and weights have that bound, too, and travel with the scoring tasks. Every document is scored
over its whole text, in one pass without a shuffle.

Labels give one category, toxic. Two earlier ones are derived from it: terms that the sample ties to toxic documents
make a document ``abusive`` if one occurs, and ``sustained`` if several do.

Defined results: a null text is an empty one and has the probability of a document without any telling word; without
labelled documents, or with one class only, all documents get the class's smoothed share; rows that repeat are scored
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import keep_rows, parts, small_batches
from shelfmark.llm.sampling import fold_of, labelled_sample
from shelfmark.llm.shared import stored

#: Labelled documents and words that the chain is fitted on at most.
SAMPLE, WORDS = 8_000, 2_000
FOLDS = 4
THRESHOLD = 0.5
#: A telling term: in at least so many toxic documents, and this share of its documents toxic.
TERM_DOCS, TERM_SHARE = 3, 0.8
#: Different telling terms that make abuse sustained.
SUSTAINED = 6
#: Lengths of the beginnings of words that are features, too: inflected terms share one.
HEADS = (5, 7)
CATEGORIES = ("abusive", "sustained", "toxic")
WORD = re.compile(r"[^\W_]+")


def distinct_features(text: str | None) -> set[str]:
    """The distinct words of a text, their beginnings, and beginnings that several of its words share."""
    words = set(WORD.findall(text.lower())) if text else set()
    found = set(words)
    for n in HEADS:
        heads = Counter([w[:n] for w in words if len(w) > n])
        found.update(["^" + h for h in heads])
        found.update(["^^" + h for h, k in heads.items() if k > 1])
    return found


class Linear(NamedTuple):
    """Weights of words, of the probabilities of earlier categories, and the bias."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float


class Chain(NamedTuple):
    vocabulary: dict[str, int]
    models: list[Linear]

    def score(self, text: str | None) -> list[float]:
        """Probability of each category in order."""
        index = [self.vocabulary[w] for w in sorted(distinct_features(text) & self.vocabulary.keys())]
        done: list[float] = []
        for model in self.models:
            z = model.bias + model.words[index].sum() + float(np.dot(model.earlier, done))
            done.append(float(1 / (1 + np.exp(-z))))
        return done


def _columns(rows: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ones of a 0/1 matrix."""
    sizes = [len(row) for row in rows]
    return np.repeat(np.arange(len(rows)), sizes), np.array([i for row in rows for i in row], np.int64)


def fit_linear(rows: list[list[int]], n_words: int, earlier: np.ndarray, y: np.ndarray, l2: float = 0.02, steps: int = 300) -> Linear:
    """Logistic regression by accelerated gradient steps; the bias starts at the smoothed share of the class."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 2)
    if n == 0 or y.min() == y.max():
        return Linear(np.zeros(n_words), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share))))
    at, of = _columns(rows, n_words)
    words, others, bias = np.zeros(n_words), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share)))
    past = [np.zeros(n_words), np.zeros(earlier.shape[1]), 0.0]
    scale = [np.full(n_words, 1e-8), np.full(earlier.shape[1], 1e-8), 1e-8]
    for step in range(steps):
        z = bias + earlier @ others + np.bincount(at, words[of], n)
        off = 1 / (1 + np.exp(-z)) - y
        slope = [np.bincount(of, off[at], n_words) + l2 * words, earlier.T @ off + l2 * others, off.sum()]
        rate = 0.3 / (1 + step / 100)
        for i, g in enumerate(slope):
            past[i] = 0.9 * past[i] + 0.1 * g
            scale[i] = 0.99 * scale[i] + 0.01 * g * g
        moves = [rate * p / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-6) for p, s in zip(past, scale)]
        words, others, bias = words - moves[0], others - moves[1], bias - float(moves[2])
    return Linear(words, others, bias)


def predict(model: Linear, rows: list[list[int]], earlier: np.ndarray) -> np.ndarray:
    at, of = _columns(rows, len(model.words))
    return 1 / (1 + np.exp(-(model.bias + earlier @ model.earlier + np.bincount(at, model.words[of], len(rows)))))


class Choice(NamedTuple):
    """What is chosen by the labels of some documents: the telling words in order, and those that are terms."""

    vocabulary: list[str]
    terms: set[str]

    def rows(self, docs: list[set[str]]) -> list[list[int]]:
        """The numbers of each document's telling words."""
        number = {word: i for i, word in enumerate(self.vocabulary)}
        return [sorted(number[w] for w in words if w in number) for words in docs]

    def targets(self, docs: list[set[str]], toxic: np.ndarray) -> np.ndarray:
        """The categories of each document, a column each."""
        held = np.array([len(self.terms & words) for words in docs], np.int64)
        return np.column_stack([held > 0, held >= SUSTAINED, toxic]).astype(float)


def choose(counts: list[tuple[str, int, int]], n: int, toxic: int, words: int) -> Choice:
    """The ``words`` most telling of (word, documents, toxic documents), in a sample of ``n`` with ``toxic`` toxic ones.

    Telling is how far a word's share of toxic documents is from the sample's, in standard deviations.
    """
    p = (toxic + 1) / (n + 2)
    told = [(-round(abs(t - k * p) / (k * p * (1 - p)) ** 0.5, 6), word, k, t) for word, k, t in counts if k > 2]
    best = sorted(told)[:words]
    return Choice(sorted(word for _, word, _, _ in best), {word for _, word, k, t in best if t >= TERM_DOCS and t >= TERM_SHARE * k})


def fit_chain(docs: list[set[str]], toxic: np.ndarray, fold: np.ndarray, whole: Choice, by_fold: list[Choice]) -> Chain:
    """A chain over the categories; ``by_fold`` is what the documents outside of each fold choose."""
    earlier, models = np.zeros((len(docs), 0)), []
    rows, told = whole.rows(docs), whole.targets(docs, toxic)
    apart = [(choice.rows(docs), choice.targets(docs, toxic), len(choice.vocabulary)) for choice in by_fold]
    for c, y in enumerate(told.T):
        out = np.zeros(len(docs))
        for f, (own, targets, n_words) in enumerate(apart):
            fit, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            part = fit_linear([own[i] for i in fit], n_words, earlier[fit], targets[fit, c])
            out[held] = predict(part, [own[i] for i in held], earlier[held])
        models.append(fit_linear(rows, len(whole.vocabulary), earlier, y))
        earlier = np.column_stack([earlier, out])
    return Chain({word: i for i, word in enumerate(whole.vocabulary)}, models)


def _sample_words(sample: DataFrame) -> DataFrame:
    """doc_id, label and distinct words of the sample, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 200):
            words = [sorted(distinct_features(t.as_py())) for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("label"), pa.array(words, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "words"])

    return sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, words array<string>")


def _choice(counts: DataFrame, n: int, toxic: int, words: int) -> Choice:
    """``choose``, of the words' counts (word, n, t) in a table of any size."""
    p = (toxic + 1) / (n + 2)
    told = counts.where("n > 2").withColumn("z", F.abs(F.col("t") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p)))
    best = told.orderBy(F.desc(F.round("z", 6)), "word").limit(words).collect()
    return choose([(row.word, row.n, row.t) for row in best], n, toxic, words)


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS, folds: int = FOLDS) -> Chain:
    """The chain of the categories, from the labelled sample of ``docs``; ``labels`` has doc_id and label (0 or 1)."""
    small_batches(docs.sparkSession)
    known = stored(_sample_words(labelled_sample(docs, labels, sample)).withColumn("fold", fold_of(F.col("doc_id"), folds)), "sample")
    outside = lambda f: F.col("fold") != f
    sums = [F.count("*").alias("n"), F.sum("label").alias("t")]
    for f in range(folds):
        sums += [F.count_if(outside(f)).alias(f"n{f}"), F.sum(F.when(outside(f), F.col("label"))).alias(f"t{f}")]
    share = known.agg(*sums).first().asDict()
    counts = stored(known.select("label", "fold", F.explode("words").alias("word")).groupBy("word").agg(*sums).where("n > 2"), "words")
    of = lambda f: _choice(counts.select("word", F.col(f"n{f}").alias("n"), F.coalesce(f"t{f}", F.lit(0)).alias("t")), share[f"n{f}"] or 0, share[f"t{f}"] or 0, words)
    whole, by_fold = of(""), [of(f) for f in range(folds)]
    kept = set().union(*(choice.vocabulary for choice in (whole, *by_fold)))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[w for w in words if w in kept] for words in batch.column("words").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("label"), batch.column("fold"), pa.array(own, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "fold", "words"])

    rows = sorted(known.mapInArrow(chosen, "doc_id long, label int, fold int, words array<string>").collect())
    told = [set(map(sys.intern, row.words)) for row in rows]
    return fit_chain(told, np.array([row.label for row in rows], np.int64), np.array([row.fold for row in rows], np.int64), whole, by_fold)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, the probability of each category, and whether it is toxic."""
    small_batches(docs.sparkSession)
    chain = fit_on(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            scores = np.array([chain.score(t.as_py()) for t in batch.column("text")]).reshape(-1, len(CATEGORIES))
            columns = [batch.column("doc_id"), *map(pa.array, scores.T), pa.array(scores[:, -1] >= threshold)]
            names = ["doc_id", *(f"p_{category}" for category in CATEGORIES), "is_toxic"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, " + "".join(f"p_{category} double, " for category in CATEGORIES) + "is_toxic boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def filter_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns."""
    chain = fit_on(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("label")))
    return keep_rows(docs, lambda texts: [chain.score(t)[-1] < threshold for t in texts])
