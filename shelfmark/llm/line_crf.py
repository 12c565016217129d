"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad. A line's features describe its words and characters and those of the lines before and
after it: how it is written, and how its words divide between good and bad documents, by the log odds of each word in
the labelled sample. Two weights for the kinds of change between neighbouring lines complete the field. Forward-backward gives
each line's probability of being good, and a document's quality is the mean of these, weighted by line length.

The field is fitted on all lines of a bounded sample of labelled documents (``sample``, a parameter of the fit only),
grouped by their number of lines, so that padding at most doubles them. Lines carry the label of their document at first; then lines of bad
documents that look good are relabelled, the document's worst line excepted, and the field is fitted again. While it is
fitted, a document's words have the log odds that the documents of the other fold give, so that no line is described by
its own label. Words that count are the ``words`` most frequent ones of the sample. Every
document is scored over all its lines in one pass without a shuffle.

Defined results: a null or empty text is one empty line and gets its probability; lines without characters weigh
nothing unless all lines are so; without labelled documents every line is as likely good as bad; repeated rows are
scored alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import keep_rows, parts, small_batches
from shelfmark.llm.sampling import fold_of, id_remainder, labelled_sample
from shelfmark.llm.shared import stored

SAMPLE = 4_000
#: Words with log odds at most, in at least so many documents of the sample; the largest log odds.
WORDS, WORD_DOCS, MOST_ODDS = 20_000, 3, 3.0
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
THRESHOLD = 0.7
SYMBOLS, CAPITALS, DIGITS, ENDS = b"#*$%&|<>!~^_=+{}[]\\@", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", (b".", b"!", b"?", b'"', b":")
OWN = 13
#: Own features that are taken of the neighbours, too.
SHARED = (1, 2, 4, 5, 10)
N_FEATURES = OWN + 2 * len(SHARED)


def word_features(line: bytes, odds: dict[bytes, float]) -> tuple[float, float, float]:
    """The mean log odds of a line's words, the share of words for bad documents, and the share of unknown ones."""
    words = line.translate(LETTERS).split()
    known = [o for o in map(odds.get, words) if o is not None]
    if not words:
        return 0.0, 0.0, 0.0
    return sum(known) / len(words), sum(o < -1 for o in known) / len(words), 1 - len(known) / len(words)


def line_features(text: str | None, odds: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line and the lines' lengths in bytes."""
    lines = (text or "").encode().split(b"\n")
    own, sizes, seen = [], [], set()
    for line in lines:
        words = line.split()
        n, chars = len(words), max(1, len(line) - line.count(b" "))
        doubled = sum(map(eq, words, words[1:])) if n > 1 else 0
        own.append((
            1.0,
            (len(line) - len(line.translate(None, SYMBOLS))) / chars,
            (len(line) - len(line.translate(None, CAPITALS))) / chars,
            (len(line) - len(line.translate(None, DIGITS))) / chars,
            doubled / n if n else 0.0,
            1.0 - len(set(words)) / n if n else 0.0,
            min(n, 100) / 100,
            min(chars / n, 30) / 10 if n else 0.0,
            float(line.endswith(ENDS)),
            float(n > 0 and line in seen),
            *word_features(line, odds),
        ))
        seen.add(line)
        sizes.append(len(line))
    x = np.zeros((len(lines), N_FEATURES))
    x[:, :OWN] = own
    x[1:, OWN : OWN + len(SHARED)] = x[:-1, SHARED]
    x[:-1, OWN + len(SHARED) :] = x[1:, SHARED]
    return x, np.array(sizes, float)


class Field(NamedTuple):
    """Weights of a good line's features, and of staying good, staying bad (a change weighs 0)."""

    weights: np.ndarray
    stay: np.ndarray
    #: Log odds of words for good documents.
    odds: dict[bytes, float] = {}


def marginals(field: Field, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line good), and P(both good), P(both bad) of each line and the next, for padded documents.

    ``x`` has the shape (documents, lines, features), ``sizes`` the documents' line counts.
    """
    n, length, _ = x.shape
    good = x @ field.weights
    inside = np.arange(length) < sizes[:, None]
    good = np.where(inside, good, 0.0)
    g, b = field.stay
    ahead = np.zeros((n, length, 2))
    ahead[:, 0, 1] = good[:, 0]
    for t in range(1, length):
        bad_before, good_before = ahead[:, t - 1, 0], ahead[:, t - 1, 1]
        bad = np.logaddexp(bad_before + b, good_before)
        fine = np.logaddexp(bad_before, good_before + g) + good[:, t]
        ahead[:, t, 0], ahead[:, t, 1] = bad, fine
    back = np.zeros((n, length, 2))
    for t in range(length - 2, -1, -1):
        bad_next, good_next = back[:, t + 1, 0], back[:, t + 1, 1] + good[:, t + 1]
        more = inside[:, t + 1]
        back[:, t, 0] = np.where(more, np.logaddexp(bad_next + b, good_next), 0.0)
        back[:, t, 1] = np.where(more, np.logaddexp(bad_next, good_next + g), 0.0)
    total = np.logaddexp(ahead[:, 0, 0] + back[:, 0, 0], ahead[:, 0, 1] + back[:, 0, 1])
    p = np.exp(np.minimum(0, ahead[:, :, 1] + back[:, :, 1] - total[:, None])) * inside
    both = np.zeros((n, max(0, length - 1), 2))
    if length > 1:
        pair = inside[:, 1:]
        both[:, :, 0] = np.exp(np.minimum(0, ahead[:, :-1, 1] + g + good[:, 1:] + back[:, 1:, 1] - total[:, None])) * pair
        both[:, :, 1] = np.exp(np.minimum(0, ahead[:, :-1, 0] + b + back[:, 1:, 0] - total[:, None])) * pair
    return p, both


class Group(NamedTuple):
    """Padded documents of similar length: features, line counts, line labels."""

    x: np.ndarray
    sizes: np.ndarray
    y: np.ndarray

    @property
    def inside(self) -> np.ndarray:
        return np.arange(self.x.shape[1]) < self.sizes[:, None]


def fit_field(groups: list[Group], l2: float = 1.0, steps: int = 250) -> Field:
    """Conditional maximum likelihood for the line labels of all groups, by Adam steps on the exact gradient."""
    k = groups[0].x.shape[2]
    seen, n_lines = np.zeros(k + 2), max(1.0, float(sum(group.sizes.sum() for group in groups)))
    for x, sizes, y in groups:
        inside = (np.arange(x.shape[1]) < sizes[:, None]).astype(float)
        y, pairs = y * inside, inside[:, 1:]
        seen[:k] += np.einsum("nl,nlk->k", y, x)
        seen[k:] += (y[:, :-1] * y[:, 1:] * pairs).sum(), ((1 - y[:, :-1]) * (1 - y[:, 1:]) * pairs).sum()
    theta, first, second = np.zeros(k + 2), np.zeros(k + 2), np.zeros(k + 2)
    for step in range(1, steps + 1):
        slope = seen - l2 * theta
        for x, sizes, _ in groups:
            p, both = marginals(Field(theta[:k], theta[k:]), x, sizes)
            slope -= np.concatenate([np.einsum("nl,nlk->k", p, x), both.sum(axis=(0, 1))])
        slope /= n_lines
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:k], theta[k:])


def fit_documents(features: list[np.ndarray], labels: np.ndarray, rounds: int = 2) -> Field:
    """The field of labelled documents (1 good, 0 bad)."""
    if not features:
        return Field(np.zeros(N_FEATURES), np.zeros(2))
    by_length: dict[int, list[int]] = {}
    for i, f in enumerate(features):
        by_length.setdefault(max(3, (len(f) - 1).bit_length()), []).append(i)
    groups, told = [], []
    for _, members in sorted(by_length.items()):
        sizes = np.array([len(features[i]) for i in members])
        x = np.zeros((len(members), sizes.max(), N_FEATURES))
        for row, i in zip(x, members):
            row[: len(features[i])] = features[i]
        told.append(labels[members])
        groups.append(Group(x, sizes, np.repeat(told[-1][:, None].astype(float), x.shape[1], axis=1)))
    field = fit_field(groups)
    for _ in range(rounds - 1):
        again = []
        for group, own in zip(groups, told):
            p, _ = marginals(field, group.x, group.sizes)
            p = np.where(group.inside, p, 2.0)
            worst = p.argmin(axis=1)
            y = np.where(own[:, None] == 1, 1.0, (p > 0.5).astype(float))
            y[own == 0, worst[own == 0]] = 0.0
            again.append(group._replace(y=y))
        groups = again
        field = fit_field(groups)
    return field


def document_score(field: Field, text: str | None) -> float:
    """Length-weighted mean of the lines' probabilities of being good."""
    x, weight = line_features(text, field.odds)
    p, _ = marginals(field, x[None], np.array([len(x)]))
    if not weight.any():
        weight = np.ones(len(x))
    return float(min(1.0, max(0.0, (p[0] * weight).sum() / weight.sum())))


def log_odds(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int) -> np.ndarray:
    """How much likelier words are in good documents, of the numbers of good and bad ones that hold them."""
    return np.clip(np.log((good + 1) / (n_good + 2)) - np.log((bad + 1) / (n_bad + 2)), -MOST_ODDS, MOST_ODDS)


def sample_odds(sample: DataFrame, words: int) -> list[dict[bytes, float]]:
    """Log odds of the sample's words by the documents of fold 0, of fold 1, and of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 200):
            for text, label, fold in zip(batch.column("text"), batch.column("label").to_pylist(), batch.column("fold").to_pylist()):
                own = sorted(set((text.as_py() or "").encode().translate(LETTERS).split()))
                columns = [pa.array(own, pa.binary()), pa.array([label] * len(own), pa.int32()), pa.array([fold] * len(own), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "label", "fold"])

    sums = [F.count_if((F.col("label") == y) & (F.col("fold") == f)).alias(f"n{y}{f}") for f in (0, 1) for y in (1, 0)]
    counts = sample.select("text", "label", "fold").mapInArrow(run, "word binary, label int, fold int").groupBy("word").agg(*sums)
    often = counts.withColumn("n", F.expr("n10 + n00 + n11 + n01")).where(F.col("n") >= WORD_DOCS)
    best = often.orderBy(F.desc("n"), "word").limit(words).collect()
    total = sample.agg(*sums).first()
    names = [bytes(row.word) for row in best]
    n = {y: np.array([[row[f"n{y}0"] for row in best], [row[f"n{y}1"] for row in best]], float).reshape(2, -1) for y in (1, 0)}
    whole = {y: np.array([total[f"n{y}0"] or 0, total[f"n{y}1"] or 0]) for y in (1, 0)}
    folds = [log_odds(n[1][f], n[0][f], whole[1][f], whole[0][f]) for f in (0, 1)]
    folds.append(log_odds(n[1].sum(axis=0), n[0].sum(axis=0), whole[1].sum(), whole[0].sum()))
    return [dict(zip(names, odds.tolist())) for odds in folds]


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> Field:
    """The field of the labelled sample; ``labels`` has doc_id and label (0 or 1)."""
    small_batches(docs.sparkSession)
    told = stored(labelled_sample(docs, labels, sample).withColumn("fold", fold_of(F.col("doc_id"), 2)), "sample")
    odds = sample_odds(told, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 200):
            folds = batch.column("fold").to_pylist()
            found = [line_features(t.as_py(), odds[1 - f])[0].astype("<f8").tobytes() for t, f in zip(batch.column("text"), folds)]
            columns = [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "x"])

    rows = told.mapInArrow(run, "doc_id long, label int, x binary").collect()
    rows.sort(key=lambda row: row.doc_id)
    features = [np.frombuffer(row.x, "<f8").reshape(-1, N_FEATURES) for row in rows]
    return fit_documents(features, np.array([row.label for row in rows], int))._replace(odds=odds[2])


def score_quality(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            scores = np.array([document_score(field, t.as_py()) for t in batch.column("text")], float)
            columns = [batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    field = fit_on(docs, labels.select("doc_id", F.col("quality").cast("int").alias("label")))
    return keep_rows(docs, lambda texts: [document_score(field, t) >= threshold for t in texts])


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels of ids that are not held out."""
    told = labels.where(id_remainder(F.col("doc_id"), 4) != 2)
    field = fit_on(docs, told.select("doc_id", F.col("quality").cast("int").alias("label")))
    held = id_remainder(F.col("doc_id"), 4) == 2
    return score_quality(docs, field).select("doc_id", held.alias("held_out"), "score", "predicted")
