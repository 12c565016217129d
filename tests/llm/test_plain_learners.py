"""What the learned operators compute, beside plain versions, and their held-out accuracy."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from shelfmark.llm import line_crf, quality_rules, sampling, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return {name: spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels")}


def buckets_of(text, grams, buckets):
    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    for n in grams:
        for i in range(len(words) - n + 1):
            h = 42
            for w in words[i : i + n]:
                h = xxhash.xxh64(w.to_bytes(8, "little"), seed=h).intdigest()
            yield (h - (1 << 64) * (h >> 63)) % buckets


@pytest.mark.parametrize("grams", [(1, 2), (3,), (2, 1, 4)])
def test_ratio_beside_a_plain_version(spark, grams):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1} & texts.keys()
    buckets, smoothing, threshold = 5000, 0.5, -0.1
    raw = Counter(b for t in texts.values() for b in buckets_of(t, grams, buckets))
    target = Counter(b for i in good for b in buckets_of(texts[i], grams, buckets))
    room, n_raw, n_target = smoothing * buckets, sum(raw.values()), sum(target.values())
    weight = {b: round(math.log((target[b] + smoothing) / (n_target + room) / ((raw[b] + smoothing) / (n_raw + room))) * (1 << 20)) for b in raw}
    found = quality_rules.judge_quality(docs, labels, grams, buckets, smoothing, threshold).collect()
    assert len(found) == len(texts)
    for r in found:
        own = [weight[b] for b in buckets_of(texts[r.doc_id], grams, buckets)]
        mean = sum(own) / len(own) / (1 << 20) if own else 0.0
        assert r.log_ratio == pytest.approx(mean, abs=1e-5)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        if abs(mean - threshold) > 1e-5:
            assert r.kept == (not r.base_failed and mean >= threshold)


def test_ratio_on_held_out_labels(tables):
    docs, labels = tables["documents"], tables["labels"]
    told = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 0").collect()}
    found = {r.doc_id: r for r in quality_rules.judge_quality(docs, labels.where("doc_id % 2 = 1")).collect()}
    good = [found[i].kept for i, q in told.items() if q == 1 and not found[i].base_failed]
    bad = [found[i].kept for i, q in told.items() if q == 0]
    assert sum(good) >= 0.97 * len(good) > 50 and sum(bad) <= 0.1 * len(bad)


def plain_logistic(rows, n_words, earlier, y, l2=0.02):
    """The same objective by Newton steps on dense matrices."""
    x = np.zeros((len(rows), n_words))
    for i, row in enumerate(rows):
        x[i, row] = 1
    x = np.column_stack([x, earlier, np.ones(len(rows))])
    penalty = np.append(np.full(x.shape[1] - 1, l2), 0.0)
    theta = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (p - y) + penalty * theta
        theta -= 0.5 * np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), slope)
    return theta


def small_corpus(n=160):
    rng = random.Random(7)
    words = [f"plain{i}" for i in range(30)]
    docs, toxic = [], []
    for i in range(n):
        bad = i % 4 == 0
        own = set(rng.sample(words, 8)) | ({f"vile{rng.randrange(6)}" for _ in range(3)} if bad and rng.random() < 0.9 else set())
        if not bad and rng.random() < 0.05:
            own.add("vile0")
        docs.append(own)
        toxic.append(int(bad))
    return docs, np.array(toxic)


def plain_choice(docs, toxic, words):
    n, t = len(docs), int(toxic.sum())
    count = Counter(w for own in docs for w in own)
    bad = Counter(w for own, y in zip(docs, toxic) if y for w in own)
    p = (t + 1) / (n + 2)
    z = {w: round(abs(bad[w] - k * p) / math.sqrt(k * p * (1 - p)), 6) for w, k in count.items() if k > 2}
    best = sorted(z, key=lambda w: (-z[w], w))[:words]
    return sorted(best), {w for w in best if bad[w] >= 3 and bad[w] >= 0.8 * count[w]}


def test_logistic_regression():
    docs, toxic = small_corpus()
    number = {w: i for i, w in enumerate(sorted(set().union(*docs)))}
    rows = [sorted(number[w] for w in own) for own in docs]
    earlier = np.random.default_rng(0).random((len(docs), 2))
    model = toxicity.fit_linear(rows, len(number), earlier, toxic.astype(float))
    theta = plain_logistic(rows, len(number), earlier, toxic)
    own = toxicity.predict(model, rows, earlier)
    x = np.array([theta[row].sum() for row in rows]) + earlier @ theta[len(number) : -1] + theta[-1]
    assert np.abs(own - 1 / (1 + np.exp(-x))).max() < 0.05


def test_chain_beside_a_plain_version(spark):
    """Choices, targets and folds of the chain by loops over documents."""
    docs, toxic = small_corpus()
    fold = np.arange(len(docs)) % 4
    choices = [toxicity.Choice(*plain_choice([d for d, f in zip(docs, fold) if f != g], toxic[fold != g], 20)) for g in range(4)]
    whole = toxicity.Choice(*plain_choice(docs, toxic, 20))
    chain = toxicity.fit_chain(docs, toxic, fold, whole, choices)
    earlier, models = np.zeros((len(docs), 0)), []
    for c in range(3):
        out = np.zeros(len(docs))
        for g, (vocabulary, terms) in enumerate(choices):
            inside = [i for i in range(len(docs)) if fold[i] != g]
            number = {w: i for i, w in enumerate(vocabulary)}
            rows = [sorted(number[w] for w in d & number.keys()) for d in docs]
            y = [[len(terms & docs[i]) > 0, len(terms & docs[i]) >= toxicity.SUSTAINED, toxic[i]][c] for i in inside]
            model = toxicity.fit_linear([rows[i] for i in inside], len(vocabulary), earlier[inside], np.array(y, float))
            for i in np.flatnonzero(fold == g):
                z = model.bias + model.words[rows[i]].sum() + earlier[i] @ model.earlier
                out[i] = 1 / (1 + math.exp(-z))
        models.append(out)
        earlier = np.column_stack(models)
    last = chain.models[2]
    number = {w: i for i, w in enumerate(whole.vocabulary)}
    again = toxicity.fit_linear([sorted(number[w] for w in d & number.keys()) for d in docs], 20, earlier[:, :2], toxic.astype(float))
    assert np.allclose(last.words, again.words) and np.allclose(last.earlier, again.earlier) and last.bias == pytest.approx(again.bias)


def test_chain_is_chosen_in_spark_as_in_python(spark):
    docs, toxic = small_corpus()
    rows = spark.createDataFrame([(i, " ".join(sorted(d))) for i, d in enumerate(docs)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, label int")
    chain = toxicity.fit_on(rows, labels, words=40)
    told = [toxicity.distinct_features(" ".join(sorted(d))) for d in docs]
    assert sorted(chain.vocabulary) == plain_choice(told, toxic, 40)[0]
    again = toxicity.fit_on(rows.repartition(7), labels.repartition(3), words=40)
    assert all(np.allclose(a.words, b.words) for a, b in zip(chain.models, again.models))
    scores = [chain.score(" ".join(sorted(d)))[-1] for d in docs]
    assert sum((s >= 0.5) == bool(y) for s, y in zip(scores, toxic)) >= 0.9 * len(docs)


def test_contradicting_rows_of_a_labelled_id(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, label int")
    found = {tuple(sorted(map(tuple, sampling.labelled_sample(rows.repartition(n), labels, 10).collect()))) for n in (1, 2, 3)}
    assert len(found) == 1 and {(i, label) for i, _, label in found.pop()} == {(1, 1), (2, 0)}


def plain_marginals(field, x):
    """P(line good) of one document, by all ways to label it."""
    good, total = np.zeros(len(x)), 0.0
    for y in itertools.product((0, 1), repeat=len(x)):
        w = math.exp(sum(x[t] @ field.weights for t in range(len(x)) if y[t]) + sum(field.stay[1 - y[t]] for t in range(len(x) - 1) if y[t] == y[t + 1]))
        total += w
        good += w * np.array(y)
    return good / total


def test_document_scores_beside_a_plain_version():
    rng = np.random.default_rng(3)
    field = line_crf.Field(rng.normal(size=line_crf.N_FEATURES), np.array([0.4, 0.9]), {b"good": 1.5, b"junk": -2.0})
    for text in ("Good words here.\n\n### junk junk 99\nGood words here.", "", None, "\n\n", "x", "A b. junk"):
        lines = (text or "").encode().split(b"\n")
        x, sizes = line_crf.line_features(text, field.odds)
        assert sizes.tolist() == [len(line) for line in lines]
        p, weight = plain_marginals(field, x), np.array([len(line) for line in lines], float)
        weight = weight if weight.any() else np.ones(len(lines))
        assert line_crf.document_score(field, text) == pytest.approx(float((p * weight).sum() / weight.sum()))


def test_fit_is_the_conditional_maximum():
    """At the fitted weights, no small change raises the penalised likelihood, which loops over all labellings give."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(6, 3, line_crf.N_FEATURES)), rng.integers(0, 2, (6, 3)).astype(float)
    sizes = np.array([3, 2, 1, 3, 3, 2])
    field = line_crf.fit_field([line_crf.Group(x, sizes, y)], l2=1.0, steps=1500)

    def likelihood(theta):
        f, value = line_crf.Field(theta[:-2], theta[-2:]), -0.5 * float(theta @ theta)
        for doc, own, n in zip(x, y, sizes):
            weigh = lambda z: sum(doc[t] @ f.weights for t in range(n) if z[t]) + sum(f.stay[1 - int(z[t])] for t in range(n - 1) if z[t] == z[t + 1])  # noqa: E731, B023
            value += weigh(own) - math.log(sum(math.exp(weigh(z)) for z in itertools.product((0, 1), repeat=int(n))))
        return value

    theta = np.concatenate([field.weights, field.stay])
    best = likelihood(theta)
    for _ in range(40):
        assert likelihood(theta + rng.normal(size=len(theta)) * 0.05) <= best + 1e-4


def test_log_odds_beside_a_plain_version(spark):
    texts = {i: f"{'fine words' if i % 3 else 'junk words'} w{i % 5}\nTail" for i in range(40)}
    rows = spark.createDataFrame([(i, t, int(i % 3 > 0), i % 2) for i, t in texts.items()], "doc_id long, text string, label int, fold int")
    for fold, odds in zip(((0,), (1,), (0, 1)), line_crf.sample_odds(rows, 100)):
        inside = [i for i in texts if i % 2 in fold]
        n = {y: sum((i % 3 > 0) == y for i in inside) for y in (True, False)}
        for word in ("fine", "junk", "words", "tail", "w"):
            has = lambda i, word=word: word in re.findall("[a-z]+", texts[i].lower())
            k = {y: sum(has(i) for i in inside if (i % 3 > 0) == y) for y in (True, False)}
            expected = math.log((k[True] + 1) / (n[True] + 2)) - math.log((k[False] + 1) / (n[False] + 2))
            assert odds[word.encode()] == pytest.approx(max(-3, min(3, expected)))
