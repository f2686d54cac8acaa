"""Batch variational topics against a plain version, and the pruned vocabulary against full counting."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from conftest import SF0001
from pyspark.sql import functions as F

from cxpulse.functions.lexicon import DEFAULT_STOPWORDS
from cxpulse.operators import topics as T
from cxpulse.operators.lda import digamma, document_weights, exp_digamma, expected_log, first_components, fit_topics
from cxpulse.operators.prepare import date_bounds, prepare
from cxpulse.plans.catalog import prepared
from cxpulse.sources.inputs import table


def plain_digamma(x):
    out = 0.0
    while x < 12:
        out -= 1 / x
        x += 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6) + 1 / (240 * x ** 8)


def plain_weights(doc, beta, k, alpha):
    """One document's weights, and theta at the end."""
    def theta(g):
        total = plain_digamma(sum(g))
        return [math.exp(plain_digamma(x) - total) for x in g]

    if not doc:
        return [alpha] * k, None
    gamma = [1.0] * k
    for _ in range(100):
        t = theta(gamma)
        new = [alpha] * k
        for w, c in doc.items():
            norm = sum(t[i] * beta[i][w] for i in range(k)) + np.finfo(float).eps
            for i in range(k):
                new[i] += t[i] * c / norm * beta[i][w]
        change = sum(abs(a - b) for a, b in zip(new, gamma)) / k
        gamma = new
        if change < 1e-3:
            break
    return gamma, theta(gamma)


def plain_lda(docs, n_terms, k, iterations, seed):
    components = first_components(k, n_terms, seed).tolist()
    alpha = 1 / k

    def exp_log(rows):
        return [[math.exp(plain_digamma(x) - plain_digamma(sum(r))) for x in r] for r in rows]

    for _ in range(iterations):
        beta, total = exp_log(components), [[0.0] * n_terms for _ in range(k)]
        for doc in docs:
            _, t = plain_weights(doc, beta, k, alpha)
            for w, c in doc.items():
                norm = sum(t[i] * beta[i][w] for i in range(k)) + np.finfo(float).eps
                for i in range(k):
                    total[i][w] += t[i] * beta[i][w] * c / norm
        components = [[alpha + x for x in r] for r in total]
    beta = exp_log(components)
    weights = [plain_weights(d, beta, k, alpha)[0] for d in docs]
    return np.array(components), np.array([[x / sum(g) for x in g] for g in weights])


def test_digamma():
    x = np.array([1e-3, 0.1, 0.5, 1.0, 2.5, 5.999, 6.0, 40.0, 1e6])
    assert np.allclose(digamma(x), [plain_digamma(v) for v in x], rtol=1e-9, atol=1e-10)
    assert np.allclose(exp_digamma(x), np.exp(digamma(x)), rtol=1e-12, atol=0)


def test_weights_of_any_length_equal_the_plain_version():
    rng = random.Random(7)
    lengths = [0, 1, 2, 7, 8, 9, 15, 16, 17, 31, 33, 90, 91, 299, 300] * 3 + [0]
    docs = [{t: float(rng.randint(1, 4)) for t in sorted(rng.sample(range(300), n))} for n in lengths]
    topics = expected_log(first_components(4, 300, 1))
    columns = (np.cumsum([0] + lengths), np.array([t for d in docs for t in d]), np.array([c for d in docs for c in d.values()]))
    expected = np.zeros(topics.shape)
    got = document_weights(*columns, topics, 0.25, 100, 1e-3, expected)
    want, total = [], np.zeros(topics.shape)
    for d in docs:
        weights, theta = plain_weights(d, topics.tolist(), 4, 0.25)
        want.append(weights)
        for w, c in d.items():
            share = np.array(theta) * topics[:, w]
            total[:, w] += share * c / share.sum()
    assert np.allclose(got, want, rtol=1e-9)
    assert np.allclose(expected * topics, total, rtol=1e-9)
    assert document_weights(np.array([0]), columns[1][:0], columns[2][:0], topics, 0.25, 100, 1e-3).shape == (0, 4)


def test_weights_are_found_in_small_blocks():
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 80, 10_000)
    columns = (np.concatenate([[0], np.cumsum(lengths)]), rng.integers(0, 500, lengths.sum()), np.ones(lengths.sum()))
    tracemalloc.start()
    document_weights(*columns, expected_log(first_components(10, 500, 1)), 0.1, 3, 1e-3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # not terms x topics of the whole batch: 32 MB an array


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_fit_equals_the_plain_version(spark, batch):
    rng = random.Random(3)
    docs = [Counter(rng.randrange(12) + (8 if i % 2 else 0) for _ in range(rng.randint(1, 30))) for i in range(60)] + [Counter(), Counter()]
    docs += docs[:3]
    rows = [(i, sorted(d), [float(d[t]) for t in sorted(d)]) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "p0 int, terms array<int>, counts array<double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        model = fit_topics(df, 20, n_topics=3, max_iter=6, seed=5)
        shares = {r["p0"]: r["p"] for r in model.transform(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    components, want = plain_lda(docs, 20, 3, 6, 5)
    assert np.allclose(model.components, components, rtol=1e-6, atol=1e-9)
    assert np.allclose([shares[i] for i in range(len(docs))], want, rtol=1e-6, atol=1e-9)
    assert model.top_terms(4) == [sorted(range(20), key=lambda t: (-c[t], t))[:4] for c in components]


def test_emerging_topics_equal_the_plain_version(spark):
    p = prepared(spark, SF0001).cache()
    day = date_bounds(p).max_date
    got = T.emerging_topics(p, day, n_topics=4, max_iter=5)
    vocab = [r["term"] for r in T.topic_vocabulary(p.select("clean")).collect()]
    number = {t: i for i, t in enumerate(vocab)}
    docs, recent = [], []
    for r in p.select("date", "clean").collect():
        toks = [t for t in r["clean"].replace("'", " ").replace("-", " ").split(" ") if len(t) >= 2 and t not in DEFAULT_STOPWORDS]
        docs.append(Counter(number[g] for g in toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])] if g in number))
        recent.append((day - r["date"]).days <= 14)
    components, shares = plain_lda(docs, len(vocab), 4, 5, T.DEFAULT_SEED)
    recent = np.array(recent)
    for r in got.collect():
        k = r["topic_id"]
        assert r["recent_weight"] == pytest.approx(shares[recent, k].mean(), abs=5.1e-5)
        assert r["history_weight"] == pytest.approx(shares[~recent, k].mean(), abs=5.1e-5)
        assert r["top_words"] == [vocab[i] for i in sorted(range(len(vocab)), key=lambda t: (-round(components[k][t], 9), t))[:10]]


def full_vocabulary(texts, max_features, min_df, max_df):
    tf, df = Counter(), Counter()
    for t in texts:
        toks = [x for x in t.replace("'", " ").replace("-", " ").split(" ") if len(x) >= 2 and x not in DEFAULT_STOPWORDS]
        grams = toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
        tf.update(grams)
        df.update(set(grams))
    kept = [g for g in tf if min_df <= df[g] <= max_df * len(texts)]
    return sorted((g, df[g], tf[g]) for g in sorted(kept, key=lambda g: (-tf[g], g))[:max_features])


@pytest.mark.parametrize("max_features,min_df", [(5, 1), (60, 2), (300, 2), (3000, 3), (10 ** 6, 1)])
@pytest.mark.parametrize("limit", [0, 100_000])
def test_pruned_vocabulary_equals_full_counting(spark, monkeypatch, max_features, min_df, limit):
    monkeypatch.setattr(T, "BROADCAST_WORDS", limit)  # both joins
    docs = prepare(table(spark, SF0001, "documents"), date_col=None, verbatim_col="text", conversation_id_col="doc_id", parser="text").cache()
    got = [tuple(r) for r in T.topic_vocabulary(docs, max_features, min_df).collect()]
    assert got == full_vocabulary([r["clean"] for r in docs.select("clean").collect()], max_features, min_df, 0.8)


def test_vocabulary_of_nothing(spark):
    none = spark.createDataFrame([], "clean string")
    assert T.topic_vocabulary(none).count() == 0
    assert T.topic_vocabulary(spark.createDataFrame([("",), ("x",)], "clean string")).count() == 0


def test_bigrams_are_pruned_before_the_shuffle(spark):
    docs = prepare(table(spark, SF0001, "documents"), date_col=None, verbatim_col="text", conversation_id_col="doc_id", parser="text")
    plan = T.topic_vocabulary(docs, 50, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan
