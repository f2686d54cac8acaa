"""Topic model: batch variational inference of latent Dirichlet allocation.

Documents are rows (terms array<int>, counts array<double>).  One iteration is
one Spark job: every Arrow batch finds its documents' topic weights by the
fixed point of the variational bound (each document until its own change is
below ``tolerance``, so the result depends on how rows are batched only by the
order of sums), and leaves its share of the expected topic-term counts, one row per term; a
partial aggregation sums them.  The driver holds topics x vocabulary, no more.
The start is deterministic: a seeded draw for the topics, equal weights for
the documents.  Python runs as numpy over whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

TINY = np.finfo(np.float64).eps
BLOCK = 1 << 18  # (topic, term, document) cells worked on at once: 2 MB


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function, for positive arguments."""
    below = sum(1.0 / (x + i) for i in range(6))  # the recurrence, up to where the series is exact
    x = x + 6.0
    r = 1.0 / (x * x)
    return np.log(x) - below - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132)))))


def expected_log(weights: np.ndarray) -> np.ndarray:
    """exp E[log p] of the Dirichlet distributions in the rows of ``weights``."""
    return np.exp(digamma(weights) - digamma(weights.sum(1))[:, None])


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)): as `digamma`, with the recurrence's terms in pairs (two divisions) and its logarithm left as a factor."""
    a = x * (x + 5.0)  # x + i and x + 5 - i multiply to a, a + 4 and a + 6
    b, c = a + 4.0, a + 6.0
    bc = b * c
    below = (2.0 * x + 5.0) * (bc + a * (b + c)) / (a * bc)
    x = x + 6.0
    s = 1.0 / x
    r = s * s
    return x * np.exp(-below - 0.5 * s - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132))))))


def _by_length(size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, documents of at most that many terms, by more than an eighth fewer only up to 8 terms); without empty documents."""
    step = 1 << np.maximum(np.ceil(np.log2(np.maximum(size, 1) / 8)).astype(np.int64), 0)
    length = -(-size // step) * step
    order = np.argsort(length, kind="stable")
    order = order[np.count_nonzero(length == 0):]
    edges = np.flatnonzero(np.diff(length[order], prepend=0, append=0))
    for first, end in zip(edges[:-1], edges[1:]):
        yield int(length[order[first]]), order[first:end]


def _fixed_point(beta: np.ndarray, counts: np.ndarray, alpha: float, max_steps: int,
                 tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights k x m, theta k x m, ratios s x m) of m documents of s terms each: ``beta`` k x s x m, ``counts`` s x m.

    A ratio is a term's count over its expected share; a document that has converged keeps its weights, and those that
    have are left out of the arrays whenever they make up a tenth.
    """
    def step(w, b, c):
        theta = exp_digamma(w) / exp_digamma(w.sum(0))
        return theta, c / (np.einsum("km,ksm->sm", theta, b) + TINY)

    k, _, m = beta.shape
    weights, w = np.ones((k, m)), np.ones((k, m))
    b, c, at, done = beta, counts, np.arange(m), np.zeros(m, bool)
    for _ in range(max_steps):
        theta, ratio = step(w, b, c)
        new = alpha + theta * np.einsum("sm,ksm->km", ratio, b)
        ends = ~done & (np.abs(new - w).sum(0) / k < tolerance)
        w = new
        if ends.any():
            weights[:, at[ends]] = w[:, ends]
            done |= ends
            keep = np.flatnonzero(~done)
            if not len(keep):
                break
            if len(keep) <= 0.9 * len(done):
                w, b, c, at, done = w[:, keep], b[:, :, keep], c[:, keep], at[keep], np.zeros(len(keep), bool)
    weights[:, at[~done]] = w[:, ~done]
    return weights, *step(weights, beta, counts)


def document_weights(starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, topics: np.ndarray, alpha: float,
                     max_steps: int, tolerance: float, expected: np.ndarray | None = None) -> np.ndarray:
    """Weights n x k: documents are runs of (terms, counts) between ``starts``; ``topics``: k x terms.

    To ``expected`` (k x terms) are added the expected counts of every (topic, term), to be multiplied by ``topics``.
    Documents of like length are worked on together, in blocks that stay in the processor's cache, with the documents
    innermost; shorter ones are filled up with counts of 0, which add nothing.  An empty document keeps the prior.
    """
    k, size = len(topics), np.diff(starts)
    weights = np.full((len(size), k), alpha)
    for length, docs in _by_length(size):
        many = max(BLOCK // (length * k), 16)
        for block in (docs[i:i + many] for i in range(0, len(docs), many)):
            place = np.arange(length)[:, None]
            filled = place < size[block]
            cell = np.where(filled, starts[block] + place, starts[block])
            term, count = terms[cell], np.where(filled, counts[cell], 0.0)
            found, theta, ratio = _fixed_point(topics[:, term], count, alpha, max_steps, tolerance)
            weights[block] = found.T
            if expected is not None:
                for i in range(k):
                    expected[i] += np.bincount(term.reshape(-1), (theta[i] * ratio).reshape(-1), expected.shape[1])
    return weights


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    terms, counts = batch.column("terms"), batch.column("counts")
    size = terms.value_lengths().to_numpy(zero_copy_only=False)
    return (np.concatenate([[0], np.cumsum(size)]).astype(np.int64), terms.flatten().to_numpy().astype(np.int64),
            counts.flatten().to_numpy().astype(np.float64))


@dataclass(frozen=True)
class TopicModel:
    """``components``: topics x terms, the parameters of the topics' distributions over the vocabulary."""

    components: np.ndarray
    alpha: float
    max_steps: int
    tolerance: float

    def top_terms(self, n: int = 10) -> list[list[int]]:
        """Per topic the ``n`` heaviest terms, equal ones (to 9 decimals: sums may come in any order) by index."""
        return [np.lexsort((np.arange(len(c)), -np.round(c, 9)))[:n].tolist() for c in self.components]

    def transform(self, docs: DataFrame, out: str = "p") -> DataFrame:
        """``docs`` (terms, counts, others) -> the others and the topic shares ``out`` (array<double>, sum 1)."""
        others = [c for c in docs.columns if c not in ("terms", "counts")]
        schema = docs.select(others).schema.add(out, T.ArrayType(T.DoubleType()))
        topics, alpha, max_steps, tolerance = expected_log(self.components), self.alpha, self.max_steps, self.tolerance

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                weights = document_weights(*_columns(batch), topics, alpha, max_steps, tolerance)
                shares = (weights / weights.sum(1, keepdims=True)).reshape(-1)
                ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * weights.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.ListArray.from_arrays(ends, pa.array(shares))],
                                                 names=others + [out])

        ship_package(docs.sparkSession)
        return docs.mapInArrow(work, schema)


def first_components(n_topics: int, n_terms: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).gamma(100.0, 0.01, (n_topics, n_terms))


def fit_topics(docs: DataFrame, n_terms: int, n_topics: int = 10, max_iter: int = 15, seed: int = 42,
               alpha: float | None = None, eta: float | None = None, max_steps: int = 100, tolerance: float = 1e-3) -> TopicModel:
    """Fit on all rows of ``docs`` (terms array<int> below ``n_terms``, counts array<double>), which should be stored:
    every iteration reads them once.  Priors are 1 / ``n_topics`` unless given; a table without terms leaves the start."""
    ship_package(docs.sparkSession)
    alpha = 1.0 / n_topics if alpha is None else alpha
    eta = 1.0 / n_topics if eta is None else eta
    components = first_components(n_topics, n_terms, seed)
    rows = docs.select("terms", "counts").where(F.size("terms") > 0)
    names = [f"t{i}" for i in range(n_topics)]
    for _ in range(max_iter):
        topics = expected_log(components)

        def work(batches: Iterator[pa.RecordBatch], topics=topics) -> Iterator[pa.RecordBatch]:
            total = np.zeros(topics.shape)
            for batch in batches:
                document_weights(*_columns(batch), topics, alpha, max_steps, tolerance, total)
            total *= topics
            used = np.flatnonzero(total.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32))] + [pa.array(t[used]) for t in total],
                                             names=["term", *names])

        partial = rows.mapInArrow(work, "term int, " + ", ".join(f"{x} double" for x in names))
        counted = np.zeros((n_terms, n_topics))
        for r in partial.groupBy("term").agg(*[F.sum(x).alias(x) for x in names]).collect():  # topics x vocabulary
            counted[r["term"]] = r[1:]
        components = eta + counted.T
    return TopicModel(components, alpha, max_steps, tolerance)
