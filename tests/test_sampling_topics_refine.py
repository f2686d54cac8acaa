"""Exact sampling vs brute force, LDA invariants, model refinement."""

import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from cxpulse.operators import sampling as S
from cxpulse.operators.prepare import date_bounds
from cxpulse.operators.refine import ambiguous_sample, label_sample, length_stars_scorer, recovery_stats, refine_daily
from cxpulse.operators.anomaly import daily_spikes
from cxpulse.operators.topics import emerging_topics, topic_sample, topic_vocabulary
from cxpulse.plans import catalog as C


def _brute(ids, n, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))[:n]


@pytest.fixture(scope="module")
def ids_df(spark):
    return spark.range(5000).select(F.format_string("id_%05d", "id").alias("k"), (F.col("id") % 3 == 0).alias("seg"))


@pytest.mark.parametrize("n", [0, 1, 37, 1000, 5000, 6000])
def test_exact_sample_equals_brute_force(spark, ids_df, n):
    ids = [r.k for r in ids_df.collect()]
    got = S.exact_sample(ids_df, {None: n}, ["k"]).orderBy("sample_rank").collect()
    assert [r.k for r in got] == _brute(ids, n)
    assert [r.sample_rank for r in got] == list(range(1, len(got) + 1))


def test_exact_sample_per_segment(spark, ids_df):
    rows = ids_df.collect()
    segs = {True: [r.k for r in rows if r.seg], False: [r.k for r in rows if not r.seg]}
    sizes = {True: 100, False: 250}
    got = S.exact_sample(ids_df, sizes, ["k"], segment_col="seg").collect()
    for s in (True, False):
        mine = [r.k for r in sorted((r for r in got if r.seg == s), key=lambda r: r.sample_rank)]
        assert mine == _brute(segs[s], sizes[s])


def test_segment_without_limit_is_taken_whole(spark, ids_df):
    got = S.exact_sample(ids_df, {True: None, False: 5}, ["k"], segment_col="seg").groupBy("seg").count().collect()
    assert {r.seg: r["count"] for r in got} == {True: ids_df.where("seg").count(), False: 5}


def test_seeds_give_different_samples(spark, ids_df):
    a, b = ({r.k for r in S.exact_sample(ids_df, {None: 50}, ["k"], seed=s).collect()} for s in (1, 999))
    assert a != b and len(a) == len(b) == 50
    s = C.scored(spark, SF0001)
    x, y = ({r.conversation_id for r in ambiguous_sample(s, 50, seed=k).collect()} for k in (1, 999))
    assert x != y and len(x) == len(y) == 50


def test_null_and_repeated_ids(spark):
    rows = [(None, i) for i in range(3000)] + [("same", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int")
    first = sorted((r.k or "", r.v) for r in S.exact_sample(df, {None: 100}, ["k"]).collect())
    again = sorted((r.k or "", r.v) for r in S.exact_sample(df.repartition(7), {None: 100}, ["k"]).collect())
    assert len(first) == 100 and first == again
    everything = S.exact_sample(df, {None: 10_000}, ["k"]).collect()
    assert sorted(r.sample_rank for r in everything) == list(range(1, 3501))


@pytest.mark.parametrize("n", [50_000, 200_000])
def test_no_single_task_ranks_the_sample(spark, ids_df, n):
    plan = S.exact_sample(ids_df, {None: n}, ["k"], materialized=False)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    # the only single task sums the counts of the hash bins (65 536 rows at most); rows are ranked bin by bin
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "HashAggregate(keys=[" in lines[i + 1] and "_bin" in lines[i + 1]


def test_topic_sample_sizes():
    assert S.topic_sample_sizes(5000, 5000, None) == (5000, 5000)
    assert S.topic_sample_sizes(5000, 5000, 200_000) == (5000, 5000)
    assert S.topic_sample_sizes(5000, 7000, 10_000) == (5000, 5000)  # history takes what recent leaves
    assert S.topic_sample_sizes(9000, 1000, 9500, min_recent=100) == (8550, 950)
    assert S.topic_sample_sizes(5000, 5000, 2_000) == (2000, 0)
    assert S.topic_sample_sizes(50, 5000, 2_000, min_recent=100) == (50, 1950)
    assert S.topic_sample_sizes(0, 0, 100) == (0, 0)


@pytest.fixture(scope="module")
def topics(spark):
    p = C.prepared(spark, SF0001)
    b = date_bounds(p)
    return emerging_topics(p, b.max_date).collect(), topic_sample(p, b.max_date)


def test_lda_invariants(topics):
    rows, sample = topics
    assert len(rows) == 10
    assert sorted(r.topic_id for r in rows) == list(range(10))
    ratios = [r.emergence_ratio for r in rows]
    assert ratios == sorted(ratios, reverse=True)
    assert sum(r.recent_weight for r in rows) == pytest.approx(1.0, abs=2e-3)
    assert sum(r.history_weight for r in rows) == pytest.approx(1.0, abs=2e-3)
    for r in rows:
        assert len(r.top_words) == 10
        assert r.is_emerging == (r.emergence_ratio > 1.5)
        if r.history_weight > 0.001:
            assert r.emergence_ratio == pytest.approx(r.recent_weight / r.history_weight, abs=0.02)


def test_vocabulary_limits(topics):
    _, sample = topics
    n = sample.count()
    voc = topic_vocabulary(sample, max_features=50).collect()
    assert len(voc) == 50
    assert all(10 <= r.doc_freq <= 0.8 * n for r in voc)
    assert [r.term for r in voc] == sorted(r.term for r in voc)


def test_recovery_and_correction(spark):
    s = C.scored(spark, SF0001)
    stats = recovery_stats(s).first()
    amb = s.where("neg_score > 0.01 and neg_score <= 0.3").select("clean").collect()
    labels = length_stars_scorer()([r.clean for r in amb])
    recovered = sum(1 for lab in labels if int(lab.split()[0]) <= 2)
    assert (stats.n_ambiguous_total, stats.n_sampled, stats.n_recovered) == (297, 297, recovered)
    assert stats.recovery_rate == pytest.approx(recovered / 297)
    daily, st = refine_daily(s, daily_spikes(s))
    rows = daily.collect()
    assert sum(r.ambiguous_count for r in rows) == 297
    for r in rows:
        assert r.negative_count_corrected == r.negative_count + round(r.ambiguous_count * stats.recovery_rate)
    assert st.first().n_recovered == recovered


def test_recovery_with_empty_band(spark):
    s = C.scored(spark, SF0001)
    stats = recovery_stats(s, low=2.0, high=3.0).first()
    assert (stats.n_ambiguous_total, stats.n_sampled, stats.n_recovered, stats.recovery_rate) == (0, 0, 0, 0.0)


def test_model_sees_whole_texts(spark):
    df = spark.createDataFrame([("x" * 1203,), ("y" * 7,)], "clean string")
    got = {r.clean[0]: r.model_label for r in label_sample(df).collect()}
    assert got == {"x": "4 stars", "y": "3 stars"}
    cut = label_sample(df, max_chars=500).where("clean like 'x%'").first()
    assert cut.model_label == "1 star"


def test_weights_use_every_conversation(spark):
    p = C.prepared(spark, SF0001)
    b = date_bounds(p)
    rows = emerging_topics(p, b.max_date, sample_size=300, n_topics=3, min_df=2).collect()
    assert sum(r.history_weight for r in rows) == pytest.approx(1.0, abs=2e-3)
    assert sum(r.recent_weight for r in rows) == pytest.approx(1.0, abs=2e-3)
