"""Hot keys: one day with a third of all conversations, one term in every conversation."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from cxpulse.operators.anomaly import daily_sentiment
from cxpulse.operators.examples import term_examples
from cxpulse.operators.prepare import prepare
from cxpulse.operators.sentiment import with_sentiment
from cxpulse.operators.spikes import spike_samples, spike_top_terms
from cxpulse.operators.terms import term_daily_counts
from cxpulse.sources.fixtures import conversations_from_events
from cxpulse.sources.inputs import table

HOT_DAY = dt.date(2024, 1, 15)


@pytest.fixture(scope="module")
def skewed(spark):
    ev = table(spark, SF001, "events")
    # every third event moves to the hot day; every conversation mentions "fibre"
    ev = ev.withColumn("ts", F.when(F.col("event_id") % 3 == 0, F.lit(dt.datetime(2024, 1, 15, 12, 0)))
                       .otherwise(F.col("ts")))
    conv = conversations_from_events(ev).withColumn(
        "verbatims", F.concat(F.col("verbatims"), F.array(F.lit("la fibre encore"))))
    s = with_sentiment(prepare(conv)).cache()
    return s, s.select("date", "conversation_id", "clean", "verbatim", "is_negative").toPandas()


def test_daily_counts_match_brute_force(skewed):
    s, pdf = skewed
    got = {r.date: (r.total_conversations, r.negative_count) for r in daily_sentiment(s).collect()}
    want = pdf.groupby("date").agg(n=("conversation_id", "size"), neg=("is_negative", "sum"))
    assert got == {d: (int(r.n), int(r.neg)) for d, r in want.iterrows()}
    assert got[HOT_DAY][0] > 0.33 * len(pdf)


def test_hot_term_counts_match_brute_force(skewed):
    s, pdf = skewed
    counts = {(r.date, r.term): r["count"] for r in term_daily_counts(s).where("term = 'fibre'").collect()}
    want = pdf.assign(has=pdf.clean.str.split(" ").map(lambda ws: "fibre" in ws)).groupby("date").has.sum()
    assert counts == {(d, "fibre"): int(v) for d, v in want.items() if v}


def test_hot_groups_are_limited_on_the_map_side(skewed):
    s, pdf = skewed
    samples = spike_samples(s, [HOT_DAY], samples=5)
    plan = samples._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    got = [r.conversation_id for r in samples.orderBy("rank").collect()]
    neg = pdf[(pdf.date == HOT_DAY) & pdf.is_negative].sort_values(["conversation_id", "verbatim"])
    assert got == list(neg.conversation_id[:5])
    top = spike_top_terms(s, [HOT_DAY]).orderBy("rank").collect()
    assert top[0].term == "fibre" and top[0]["count"] == int(((pdf.date == HOT_DAY) & pdf.is_negative).sum())
    terms = s.sparkSession.createDataFrame([("fibre",)], "term string")
    ex = term_examples(s, terms, n=3).orderBy("rn").collect()
    newest = pdf.sort_values(["date", "conversation_id"], ascending=[False, True]).conversation_id[:3]
    assert [r.conversation_id for r in ex] == list(newest)
