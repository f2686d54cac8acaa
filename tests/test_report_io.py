"""Full report, sinks, CSV source and the streaming form of the daily counts."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from cxpulse.operators.anomaly import daily_sentiment
from cxpulse.operators.prepare import prepare
from cxpulse.operators.refine import length_stars_scorer
from cxpulse.operators.sentiment import with_sentiment
from cxpulse.plans import catalog as C
from cxpulse.plans.report import Params, full_report
from cxpulse.plans.sinks import write_report
from cxpulse.sources.inputs import read_csv
from cxpulse.streaming.incremental import daily_counts_stream, finish_daily, start


@pytest.fixture(scope="module")
def report(spark):
    conv = C.fixture(spark, SF0001, form="python")
    return full_report(conv, params=Params(use_model=True, lda_sample_size=50_000),
                       scorer_factory=length_stars_scorer)


def test_report_contents(report):
    expected = {"daily_stats", "refine_stats", "spike_details", "topics", "trending_terms", "novel_terms",
                "trending_examples", "novel_examples", "summary", "dashboard_daily", "dashboard_spikes",
                "dashboard_trending", "dashboard_novel"}
    assert set(report) == expected
    daily = report["daily_stats"]
    assert {"negative_count_corrected", "is_spike_corrected", "ambiguous_count"} <= set(daily.columns)
    assert daily.count() == 30
    summary = {r.metric: r.value for r in report["summary"].collect()}
    assert summary["total_conversations"] == "1000"
    assert summary["period"] == "2024-01-01 -> 2024-01-30"
    assert int(summary["trending_terms"]) == report["trending_terms"].count() == 17
    assert int(summary["negative_spikes"]) == report["spike_details"].count()
    totals = report["refine_stats"].first()
    assert int(summary["negative_conversations"]) == totals.negatives_before == 163
    assert int(summary["negative_conversations_corrected"]) == totals.negatives_after
    assert summary["negative_share_pct"] == "16.30"
    assert report["topics"].count() == 10
    ex = report["trending_examples"]
    assert ex.groupBy("term").count().where("count > 20").count() == 0
    assert report["dashboard_trending"].count() == 15
    assert set(report["dashboard_daily"].columns) >= {"is_spike", "is_spike_corrected"}


def test_write_report(report, tmp_path):
    small = {k: report[k] for k in ("summary", "spike_details", "trending_terms")}
    for fmt in ("parquet", "csv", "json"):
        base = os.path.join(str(tmp_path), fmt)
        assert write_report(small, base, fmt) == list(small)
    spark = report["summary"].sparkSession
    back = spark.read.parquet(os.path.join(str(tmp_path), "parquet", "spike_details"))
    assert back.count() == report["spike_details"].count()
    csv = spark.read.option("header", "true").csv(os.path.join(str(tmp_path), "csv", "spike_details"))
    assert csv.count() == report["spike_details"].count()


def test_csv_source_matches_array_input(spark, tmp_path):
    conv = C.fixture(spark, SF0001, form="python")
    path = os.path.join(str(tmp_path), "conv_csv")
    conv.write.option("header", "true").option("escape", '"').csv(path)
    from_csv = prepare(read_csv(spark, path)).select("conversation_id", "clean", "n_messages")
    from_arr = C.prepared(spark, SF0001).select("conversation_id", "clean", "n_messages")
    assert from_csv.exceptAll(from_arr).count() == 0 and from_arr.exceptAll(from_csv).count() == 0


def test_streaming_daily_counts_equal_batch(spark, tmp_path):
    conv = C.fixture(spark, SF0001)
    src = os.path.join(str(tmp_path), "stream_src")
    conv.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(conv.schema).option("maxFilesPerTrigger", "1").parquet(src)
    got = {}

    def on_batch(df, epoch):  # the days this batch changed
        got.update({r.date: r for r in finish_daily(df).collect()})

    q = start(daily_counts_stream(stream), on_batch, os.path.join(str(tmp_path), "ckpt"), trigger_once=True)
    q.awaitTermination(120)
    batch = {r.date: r for r in daily_sentiment(with_sentiment(C.prepared(spark, SF0001))).collect()}
    assert set(got) == set(batch)
    for d, r in got.items():
        assert (r.total_conversations, r.negative_count) == (batch[d].total_conversations, batch[d].negative_count)
        assert r.mean_neg_score == pytest.approx(batch[d].mean_neg_score)


def test_report_on_empty_input_keeps_schemas(spark):
    conv = C.fixture(spark, SF0001).where("date > '2030-01-01'")
    rep = full_report(conv, with_topics=True)
    assert rep["daily_stats"].count() == 0 and rep["trending_terms"].count() == 0
    assert rep["novel_terms"].columns == ["term", "recent_count", "recent_daily_avg", "history_total",
                                          "history_daily_avg", "novelty"]
    assert rep["topics"].count() == 0 and rep["spike_details"].count() == 0
    assert {r.metric: r.value for r in rep["summary"].collect()}["total_conversations"] == "0"


def test_cleanup_removes_intermediate_tables(spark):
    from cxpulse.session import scratch_tables

    with full_report(C.fixture(spark, SF0001), with_topics=False, with_examples=False) as rep:
        tables = list(rep.tables)
        assert len(tables) >= 2 and all(os.path.isdir(t.removeprefix("file:")) for t in tables)
        assert rep["daily_stats"].count() == 30
    assert not any(os.path.exists(t.removeprefix("file:")) for t in tables)
    assert not set(tables) & set(scratch_tables(spark))
