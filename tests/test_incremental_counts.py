"""Counts kept by a streaming query equal the batch tables, whatever way the rows arrive."""

import datetime as dt
import random

import pytest

from cxpulse.operators.prepare import prepare
from cxpulse.operators.sentiment import with_sentiment
from cxpulse.operators.terms import daily_and_term_counts, daily_part, term_part
from cxpulse.streaming.incremental import conversation_stream, counts_stream, current_counts, keep_counts

SCHEMA = "date string, conversation_id string, verbatims array<string>"
TEXTS = ["panne fibre depuis ce matin", "votre service est lamentable", "bonjour réseau", "", "ok", "arnaque pure panne"]


def _rows(seed, n=60):
    rng = random.Random(seed)
    rows = [(f"2024-01-{1 + rng.randrange(5):02d}" if i % 3 else "2024-01-03", f"c{i}" if i % 11 else None,
             [rng.choice(TEXTS), f"message {'abcdefgh'[i % 8] * 4}"]) for i in range(n)]
    return rows + [("no date", "bad", ["panne"]), (None, "none", ["panne"]), ("2024-01-02", "null", None)]


def _write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _run(spark, base, within=None):
    stream = conversation_stream(spark, f"{base}/in", SCHEMA, max_files_per_trigger=2)
    q = keep_counts(counts_stream(stream, within=within), f"{base}/out", f"{base}/check", trigger_once=True)
    assert q.awaitTermination(120) and q.exception() is None
    return current_counts(spark, f"{base}/out")


def _table(df):
    return {(r[0], r[1]): tuple(round(v, 9) if isinstance(v, float) else v for v in r[2:]) for r in df.collect()}


def _unique(rows):
    seen, out = set(), []
    for r in rows:
        key = r[1] or (r[0], str(r[2]))
        if key not in seen:
            seen.add(key)
            out.append(r)
    return out


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_with_repeats_and_late_rows_equals_batch(spark, tmp_path, seed):
    rng, rows, base = random.Random(seed), _rows(seed), str(tmp_path)
    arriving = rows + rng.sample(rows, 25)
    rng.shuffle(arriving)
    half = len(arriving) // 2
    for a in range(0, half, 13):
        _write(spark, arriving[a:min(a + 13, half)], f"{base}/in")
    _run(spark, base)
    _write(spark, arriving[half:] + arriving[:5], f"{base}/in")  # a restart, with files already seen in it
    got = _run(spark, base)
    scored = with_sentiment(prepare(spark.createDataFrame(_unique(rows), SCHEMA)))
    want = daily_and_term_counts(scored)
    assert _table(got) == _table(want)
    assert _table(term_part(got)) == _table(term_part(want))
    assert {r.date: r.total_conversations for r in daily_part(got).collect()} == {
        r.date: r.total_conversations for r in daily_part(want).collect()}


def test_bounded_ids_drop_what_comes_later(spark, tmp_path):
    base = str(tmp_path)
    day = "2024-01-01"
    _write(spark, [(day, "a", ["panne fibre"]), (day, "a", ["panne fibre"])], f"{base}/in")
    _run(spark, base, "10 days")
    _write(spark, [("2024-03-01", "b", ["panne fibre"])], f"{base}/in")
    _run(spark, base, "10 days")
    _write(spark, [(day, "late", ["panne fibre"]), ("2024-02-25", "c", ["panne fibre"])], f"{base}/in")
    got = {r.date: r["count"] for r in _run(spark, base, "10 days").where("term is null").collect()}
    assert got == {dt.date(2024, 1, 1): 1, dt.date(2024, 3, 1): 1, dt.date(2024, 2, 25): 1}


def test_a_batch_run_again_counts_once(spark, tmp_path):
    base = str(tmp_path)
    rows = [(dt.date(2024, 1, 1), None, 3, 1, 0.5, 0)]
    schema = "date date, term string, count long, negative_count long, score_sum double, ambiguous_count long"
    for _ in range(2):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{base}/batch=0")
    spark.createDataFrame([(dt.date(2024, 1, 1), None, 5, 2, 0.75, 0)], schema).write.parquet(f"{base}/batch=10")
    assert [tuple(r)[2:4] for r in current_counts(spark, base).collect()] == [(5, 2)]
