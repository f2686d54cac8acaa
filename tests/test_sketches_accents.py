"""Misra-Gries summaries against exact counts; composed and decomposed accents."""

import datetime as dt
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from cxpulse.functions.text import clean_text, compose_accents
from cxpulse.operators.prepare import prepare
from cxpulse.operators.sketches import Summary, bounds, heavy_hitters, merge, summarise, window_heavy_hitters, windows_of
from cxpulse.operators.terms import term_daily_counts
from cxpulse.sources.inputs import table


def _rows(seed, n=3000):
    rng = random.Random(seed)
    day = dt.date(2024, 1, 1)
    out = []
    for i in range(n):
        values = [f"v{min(int(rng.paretovariate(0.7)), 5000)}" for _ in range(rng.randrange(6))]
        # a third of all rows on one day, one value in all of them; nulls among the elements
        d = day + dt.timedelta(days=4 if i % 3 == 0 else rng.randrange(12))
        out.append((d, values + (["hot"] if i % 3 == 0 else [None] if i % 7 == 0 else [])))
    return out + [(None, ["lost"] * 50), (day, None), (day, [])]


@pytest.fixture(scope="module")
def dated(spark):
    rows = _rows(5)
    return spark.createDataFrame(rows, "date date, terms array<string>").repartition(7), rows


def _exact(rows):
    counts: dict = {}
    for d, values in rows:
        counts.setdefault(d, Counter()).update(v for v in values or [] if v is not None)
    return counts


@pytest.mark.parametrize("k", [1, 5, 40])
def test_summary_keeps_its_bound(k):
    rng, s, exact = random.Random(k), Summary(k), Counter()
    for _ in range(400):
        values = [rng.choice("abcdefgh") if rng.random() < 0.5 else str(rng.randrange(900)) for _ in range(9)]
        s.add(values)
        exact.update(values)
    s.cut()
    assert len(s.counts) <= k and s.total == exact.total()
    assert s.error * (k + 1) <= s.total - s.counts.total()
    assert all(s.counts[v] <= n <= s.counts[v] + s.error for v, n in exact.items())


@pytest.mark.parametrize("k", [3, 100000])
def test_merged_summaries_bound_every_count(spark, dated, k):
    df, rows = dated
    exact = _exact(rows)
    daily = summarise(df.where("date is not null"), "date", "terms", k).cache()
    for days in (1, 5):
        got = bounds(merge(windows_of(daily, days), k)).collect()
        for end in {d for d in exact if d}:
            want = Counter()
            for back in range(days):
                want.update(exact.get(end - dt.timedelta(days=back), {}))
            mine = {r.value: (r.low, r.high, r.total) for r in got if r.grp == str(end)}
            assert len(mine) <= k
            assert all(low <= want[v] <= high and total == want.total() for v, (low, high, total) in mine.items())
            assert {v for v, n in want.items() if n * (k + 1) > want.total()} <= set(mine)
            if k == 100000:
                assert {v: (n, n, want.total()) for v, n in want.items()} == mine


@pytest.mark.parametrize("days,k", [(1, 8), (5, 12)])
def test_window_heavy_hitters_equal_brute_force(spark, dated, days, k):
    df, rows = dated
    exact, want = _exact(rows), set()
    ends = [d for d in exact if d]
    end = min(ends)
    while end <= max(ends):
        counts = Counter()
        for back in range(days):
            counts.update(exact.get(end - dt.timedelta(days=back), {}))
        want |= {(end, v, n, counts.total()) for v, n in counts.items() if n * (k + 1) > counts.total()}
        end += dt.timedelta(days=1)
    got = [tuple(r) for r in window_heavy_hitters(df, "date", "terms", days, k).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_heavy_hitters_by_group_with_nulls_and_ties(spark):
    rows = [(None, ["a", "b"]), (None, ["a", "b"]), ("x", ["c"]), ("x", [None, "c", "d", "e", "f"]), ("y", None), ("", [""])]
    df = spark.createDataFrame(rows, "g string, v array<string>")
    got = sorted(("-" if r.grp is None else r.grp, r.value, r["count"], r.total) for r in heavy_hitters(df, "g", "v", 2).collect())
    assert got == [("", "", 1, 1), ("-", "a", 2, 4), ("-", "b", 2, 4), ("x", "c", 2, 5)]
    assert heavy_hitters(df.limit(0), "g", "v", 2).count() == 0
    with pytest.raises(ValueError):
        summarise(df, "g", "v", 0)


def test_only_k_counters_a_task_and_group_are_shuffled(spark, dated):
    plan = summarise(dated[0], "date", "terms", 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "WindowGroupLimit" in plan
    assert plan.index("MapInArrow") > plan.index("Exchange hashpartitioning(grp")


def test_decomposed_texts_clean_to_the_same_terms(spark):
    docs = table(spark, SF0001, "documents").select("doc_id", "text")
    extra = ["été ÇA où l'œuvre Æ naïve", "señor ḉ x́ ậ ệ", "", None, "é" * 5000]
    extra = [t and unicodedata.normalize("NFC", t) for t in extra]
    docs = docs.unionByName(spark.createDataFrame(list(enumerate(extra, 10 ** 9)), "doc_id long, text string"))
    rows = [(r.doc_id, r.text and unicodedata.normalize("NFD", r.text)) for r in docs.collect()]
    split = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.c for r in docs.select("doc_id", clean_text("text").alias("c")).collect()}
    got = {r.doc_id: r.c for r in split.select("doc_id", clean_text(compose_accents("text")).alias("c")).collect()}
    assert got == want
    assert got[10 ** 9].startswith("été ça où l'œuvre æ naïve") and got[10 ** 9 + 3] is None
    off = split.select("doc_id", clean_text("text").alias("c")).where(f"doc_id = {10 ** 9}").first().c
    assert off.startswith("e te")


def test_prepare_composes_on_request(spark):
    df = spark.createDataFrame([("1", ["été"]), ("2", ["́́"])], "conversation_id string, verbatims array<string>")
    got = {r.conversation_id: (r.verbatim, r.clean) for r in prepare(df, date_col=None, compose=True).collect()}
    assert got == {"1": ("été", "été")}


def test_folded_terms(spark):
    day = dt.date(2024, 1, 1)
    rows = [(day, "débit réseau debit"), (day, "debit panne été"), (day, "reseau"), (dt.date(2024, 1, 2), "débit")]
    df = spark.createDataFrame(rows, "date date, clean string")
    got = {(r.date.day, r.term): r["count"] for r in term_daily_counts(df, fold=True).collect()}
    assert got == {(1, "debit"): 2, (1, "reseau"): 2, (1, "panne"): 1, (2, "debit"): 1}  # "été" is a stop word
    plain = {(r.date.day, r.term): r["count"] for r in term_daily_counts(df).collect()}
    assert plain[(1, "débit")] == 1 and plain[(1, "debit")] == 2 and plain[(2, "débit")] == 1
    assert term_daily_counts(df.where(F.lit(False)), fold=True).count() == 0
