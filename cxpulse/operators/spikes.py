"""Explain spike days: top negative terms and sample conversations per spike day.

Spike days come from the daily table (at most one per calendar day, so the
list is bounded by the calendar, not by the data).  They are applied as an
``IN`` list on ``date`` — a predicate that reaches the Parquet scan when the
date is stored — in one pass for all spike days together.  Per-day top-k uses
``row_number() <= k``, which Spark plans as a partial ``WindowGroupLimit``
before the shuffle, so a hot day ships at most k rows per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT_STOPWORDS
from ..functions.text import is_content_term, words
from ..session import materialize_table
from .anomaly import spike_dates as _spike_dates


def collect_spike_dates(daily: DataFrame, spike_col: str | None = None) -> list:
    """Spike dates as a Python list (bounded by the number of calendar days)."""
    return [r[0] for r in _spike_dates(daily, spike_col).orderBy("date").collect()]


def _negatives_on(scored: DataFrame, dates: list) -> DataFrame:
    if not dates:
        return scored.where(F.lit(False))
    return scored.where(F.col("date").isin(dates) & F.col("is_negative"))


def spike_top_terms(scored: DataFrame, dates: list, top: int = 10, stopwords=DEFAULT_STOPWORDS) -> DataFrame:
    """(date, rank, term, count): most frequent content terms among the day's negatives.

    Term frequency: a term repeated in one conversation counts every time.
    Ties are broken by term.
    """
    return _top_terms_of(_negatives_on(scored, dates), top, stopwords)


def _top_terms_of(neg: DataFrame, top: int, stopwords) -> DataFrame:
    toks = neg.select("date", F.explode(words("clean")).alias("term"))
    toks = toks.where(is_content_term("term", stopwords))
    counts = toks.groupBy("date", "term").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("date").orderBy(F.desc("count"), F.asc("term"))
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("date", F.col("rank").cast("int").alias("rank"), "term",
                         F.col("count").cast("bigint").alias("count"))


def spike_samples(scored: DataFrame, dates: list, samples: int = 5) -> DataFrame:
    """(date, rank, conversation_id, verbatim): first negatives of the day by conversation_id."""
    return _samples_of(_negatives_on(scored, dates), samples)


def _samples_of(neg: DataFrame, samples: int) -> DataFrame:
    neg = neg.select("date", "conversation_id", "verbatim")
    w = Window.partitionBy("date").orderBy(F.asc("conversation_id"), F.asc("verbatim"))
    ranked = neg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= samples)
    return ranked.select("date", F.col("rank").cast("int").alias("rank"), "conversation_id", "verbatim")


def spike_details(scored: DataFrame, daily: DataFrame, spike_col: str | None = None, top: int = 10,
                  samples: int = 5, stopwords=DEFAULT_STOPWORDS) -> DataFrame:
    """date, top_negative_terms array<struct<term,count>>, sample_verbatims array<string>.

    ``spike_col`` defaults to ``is_spike_corrected`` when the daily table has it.
    """
    dates = collect_spike_dates(daily, spike_col)
    spark = scored.sparkSession
    days = spark.createDataFrame([(d,) for d in dates], "date date")
    # one scan for the spike days' negatives, written once; terms and samples read that subset
    neg = _negatives_on(scored, dates).select("date", "conversation_id", "verbatim", "clean")
    if dates:
        neg = materialize_table(neg, "spike-negatives")
    terms = (
        _top_terms_of(neg, top, stopwords)
        .groupBy("date")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term", "count"))).alias("_t"))
    )
    samp = (
        _samples_of(neg, samples)
        .groupBy("date")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "verbatim"))).alias("_s"))
    )
    # both sides hold at most `top` / `samples` rows per spike day
    out = days.join(terms, "date", "left").join(samp, "date", "left")
    return out.select(
        "date",
        F.coalesce(F.transform("_t", lambda s: F.struct(s["term"].alias("term"), s["count"].alias("count"))),
                   F.array().cast("array<struct<term:string,count:bigint>>")).alias("top_negative_terms"),
        F.coalesce(F.transform("_s", lambda s: s["verbatim"]), F.array().cast("array<string>")).alias("sample_verbatims"),
    ).orderBy("date")
