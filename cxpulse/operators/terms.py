"""Term statistics: document frequency per day, trending terms, novel terms.

All three rest on one aggregation, ``term_daily_counts``: explode the distinct
content terms of each conversation and count them per (date, term).  The
aggregation is partial on every map task (a hot term or a hot day is reduced
locally before the shuffle), and its output — one row per (day, term) — is
what trending and novel read; both are then a single ``groupBy(term)`` with
conditional sums (no self-join), followed by a top-k (``TakeOrderedAndProject``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT_STOPWORDS
from ..functions.text import fold_accents, is_content_term, words

BASELINE_DAYS = 30
MIN_BASELINE = 0.5
NO_BASELINE_FACTOR = 10.0
MIN_CURRENT = 2.0


def term_daily_counts(prepared: DataFrame, stopwords=DEFAULT_STOPWORDS, fold: bool = False) -> DataFrame:
    """(date, term, count): number of conversations of that day containing the term.

    A term is a whitespace token of ``clean`` that is not a stop word and has
    more than 2 characters; it counts once per conversation.  With ``fold`` terms that differ in accents alone
    are one, named by the form without them (stop words are told by their own form).
    """
    if fold:
        kept = F.filter(words("clean"), lambda t: is_content_term(t, stopwords))
        folded = prepared.select("date", F.explode(F.array_distinct(F.transform(kept, fold_accents))).alias("term"))
        return folded.groupBy("date", "term").agg(F.count(F.lit(1)).alias("count"))
    # explode the distinct tokens, then keep content terms with a row filter
    # (generated code) rather than a per-element lambda before the explode
    exploded = prepared.select("date", F.explode(F.array_distinct(words("clean"))).alias("term"))
    exploded = exploded.where(is_content_term("term", stopwords))
    return exploded.groupBy("date", "term").agg(F.count(F.lit(1)).alias("count"))


def daily_and_term_counts(scored: DataFrame, ambiguous_band: tuple | None = None,
                          exclude_negative: bool = False, stopwords=DEFAULT_STOPWORDS) -> DataFrame:
    """Daily statistics and (date, term) document frequencies from ONE pass.

    Every conversation emits one marker row (term = null) carrying its score
    and flags, plus one row per distinct content term; a single aggregation by
    (date, term) then yields both results (split them with ``daily_part`` and
    ``term_part``).  Partial aggregation keeps one marker row per day and map
    task, so the day rows never concentrate on a reducer.
    """
    from .anomaly import ambiguous_condition

    amb = ambiguous_condition(*ambiguous_band, exclude_negative) if ambiguous_band else F.lit(False)
    # null first element = the conversation's own (marker) row
    tokens = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(words("clean")))
    rows = scored.select("date", F.col("neg_score").alias("_score"), F.col("is_negative").alias("_neg"),
                         amb.alias("_amb"), F.explode(tokens).alias("term"))
    rows = rows.where(F.col("term").isNull() | is_content_term("term", stopwords))
    marker = F.col("term").isNull()
    return rows.groupBy("date", "term").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(marker & F.col("_neg")).alias("negative_count"),
        F.sum(F.when(marker, F.col("_score"))).alias("score_sum"),
        F.count_if(marker & F.col("_amb")).alias("ambiguous_count"),
    )


def daily_part(combined: DataFrame, with_ambiguous: bool = False) -> DataFrame:
    """The ``daily_sentiment`` table out of ``daily_and_term_counts``."""
    cols = [
        "date",
        F.col("count").alias("total_conversations"),
        "negative_count",
        (F.col("score_sum") / F.col("count").cast("double")).alias("mean_neg_score"),
        (F.col("negative_count").cast("double") / F.col("count").cast("double")).alias("negative_ratio"),
    ]
    if with_ambiguous:
        cols.append("ambiguous_count")
    return _part(combined, True).select(*cols)


def term_part(combined: DataFrame) -> DataFrame:
    """The ``term_daily_counts`` table out of ``daily_and_term_counts``."""
    return _part(combined, False).select("date", "term", "count")


def _part(combined: DataFrame, days: bool) -> DataFrame:
    """Rows of days or of terms; a stored table is partitioned by ``is_day``."""
    if "is_day" in combined.columns:
        return combined.where(F.col("is_day") == F.lit(days))
    return combined.where(F.col("term").isNull() if days else F.col("term").isNotNull())


def max_term_date(term_counts: DataFrame):
    """Last date of the term table; store the counts first (`plans.report.combined_counts`) if they are used again."""
    return term_counts.agg(F.max("date")).first()[0]


def trending_terms(term_counts: DataFrame, growth_window: int = 7, growth_factor: float = 3.0,
                   top_n: int = 20, max_date: dt.date | None = None) -> DataFrame:
    """Terms whose recent daily average grew against a 30-day baseline.

    recent = dates >= max_date - growth_window (that is growth_window + 1 dates,
    divided by growth_window); baseline = the 30 dates before, divided by 30.
    growth = recent / baseline when baseline > 0.5, else recent * 10.
    Kept when growth >= growth_factor and recent >= 2; top_n by growth
    (ties by term); values rounded to 2 decimals after filtering and sorting.
    ``max_date`` defaults to the last date of the term table.
    """
    if max_date is None:
        max_date = max_term_date(term_counts)
    if max_date is None:
        return _empty_trending(term_counts)
    recent_start = max_date - dt.timedelta(days=growth_window)
    baseline_start = recent_start - dt.timedelta(days=BASELINE_DAYS)
    d = F.col("date")
    recent = d >= F.lit(recent_start)
    in_base = (d >= F.lit(baseline_start)) & (d < F.lit(recent_start))
    per_term = (
        term_counts.where(d >= F.lit(baseline_start))
        .groupBy("term")
        .agg(
            F.sum(F.when(recent, F.col("count"))).alias("_recent"),
            F.sum(F.when(in_base, F.col("count"))).alias("_base"),
        )
        .where(F.col("_recent").isNotNull())
    )
    cur = F.col("_recent").cast("double") / F.lit(float(growth_window))
    base = F.coalesce(F.col("_base").cast("double") / F.lit(float(BASELINE_DAYS)), F.lit(0.0))
    scored = per_term.select(
        "term", cur.alias("current_avg_daily"), base.alias("baseline_avg_daily")
    ).withColumn(
        "growth_ratio",
        F.when(F.col("baseline_avg_daily") > F.lit(MIN_BASELINE),
               F.col("current_avg_daily") / F.col("baseline_avg_daily"))
        .otherwise(F.col("current_avg_daily") * F.lit(NO_BASELINE_FACTOR)),
    )
    top = (
        scored.where((F.col("growth_ratio") >= F.lit(float(growth_factor)))
                     & (F.col("current_avg_daily") >= F.lit(MIN_CURRENT)))
        .orderBy(F.desc("growth_ratio"), F.asc("term"))
        .limit(top_n)
    )
    return top.select(
        "term",
        F.round("current_avg_daily", 2).alias("current_avg_daily"),
        F.round("baseline_avg_daily", 2).alias("baseline_avg_daily"),
        F.round("growth_ratio", 2).alias("growth_ratio"),
    )


def _empty_trending(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(
        [], "term string, current_avg_daily double, baseline_avg_daily double, growth_ratio double"
    )


def history_days(min_date: dt.date, max_date: dt.date, recent_days: int) -> int:
    """Days of history before the recency cutoff; 0 becomes 1 (may be negative)."""
    cutoff = max_date - dt.timedelta(days=recent_days)
    return (cutoff - min_date).days or 1


def novel_terms(term_counts: DataFrame, min_date: dt.date, max_date: dt.date, recent_days: int = 7,
                min_count: int = 20, top_n: int = 20) -> DataFrame:
    """Terms frequent in the last ``recent_days`` (+1) days and rare before.

    recent_count = conversations since max_date - recent_days containing the term
    (>= min_count); history daily rate = history_total / history days (< 1.0).
    novelty = "nouveau" when the history is empty, else "quasi_nouveau".
    """
    if max_date is None or min_date is None:  # no data: fixed schema, no rows
        return term_counts.sparkSession.createDataFrame(
            [], "term string, recent_count bigint, recent_daily_avg double, history_total bigint, "
                "history_daily_avg double, novelty string")
    cutoff = max_date - dt.timedelta(days=recent_days)
    hist_days = float(history_days(min_date, max_date, recent_days))
    recent = F.col("date") >= F.lit(cutoff)
    per_term = term_counts.groupBy("term").agg(
        F.sum(F.when(recent, F.col("count")).otherwise(F.lit(0))).alias("recent_count"),
        F.sum(F.when(~recent, F.col("count")).otherwise(F.lit(0))).alias("history_total"),
    )
    hist_daily = F.col("history_total").cast("double") / F.lit(hist_days)
    # a negative day count turns 0 into -0.0: normalise it
    hist_daily = F.when(F.col("history_total") == 0, F.lit(0.0)).otherwise(hist_daily)
    kept = per_term.where((F.col("recent_count") >= F.lit(min_count)) & (hist_daily < F.lit(1.0)))
    top = kept.orderBy(F.desc("recent_count"), F.asc("term")).limit(top_n)
    return top.select(
        "term",
        F.col("recent_count").cast("bigint").alias("recent_count"),
        F.round(F.col("recent_count").cast("double") / F.lit(float(recent_days)), 2).alias("recent_daily_avg"),
        F.col("history_total").cast("bigint").alias("history_total"),
        F.round(hist_daily, 2).alias("history_daily_avg"),
        F.when(F.col("history_total") == 0, F.lit("nouveau")).otherwise(F.lit("quasi_nouveau")).alias("novelty"),
    )
