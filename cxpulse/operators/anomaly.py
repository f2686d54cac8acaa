"""Daily negativity statistics and rolling z-score spikes.

The heavy step is one ``groupBy(date)`` (partial aggregation on every map
task, so a hot day costs nothing extra).  The rolling window then runs on the
daily table — one row per calendar day, i.e. a few hundred rows whatever the
input size — so an unpartitioned ``Window.orderBy(date)`` is the right plan
there and must never be applied before the aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STD_FLOOR = 1e-9


def ambiguous_condition(low: float = 0.01, high: float = 0.30, exclude_negative: bool = False):
    cond = (F.col("neg_score") > F.lit(low)) & (F.col("neg_score") <= F.lit(high))
    return cond & ~F.col("is_negative") if exclude_negative else cond


def daily_sentiment(scored: DataFrame, date_col: str = "date", ambiguous_band: tuple | None = None,
                    exclude_negative: bool = False) -> DataFrame:
    """date, total_conversations, negative_count, mean_neg_score, negative_ratio.

    With ``ambiguous_band=(low, high)`` the same pass also counts the
    conversations in that score band (``ambiguous_count``), which the model
    refinement reuses instead of scanning the table again.
    """
    aggs = [
        F.count(F.lit(1)).alias("total_conversations"),
        F.count_if(F.col("is_negative")).alias("negative_count"),
        F.avg("neg_score").alias("mean_neg_score"),
    ]
    if ambiguous_band is not None:
        aggs.append(F.count_if(ambiguous_condition(*ambiguous_band, exclude_negative)).alias("ambiguous_count"))
    daily = scored.groupBy(date_col).agg(*aggs)
    return daily.withColumn(
        "negative_ratio", F.col("negative_count").cast("double") / F.col("total_conversations").cast("double")
    )


def rolling_zscore(daily: DataFrame, value_col: str, order_col: str = "date", window: int = 30,
                   min_periods: int = 7, z_threshold: float = 2.0, suffix: str = "") -> DataFrame:
    """Row-based rolling mean/std (sample) over the last ``window`` rows, null below
    ``min_periods`` non-null values; z = (x - mean) / max(std, 1e-9); spike = z > threshold.

    ``daily`` must already be aggregated to one row per ``order_col`` value.
    """
    w = Window.orderBy(order_col).rowsBetween(-(window - 1), Window.currentRow)
    x = F.col(value_col)
    enough = F.count(x).over(w) >= F.lit(min_periods)
    mean_c, std_c, z_c, spike_c = (f"rolling_mean{suffix}", f"rolling_std{suffix}",
                                   f"z_score{suffix}", f"is_spike{suffix}")
    out = daily.withColumns({
        mean_c: F.when(enough, F.avg(x).over(w)),
        std_c: F.when(enough, F.stddev_samp(x).over(w)),
    })
    std = F.col(std_c)
    # greatest() skips nulls: keep a null std null instead of flooring it
    out = out.withColumn(z_c, (x - F.col(mean_c)) / F.when(std.isNotNull(), F.greatest(std, F.lit(STD_FLOOR))))
    return out.withColumn(spike_c, F.col(z_c) > F.lit(float(z_threshold)))


def daily_spikes(scored: DataFrame, z_threshold: float = 2.0, window: int = 30,
                 min_periods: int = 7, ambiguous_band: tuple | None = None,
                 exclude_negative: bool = False) -> DataFrame:
    """Daily statistics with rolling z-score and the spike flag (sorted by date)."""
    daily = daily_sentiment(scored, ambiguous_band=ambiguous_band, exclude_negative=exclude_negative)
    return rolling_zscore(daily, "negative_ratio", window=window, min_periods=min_periods,
                          z_threshold=z_threshold).orderBy("date")


def spike_dates(daily: DataFrame, spike_col: str | None = None) -> DataFrame:
    """Dates flagged as spikes (null flags count as no spike).

    Uses ``is_spike_corrected`` when present, like the refined report.
    """
    if spike_col is None:
        spike_col = "is_spike_corrected" if "is_spike_corrected" in daily.columns else "is_spike"
    return daily.where(F.coalesce(F.col(spike_col), F.lit(False))).select("date")


def bounds_from_daily(daily: DataFrame):
    """(min date, max date, row count) read off the daily table — no pass over the data."""
    from .prepare import DateBounds

    row = daily.agg(F.min("date"), F.max("date"), F.sum("total_conversations")).first()
    return DateBounds(row[0], row[1], int(row[2] or 0))


def event_error_share(events: DataFrame, event_type: str = "error") -> DataFrame:
    """Per-day share of one event type on the ``events`` table (generic ratio series)."""
    daily = events.groupBy(F.col("ts").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("event_type") == F.lit(event_type)).alias("error_events"),
    )
    return daily.withColumn("error_ratio", F.col("error_events").cast("double") / F.col("total_events").cast("double"))
