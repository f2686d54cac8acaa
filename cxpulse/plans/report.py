"""The full report: every analysis as a DataFrame, plus summary and dashboard feeds.

``full_report`` runs the analyses in order and returns a `Report`: a dict of
DataFrames that is also a context manager and removes the intermediate tables.
The big conversation table is scanned only by the analyses that need raw text,
and each scan serves as much as it can; the shared intermediate results — the
cleaned and scored copy, the daily table, the (date, term) counts used by
trending, novel and the feeds — are written to the cluster's shared checkpoint
folder so that a lost executor never forces a rescan of the conversations.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT_LEXICON, DEFAULT_STOPWORDS, Lexicon
from ..operators.anomaly import bounds_from_daily, rolling_zscore
from ..operators.examples import term_examples_many
from ..operators.prepare import prepare, row_counts
from ..operators.refine import ScorerFactory, refine_daily
from ..operators.sentiment import with_sentiment
from ..operators.spikes import spike_details
from ..operators.terms import daily_and_term_counts, daily_part, novel_terms, term_part, trending_terms
from ..operators.topics import emerging_topics
from ..session import drop_scratch, materialize, materialize_table, scratch_tables

DASHBOARD_TOP = 15


@dataclass
class Params:
    z_threshold: float = 2.0
    growth_window: int = 7
    growth_factor: float = 3.0
    top_n_terms: int = 20
    # None: every conversation
    lda_sample_size: int | None = None
    max_features: int = 3000
    min_df: int = 10
    max_df: float = 0.8
    n_topics: int = 10
    topic_recent_days: int = 14
    novel_recent_days: int = 7
    novel_min_count: int = 20
    use_model: bool = False
    ambiguous_threshold: float = 0.30
    # None: every ambiguous conversation, whole texts
    model_sample_size: int | None = None
    model_max_chars: int | None = None
    exclude_already_negative: bool = False
    model_batch_size: int = 32
    max_samples_per_term: int = 20
    rolling_window: int = 30
    min_periods: int = 7
    # write the parsed, cleaned and scored projection once and let every pass read it
    materialize_prepared: bool = True
    lexicon: Lexicon = field(default_factory=lambda: DEFAULT_LEXICON)
    stopwords: tuple = DEFAULT_STOPWORDS


class Report(dict):
    """Name -> DataFrame; ``cleanup`` (or leaving the ``with`` block) removes the tables the frames were made from.

    ``row_counts``: one row of rows read, dropped and kept (None where the prepared table was not stored).
    """

    row_counts: DataFrame | None = None

    def __init__(self, spark: SparkSession, tables: list[str]):
        super().__init__()
        self.spark, self.tables = spark, tables

    def cleanup(self) -> None:
        drop_scratch(self.spark, self.tables)

    def __enter__(self) -> Report:
        return self

    def __exit__(self, *_) -> None:
        self.cleanup()


def summary(daily: DataFrame, trending: DataFrame, novel: DataFrame) -> DataFrame:
    """metric, value (both strings): period, totals and shares from the daily table, lengths of the term lists.

    With corrected columns, negatives and spikes are given before and after the correction.
    """
    flags = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    total, negative = F.coalesce(F.sum("total_conversations"), F.lit(0)), F.coalesce(F.sum("negative_count"), F.lit(0))
    corrected = "negative_count_corrected" in daily.columns

    def per_cent(count):
        return F.format_string("%.2f", F.coalesce(F.round(F.lit(100.0) * count / F.nullif(total, F.lit(0)), 2), F.lit(0.0)))

    items = [
        ("period", F.concat(F.coalesce(F.min("date").cast("string"), F.lit("None")), F.lit(" -> "),
                            F.coalesce(F.max("date").cast("string"), F.lit("None")))),
        ("total_conversations", total.cast("string")),
        ("negative_conversations", negative.cast("string")),
        ("negative_share_pct", per_cent(negative)),
        ("negative_spikes", flags("is_spike_corrected" if corrected else "is_spike").cast("string")),
    ]
    if corrected:
        after = F.coalesce(F.sum("negative_count_corrected"), F.lit(0))
        items += [("negative_conversations_corrected", after.cast("string")),
                  ("negative_share_corrected_pct", per_cent(after)),
                  ("negative_spikes_uncorrected", flags("is_spike").cast("string"))]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in items])
    out = daily.agg(rows.alias("r")).select(F.inline("r"))
    for name, frame in (("trending_terms", trending), ("novel_terms", novel)):
        count = frame.agg(F.count(F.lit(1)).cast("string").alias("value"))
        out = out.unionByName(count.select(F.lit(name).alias("metric"), "value"))
    return out


def dashboard_daily(daily: DataFrame) -> DataFrame:
    cols = ["date", "total_conversations", "negative_ratio", F.coalesce(F.col("is_spike"), F.lit(False)).alias("is_spike")]
    if "negative_ratio_corrected" in daily.columns:
        cols += ["negative_ratio_corrected",
                 F.coalesce(F.col("is_spike_corrected"), F.lit(False)).alias("is_spike_corrected")]
    return daily.select(*cols).orderBy("date")


def dashboard_spikes(daily: DataFrame) -> DataFrame:
    """(date, negative_ratio) of the spike points (corrected series when present)."""
    if "is_spike_corrected" in daily.columns:
        spike, ratio = "is_spike_corrected", "negative_ratio_corrected"
    else:
        spike, ratio = "is_spike", "negative_ratio"
    return daily.where(F.coalesce(F.col(spike), F.lit(False))).select("date", F.col(ratio).alias("negative_ratio")).orderBy("date")


def dashboard_trending(trending: DataFrame, top: int = DASHBOARD_TOP) -> DataFrame:
    return trending.orderBy(F.desc("growth_ratio"), F.asc("term")).limit(top).select("term", "growth_ratio")


def dashboard_novel(novel: DataFrame, top: int = DASHBOARD_TOP) -> DataFrame:
    return novel.orderBy(F.desc("recent_count"), F.asc("term")).limit(top).select("term", "recent_count", "novelty")


def combined_counts(scored: DataFrame, band: tuple | None = None, exclude_negative: bool = False,
                    stopwords=DEFAULT_STOPWORDS) -> DataFrame:
    """Daily statistics and (date, term) counts of one pass, stored so that the few daily rows are read alone."""
    both = daily_and_term_counts(scored, band, exclude_negative, stopwords)
    return materialize_table(both.withColumn("is_day", F.col("term").isNull()), "combined", partition_by="is_day")


def full_report(df: DataFrame, date_col: str = "date", verbatim_col: str = "verbatims",
                conversation_id_col: str = "conversation_id", parser: str = "split",
                params: Params | None = None, scorer_factory: ScorerFactory | None = None,
                with_topics: bool = True, with_examples: bool = True,
                parallel: bool = True) -> Report:
    """Run every analysis; returns a `Report` of DataFrames (see README for the schemas).

    The input is parsed, cleaned and scored once: that projection is written as
    Parquet to the shared checkpoint folder (``materialize_prepared``), sorted
    by date within its files so that the spike days prune row groups, and every
    pass reads only the columns it needs.  Call ``cleanup`` on the result (or
    use it in a ``with`` block) when its frames have been read.  Full passes over it: one for
    the daily statistics and the (date, term) counts together (the daily
    table also yields the date bounds, the row count, the topic segment sizes
    and, with a model, the ambiguous counts) and one for all term examples.
    The result's ``row_counts`` says what was read and dropped (observed while the copy is written).
    Spike details read only the spike days and the two samples only their
    hash candidates.
    """
    p = params or Params()
    spark = df.sparkSession
    before = set(scratch_tables(spark))
    counted = Observation("cxpulse-rows") if p.materialize_prepared else None  # read once only if it is stored
    scored = with_sentiment(prepare(df, date_col, verbatim_col, conversation_id_col, parser, counted), p.lexicon).select(
        "date", "conversation_id", "verbatim", "n_messages", "clean", "neg_score", "is_negative")
    if p.materialize_prepared:
        # parsing, cleaning and scoring are the costliest row work: do them once
        scored = materialize_table(scored.sortWithinPartitions("date"), "prepared")
    out: dict[str, DataFrame] = {}

    band = (0.01, p.ambiguous_threshold) if p.use_model else None
    # one full pass: daily statistics (+ ambiguous counts) and (date, term) counts
    combined = combined_counts(scored, band, p.exclude_already_negative, p.stopwords)
    daily0 = materialize(rolling_zscore(daily_part(combined, with_ambiguous=band is not None), "negative_ratio",
                                        window=p.rolling_window, min_periods=p.min_periods,
                                        z_threshold=p.z_threshold).orderBy("date"))
    counts = term_part(combined)
    bounds = bounds_from_daily(daily0)
    if p.use_model and scorer_factory is None:
        raise ValueError("use_model=True needs a scorer_factory")

    def details():
        # spike details follow the corrected spike flags when the model pass runs
        res = {}
        daily = daily0
        if p.use_model:
            daily, res["refine_stats"] = refine_daily(
                scored, daily0, scorer_factory, p.ambiguous_threshold, p.model_sample_size, p.model_batch_size,
                p.z_threshold, exclude_already_negative=p.exclude_already_negative, window=p.rolling_window,
                min_periods=p.min_periods, max_chars=p.model_max_chars)
            daily = materialize(daily)
        res["daily_stats"] = daily
        res["spike_details"] = materialize(spike_details(scored, daily, stopwords=p.stopwords))
        return res

    def topics():
        return {"topics": emerging_topics(scored, bounds.max_date, p.n_topics, p.topic_recent_days, p.lda_sample_size,
                                          max_features=p.max_features, min_df=p.min_df, max_df=p.max_df,
                                          stopwords=p.stopwords, daily=daily0)}

    def terms():
        trending = materialize(trending_terms(counts, p.growth_window, p.growth_factor, p.top_n_terms))
        novel = materialize(novel_terms(counts, bounds.min_date, bounds.max_date, p.novel_recent_days,
                                        p.novel_min_count, p.top_n_terms))
        res = {"trending_terms": trending, "novel_terms": novel}
        if with_examples:
            ex = term_examples_many(scored, {"trending": trending, "novel": novel}, p.max_samples_per_term)
            res["trending_examples"] = ex["trending"]
            res["novel_examples"] = ex["novel"]
        return res

    tasks = [details, terms] + ([topics] if with_topics else [])
    if parallel:
        # independent analyses: submit their jobs concurrently so that the
        # cluster stays busy while one of them waits on the driver (LDA steps)
        with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
            for res in pool.map(lambda f: f(), tasks):
                out.update(res)
    else:
        for f in tasks:
            out.update(f())
    trending, novel, daily = out["trending_terms"], out["novel_terms"], out["daily_stats"]

    out["summary"] = summary(daily, trending, novel)
    out["dashboard_daily"] = dashboard_daily(daily)
    out["dashboard_spikes"] = dashboard_spikes(daily)
    out["dashboard_trending"] = dashboard_trending(trending)
    out["dashboard_novel"] = dashboard_novel(novel)
    report = Report(spark, [t for t in scratch_tables(spark) if t not in before])
    report.update(out)
    report.row_counts = row_counts(spark, counted) if counted is not None else None
    return report
