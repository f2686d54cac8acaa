"""Second-pass correction of daily negative counts with a sentiment model.

The lexicon is unsure about conversations with ``0.01 < score <= 0.30``.  All
of them (or, where ``sample_size`` asks for one, a deterministic sample) are
labelled by a model from their whole text, the share the model calls negative (1 or 2 stars) becomes the recovery rate, and
each day's negatives are raised by ``round(ambiguous_count * rate)``; the
rolling z-score is then recomputed on the corrected ratio.

The model is the one place Python runs per row.  It is a *scorer factory*:
called once per task to load the model, it returns a function from a list of
texts (a batch) to a list of labels like ``"4 stars"``.  Texts arrive in Arrow
batches through an iterator ``pandas_udf`` and are cut into model batches of
``batch_size``; label -> score conversion happens back in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import stars_to_score
from ..functions.text import truncate
from ..session import ship_package
from .anomaly import rolling_zscore
from .classifier import Confusion, TextModel
from .sampling import DEFAULT_SEED, exact_sample
from .sentiment import ambiguous

ScorerFactory = Callable[[], Callable[[list[str]], list[str]]] | TextModel
MODEL_NEGATIVE = 0.6


def length_stars_scorer() -> Callable[[list[str]], list[str]]:
    """Deterministic stand-in model: ``1 + len(text) % 5`` stars."""
    def score(texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            s = 1 + len(t) % 5
            out.append(f"{s} star" if s == 1 else f"{s} stars")
        return out
    return score


def label_udf(scorer_factory: ScorerFactory, batch_size: int = 32):
    """Iterator pandas UDF: loads the model once per task, labels texts in batches."""

    @F.pandas_udf("string")
    def _label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = scorer_factory()
        for texts in batches:
            values = texts.tolist()
            labels: list[str] = []
            for i in range(0, len(values), batch_size):
                labels.extend(model(values[i:i + batch_size]))
            yield pd.Series(labels, dtype="object")

    return _label


def ambiguous_sample(scored: DataFrame, sample_size: int | None = None, low: float = 0.01,
                     high: float = 0.30, seed: int = DEFAULT_SEED) -> DataFrame:
    """The exact hash-ordered sample of ambiguous conversations (all of them without a size)."""
    src = ambiguous(scored, low, high).select("date", "conversation_id", "clean", "neg_score")
    return src if sample_size is None else exact_sample(src, {None: sample_size}, ["conversation_id"], seed=seed)


def label_sample(sample: DataFrame, scorer_factory: ScorerFactory = length_stars_scorer,
                 batch_size: int = 32, max_chars: int | None = None) -> DataFrame:
    """Adds model_label, model_score and model_negative (score > 0.6).

    The model sees whole texts; ``max_chars`` is for models that cannot take them.  A `classifier.TextModel` in place of
    the factory labels on the JVM side.
    """
    if isinstance(scorer_factory, TextModel):
        lab = scorer_factory.label(sample.withColumn("_seen", truncate("clean", max_chars)), "_seen").drop("_seen")
    else:
        ship_package(sample.sparkSession)
        lab = sample.withColumn("model_label", label_udf(scorer_factory, batch_size)(truncate("clean", max_chars)))
    lab = lab.withColumn("model_score", stars_to_score("model_label"))
    return lab.withColumn("model_negative", F.col("model_score") > F.lit(MODEL_NEGATIVE))


def recovery_stats(scored: DataFrame, scorer_factory: ScorerFactory = length_stars_scorer,
                   sample_size: int | None = None, low: float = 0.01, high: float = 0.30,
                   batch_size: int = 32, seed: int = DEFAULT_SEED, max_chars: int | None = None) -> DataFrame:
    """One row: n_ambiguous_total, n_sampled, n_recovered, recovery_rate (0.0 when empty)."""
    sample = ambiguous_sample(scored, sample_size, low, high, seed)
    labelled = label_sample(sample, scorer_factory, batch_size, max_chars)
    total = ambiguous(scored, low, high).agg(F.count(F.lit(1)).alias("n")) if sample_size is not None else None
    stats = labelled.agg(
        F.count(F.lit(1)).alias("n_sampled"),
        F.count_if("model_negative").alias("n_recovered"),
    )
    n_all = F.col("n_sampled")
    if total is not None:
        stats, n_all = stats.crossJoin(total), F.col("n")  # one row beside one row
    return stats.select(
        n_all.cast("bigint").alias("n_ambiguous_total"),
        F.col("n_sampled").cast("bigint").alias("n_sampled"),
        F.col("n_recovered").cast("bigint").alias("n_recovered"),
        F.coalesce(F.col("n_recovered").cast("double") / F.nullif(F.col("n_sampled"), F.lit(0)).cast("double"),
                   F.lit(0.0)).alias("recovery_rate"),
    )


def ambiguous_daily(scored: DataFrame, low: float = 0.01, high: float = 0.30) -> DataFrame:
    return ambiguous(scored, low, high).groupBy("date").agg(F.count(F.lit(1)).alias("ambiguous_count"))


def refine_daily(scored: DataFrame, daily: DataFrame, scorer_factory: ScorerFactory = length_stars_scorer,
                 ambiguous_threshold: float = 0.30, sample_size: int | None = None, batch_size: int = 32,
                 z_threshold: float = 2.0, low: float = 0.01, exclude_already_negative: bool = False,
                 seed: int = DEFAULT_SEED, window: int = 30, min_periods: int = 7,
                 max_chars: int | None = None, confusion: Confusion | None = None) -> tuple[DataFrame, DataFrame]:
    """(daily with corrected columns, one-row recovery stats with negatives and spikes before and after).

    By default the ambiguous band includes scores already counted negative
    (0.15, 0.30], as the reproduced behaviour does; ``exclude_already_negative``
    restricts it to non-negative conversations.  When ``daily`` already carries
    ``ambiguous_count`` (``daily_spikes(..., ambiguous_band=...)`` with the same
    band) no extra pass over the conversations is needed for the counts.  With
    the model's ``confusion`` matrix the recovery rate is corrected by it.
    """
    base = scored.where(~F.col("is_negative")) if exclude_already_negative else scored
    if "ambiguous_count" in daily.columns:
        out = daily.drop(*[c for c in daily.columns if c.endswith("_corrected")])
    else:
        # both sides are daily aggregates (one row per calendar day)
        out = daily.drop(*[c for c in daily.columns if c.endswith("_corrected")])
        out = out.join(ambiguous_daily(base, low, ambiguous_threshold), "date", "left")
    out = out.withColumn("ambiguous_count", F.coalesce(F.col("ambiguous_count"), F.lit(0)).cast("bigint"))
    total = int(out.agg(F.sum("ambiguous_count")).first()[0] or 0)
    sample = ambiguous_sample(base, sample_size, low, ambiguous_threshold, seed)
    labelled = label_sample(sample, scorer_factory, batch_size, max_chars)
    agg = labelled.agg(F.count(F.lit(1)).alias("n_sampled"), F.count_if("model_negative").alias("n_recovered")).first()
    n_sampled, n_recovered = int(agg["n_sampled"]), int(agg["n_recovered"])
    rate = n_recovered / n_sampled if n_sampled else 0.0
    if confusion is not None:
        rate = confusion.corrected(n_recovered, n_sampled)[0]
    out = out.withColumn(
        "negative_count_corrected",
        (F.col("negative_count") + F.round(F.col("ambiguous_count") * F.lit(rate), 0).cast("bigint")).cast("bigint"),
    ).withColumn(
        "negative_ratio_corrected",
        F.col("negative_count_corrected").cast("double") / F.col("total_conversations").cast("double"),
    )
    out = rolling_zscore(out, "negative_ratio_corrected", window=window, min_periods=min_periods,
                         z_threshold=z_threshold, suffix="_corrected")
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).cast("bigint")
    before = flag("is_spike") if "is_spike" in out.columns else F.lit(None).cast("bigint")
    stats_df = out.agg(
        F.lit(total).cast("bigint").alias("n_ambiguous_total"), F.lit(n_sampled).cast("bigint").alias("n_sampled"),
        F.lit(n_recovered).cast("bigint").alias("n_recovered"), F.lit(float(rate)).alias("recovery_rate"),
        F.coalesce(F.sum("negative_count"), F.lit(0)).cast("bigint").alias("negatives_before"),
        F.coalesce(F.sum("negative_count_corrected"), F.lit(0)).cast("bigint").alias("negatives_after"),
        before.alias("spikes_before"), flag("is_spike_corrected").alias("spikes_after"))
    return out.orderBy("date"), stats_df
