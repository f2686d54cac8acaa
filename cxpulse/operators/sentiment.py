"""``with_sentiment``: lexicon negativity score per conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT_LEXICON, Lexicon
from ..functions.scoring import neg_score


def with_sentiment(prepared: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON,
                   text_col: str = "clean") -> DataFrame:
    """Add ``neg_score`` (double in [0, 1]) and ``is_negative`` (score > threshold)."""
    return prepared.withColumn("neg_score", neg_score(text_col, lexicon)).withColumn(
        "is_negative", F.col("neg_score") > F.lit(float(lexicon.threshold))
    )


def ambiguous(scored: DataFrame, low: float = 0.01, high: float = 0.30) -> DataFrame:
    """Conversations in the grey band ``low < neg_score <= high``."""
    return scored.where((F.col("neg_score") > F.lit(low)) & (F.col("neg_score") <= F.lit(high)))
