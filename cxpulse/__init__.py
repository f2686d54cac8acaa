"""cxpulse: conversation analytics on Spark (DataFrame / SQL / ML).

The public API is a set of functions over DataFrames and Columns; see README.
"""

from .functions.lexicon import DEFAULT_LEXICON, DEFAULT_STOPWORDS, Lexicon
from .functions.scoring import neg_score, stars_to_score
from .functions.text import clean_text, parse_list_json, parse_list_split
from .operators.anomaly import daily_sentiment, daily_spikes, rolling_zscore, spike_dates
from .operators.examples import term_examples, term_examples_many
from .operators.prepare import date_bounds, prepare
from .operators.refine import length_stars_scorer, recovery_stats, refine_daily
from .operators.sampling import exact_sample
from .operators.sentiment import ambiguous, with_sentiment
from .operators.spikes import spike_details, spike_samples, spike_top_terms
from .operators.terms import novel_terms, term_daily_counts, trending_terms
from .operators.topics import emerging_topics, topic_sample, topic_vocabulary
from .plans.report import Params, full_report
from .plans.sinks import write_report

__all__ = [
    "DEFAULT_LEXICON", "DEFAULT_STOPWORDS", "Lexicon", "Params", "ambiguous", "clean_text",
    "daily_sentiment", "daily_spikes", "date_bounds", "emerging_topics", "exact_sample", "full_report",
    "length_stars_scorer", "neg_score", "novel_terms", "parse_list_json", "parse_list_split", "prepare",
    "recovery_stats", "refine_daily", "rolling_zscore", "spike_dates", "spike_details", "spike_samples",
    "spike_top_terms", "stars_to_score", "term_daily_counts", "term_examples", "term_examples_many",
    "topic_sample", "topic_vocabulary", "trending_terms", "with_sentiment", "write_report",
]
