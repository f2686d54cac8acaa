"""Emerging topics: LDA over the recent and the earlier conversations.

1. ``topic_sample_plan`` / ``topic_sample``: on request only, an exact
   hash-ordered sample per segment; by default every conversation is used.
2. ``topic_vocabulary``: tokens are letter runs of >= 2 letters, stop words
   removed, then unigrams + bigrams of the remaining tokens; a gram is kept when
   it occurs in >= min_df documents and in <= max_df of them; the max_features
   most frequent grams (ties by gram) form the vocabulary, in gram order.
   Words are counted first and prune the bigrams.
3. Spark ML ``CountVectorizerModel.from_vocabulary``, then batch variational
   inference (``lda``).
4. ``emergence``: mean topic weight per segment over all conversations, recent
   / history (recent * 100 when history <= 0.001), rounded, sorted; emerging =
   ratio > 1.5.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT_STOPWORDS
from ..functions.text import letter_runs
from ..session import drop_scratch, materialize, materialize_table, scratch_tables
from .lda import fit_topics
from .sampling import DEFAULT_SEED, exact_sample, topic_sample_sizes

EMERGING_RATIO = 1.5
BROADCAST_WORDS = 100_000  # frequent words up to which they are broadcast (a few MB)


def with_topic_tokens(df: DataFrame, out: str = "tokens", clean: str = "clean", stopwords=DEFAULT_STOPWORDS) -> DataFrame:
    """Adds the letter-run tokens (>= 2 letters, stop words removed).

    They become a column of their own behind a one-element generator, which the optimiser cannot inline: what follows
    refers to them several times, and its cost stays linear in the text.
    """
    stop = list(stopwords)
    toks = F.filter(letter_runs(clean), lambda t: (F.length(t) >= 2) & ~t.isin(stop))
    return df.select("*", F.explode(F.array(toks)).alias(out))


def _neighbours(tokens: str) -> tuple[Column, Column]:
    """The tokens that have one after them, and those that follow, position by position."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.slice(tokens, F.lit(1), pairs), F.slice(tokens, F.lit(2), pairs)


def with_topic_grams(df: DataFrame, out: str = "grams", clean: str = "clean", stopwords=DEFAULT_STOPWORDS) -> DataFrame:
    """Adds the unigrams and bigrams of the tokens."""
    held = with_topic_tokens(df, "_toks", clean, stopwords)
    bigrams = F.zip_with(*_neighbours("_toks"), lambda a, b: F.concat(a, F.lit(" "), b))
    # the joined list is held too: several expressions use it
    return held.select(*df.columns, F.explode(F.array(F.concat("_toks", bigrams))).alias(out))


def topic_sample_plan(prepared: DataFrame, max_date: dt.date, recent_days: int = 14,
                      sample_size: int | None = None, daily: DataFrame | None = None,
                      min_recent: int = 10_000) -> DataFrame:
    """(is_recent, n_total, n_sample): segment sizes and the sample drawn from each (all, without a sample size).

    With the daily table at hand the segment sizes are sums over it (no pass
    over the conversations).
    """
    cutoff = max_date - dt.timedelta(days=recent_days)
    if daily is not None:
        n = F.col("total_conversations")
        row = daily.agg(
            F.sum(F.when(F.col("date") >= F.lit(cutoff), n).otherwise(0)).alias("r"),
            F.sum(F.when(F.col("date") < F.lit(cutoff), n).otherwise(0)).alias("h"),
        ).first()
    else:
        row = prepared.agg(
            F.count_if(F.col("date") >= F.lit(cutoff)).alias("r"),
            F.count_if(F.col("date") < F.lit(cutoff)).alias("h"),
        ).first()
    n_r, n_h = int(row["r"] or 0), int(row["h"] or 0)
    s_r, s_h = topic_sample_sizes(n_r, n_h, sample_size, min_recent)
    spark = prepared.sparkSession
    return spark.createDataFrame(
        [(True, n_r, s_r), (False, n_h, s_h)], "is_recent boolean, n_total bigint, n_sample bigint"
    )


def topic_sample(prepared: DataFrame, max_date: dt.date, recent_days: int = 14,
                 sample_size: int | None = None, seed: int = DEFAULT_SEED,
                 plan: DataFrame | None = None) -> DataFrame:
    """(conversation_id, date, clean, is_recent, sample_rank): the exact per-segment sample."""
    plan = plan if plan is not None else topic_sample_plan(prepared, max_date, recent_days, sample_size)
    rows = {r["is_recent"]: r for r in plan.collect()}
    cutoff = max_date - dt.timedelta(days=recent_days)
    src = prepared.select("conversation_id", "date", "clean",
                          (F.col("date") >= F.lit(cutoff)).alias("is_recent"))
    sizes = {k: int(v["n_sample"]) for k, v in rows.items()}
    return exact_sample(src, sizes, ["conversation_id"], segment_col="is_recent", seed=seed)


def _tagged(rows: DataFrame, items: str) -> DataFrame:
    """Every occurrence of an item tagged false, every distinct item of a document tagged true: (item, doc)."""
    return rows.select(F.inline(F.concat(
        F.transform(items, lambda x: F.struct(x.alias("item"), F.lit(False).alias("doc"))),
        F.transform(F.array_distinct(items), lambda x: F.struct(x.alias("item"), F.lit(True).alias("doc"))))))


def _frequencies(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("item").agg(F.count_if("doc").alias("doc_freq"), F.count_if(~F.col("doc")).alias("term_freq"))


def topic_vocabulary(sample: DataFrame, max_features: int = 3000, min_df: int = 10,
                     max_df: float = 0.8, stopwords=DEFAULT_STOPWORDS, n_docs: int | None = None) -> DataFrame:
    """(term, doc_freq, term_freq) of the kept grams, ordered by term.

    A bigram occurs no oftener, and in no more documents, than either of its words.  So words are counted first; the
    ``max_features``-th kept word's frequency is a floor below which no gram is kept, and only bigrams of two words
    that reach it (and ``min_df``) are counted at all.
    """
    held = with_topic_tokens(sample.select("clean"), stopwords=stopwords)
    # a document counts once more as a row without an item, so the same pass gives their number
    tagged = _tagged(held.select(F.concat("tokens", F.array(F.lit(None).cast("string"))).alias("tokens")), "tokens")
    counted = _frequencies(tagged)
    if isinstance(min_df, int):
        counted = counted.where((F.col("doc_freq") >= F.lit(min_df)) | F.col("item").isNull())
    counted = materialize_table(counted, "words")
    if n_docs is None:
        n_docs = int(counted.where(F.col("item").isNull()).agg(F.coalesce(F.sum("doc_freq"), F.lit(0))).first()[0])
    max_doc = max_df * n_docs if isinstance(max_df, float) else float(max_df)
    min_doc = float(min_df) if isinstance(min_df, int) else min_df * n_docs
    in_range = (F.col("doc_freq") >= F.lit(min_doc)) & (F.col("doc_freq") <= F.lit(max_doc))
    words = counted.where(F.col("item").isNotNull() & (F.col("doc_freq") >= F.lit(min_doc)))
    best = words.where(in_range).orderBy(F.desc("term_freq"), F.asc("item")).limit(max_features)
    n_best, last = best.agg(F.count(F.lit(1)), F.min("term_freq")).first()
    floor = int(last) if n_best == max_features else 0
    frequent = words.where(F.col("term_freq") >= F.lit(floor)).select(F.col("item").alias("word"))
    if frequent.count() <= BROADCAST_WORDS:  # else a sort-merge join
        frequent = F.broadcast(frequent)
    # joined words: equal strings are found by hashing, structures would be compared one by one
    pairs = _tagged(held.select(F.zip_with(*_neighbours("tokens"), lambda a, b: F.concat(a, F.lit(" "), b)).alias("pairs")).select(
        F.explode(F.array("pairs")).alias("pairs")), "pairs")
    for side in (1, -1):
        pairs = pairs.join(frequent, F.substring_index("item", " ", side) == F.col("word"), "left_semi")
    grams = words.unionByName(_frequencies(pairs)).where(in_range)
    top = grams.orderBy(F.desc("term_freq"), F.asc("item")).limit(max_features)
    return top.select(F.col("item").alias("term"), F.col("doc_freq").cast("bigint").alias("doc_freq"),
                      F.col("term_freq").cast("bigint").alias("term_freq")).orderBy("term")


def emergence(doc_topics: DataFrame) -> DataFrame:
    """(is_recent, p vector) rows -> topic_id, recent_weight, history_weight, emergence_ratio, is_emerging, sorted.

    Mean topic vector per segment (0 without rows), safe ratio, rounding, then the threshold on the rounded ratio.
    """
    means = doc_topics.groupBy("is_recent").agg(vector_to_array(Summarizer.mean(F.col("p"))).alias("mean"))
    each = means.select("is_recent", F.posexplode("mean").alias("topic_id", "w"))  # two rows a topic
    weights = each.groupBy("topic_id").agg(
        F.coalesce(F.max(F.when(F.col("is_recent"), F.col("w"))), F.lit(0.0)).alias("recent"),
        F.coalesce(F.max(F.when(~F.col("is_recent"), F.col("w"))), F.lit(0.0)).alias("history"))
    ratio = F.when(F.col("history") > F.lit(0.001), F.col("recent") / F.col("history")).otherwise(
        F.col("recent") * F.lit(100.0))
    out = weights.select(
        F.col("topic_id").cast("int").alias("topic_id"), F.round("recent", 4).alias("recent_weight"),
        F.round("history", 4).alias("history_weight"), F.round(ratio, 2).alias("emergence_ratio"))
    return out.withColumn("is_emerging", F.col("emergence_ratio") > F.lit(EMERGING_RATIO)).orderBy(
        F.desc("emergence_ratio"), F.asc("topic_id"))


def emerging_topics(prepared: DataFrame, max_date: dt.date, n_topics: int = 10, recent_days: int = 14,
                    sample_size: int | None = None, max_iter: int = 15, seed: int = DEFAULT_SEED,
                    max_features: int = 3000, min_df: int = 10, max_df: float = 0.8,
                    stopwords=DEFAULT_STOPWORDS, daily: DataFrame | None = None) -> DataFrame:
    """topic_id, top_words, recent_weight, history_weight, emergence_ratio, is_emerging.

    Sorted by emergence_ratio (desc, then topic_id).  Vocabulary and model are fitted on every conversation, or on
    a sample where ``sample_size`` asks for one; the weights are means over every conversation either way.  They
    are those of `lda.fit_topics` (batch variational inference, deterministic start) and equal on every run but for the
    order of floating-point sums.  A document without any vocabulary gram has equal weights.
    """
    spark = prepared.sparkSession
    schema = ("topic_id int, top_words array<string>, recent_weight double, history_weight double, "
              "emergence_ratio double, is_emerging boolean")
    if max_date is None:  # no data
        return spark.createDataFrame([], schema)
    cutoff = max_date - dt.timedelta(days=recent_days)
    everyone = prepared.select("clean", (F.col("date") >= F.lit(cutoff)).alias("is_recent"))
    fitted_on = everyone
    if sample_size is not None:
        plan = topic_sample_plan(prepared, max_date, recent_days, sample_size, daily=daily)
        fitted_on = topic_sample(prepared, max_date, recent_days, sample_size, seed, plan=plan).select("clean", "is_recent")
    vocab = [r["term"] for r in topic_vocabulary(fitted_on, max_features, min_df, max_df, stopwords).collect()]
    if not vocab:
        return spark.createDataFrame([], schema)
    def counted(df: DataFrame) -> DataFrame:
        features = CountVectorizerModel.from_vocabulary(vocab, inputCol="grams", outputCol="features").transform(
            with_topic_grams(df, stopwords=stopwords))
        sparse = features.select("is_recent", F.unwrap_udt("features").alias("v"))
        return sparse.select("is_recent", F.col("v.indices").alias("terms"), F.col("v.values").alias("counts"))

    # every iteration reads the counts once: stored in the shared folder, not on the executors
    before = scratch_tables(spark)
    stored = materialize_table(counted(fitted_on), "topic-counts")
    model = fit_topics(stored, len(vocab), n_topics, max_iter, seed)
    dist = model.transform(stored if sample_size is None else counted(everyone))
    words = spark.createDataFrame([(i, [vocab[t] for t in top]) for i, top in enumerate(model.top_terms(10))],
                                  "topic_id int, top_words array<string>")
    topics = emergence(dist.select("is_recent", array_to_vector("p").alias("p"))).join(F.broadcast(words), "topic_id")  # k rows a side
    topics = topics.select("topic_id", "top_words", "recent_weight", "history_weight", "emergence_ratio", "is_emerging")
    topics = materialize(topics.orderBy(F.desc("emergence_ratio"), F.asc("topic_id")))
    drop_scratch(spark, [path for path in scratch_tables(spark) if path not in before])
    return topics
