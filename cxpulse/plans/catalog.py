"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

They read the driver tables (``events`` through the deterministic fixture,
``documents``, ``labels``, ``conversations``) over their whole size.  Doubles
produced by windowed or averaged arithmetic are rounded to 6 decimals so that
results compare exactly with another engine.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import INSULT_WORDS, Lexicon
from ..functions.literal import parse_list_literal
from ..functions.sql import register_functions
from ..functions.text import normalised, clean_text, is_content_term, parse_list_json, parse_list_split, words
from ..operators.anomaly import bounds_from_daily, daily_sentiment, daily_spikes, event_error_share, rolling_zscore
from ..operators.classifier import confusion, fit_text_model, held_out, labelled_texts
from ..operators.examples import term_examples
from ..operators.matching import phrases, term_document_counts
from ..operators.prepare import date_bounds, date_bounds_df, prepare, row_counts
from ..operators.refine import ambiguous_sample, label_sample, length_stars_scorer, recovery_stats, refine_daily
from ..operators.sentiment import ambiguous, with_sentiment
from ..operators.sketches import heavy_hitters, window_heavy_hitters
from ..operators.spikes import collect_spike_dates, spike_details, spike_samples, spike_top_terms
from ..operators.terms import daily_part, novel_terms, term_daily_counts, term_part, trending_terms
from ..operators.topics import emergence, emerging_topics, topic_sample, topic_sample_plan, topic_vocabulary
from ..session import materialize_table, scratch_path
from ..sources.fixtures import conversations_from_events, conversations_from_turns, python_list_repr
from ..sources.inputs import table
from ..sources.records import read_csv_records
from ..streaming.incremental import conversation_stream, counts_stream, current_counts, keep_counts
from .report import (Params, combined_counts, dashboard_daily, dashboard_novel, dashboard_spikes, dashboard_trending,
                     full_report, summary)

# sampling sizes used by the registered sampling queries (the sampling is the feature)
TOPIC_QUERY_SAMPLE = 12_000
TOPIC_MIN_RECENT = 1_000
AMBIGUOUS_QUERY_SAMPLE = 1_000
EXAMPLES_PER_TERM = 5
# counters of the heavy-hitter summaries: terms of over 1 / (k + 1) of all occurrences are found
WINDOW_COUNTERS, SOURCE_COUNTERS, WINDOW_DAYS = 32, 256, 7
INSULT_LEXICON = Lexicon(words=INSULT_WORDS, bigrams=(), threshold=0.15)


def _r6(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols if c in df.columns})


def fixture(spark: SparkSession, sf_dir: str, form: str = "array") -> DataFrame:
    # the fixture is computed from two narrow columns: deal those out before the text work, so that a table in a
    # few files uses the whole cluster
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return conversations_from_events(events.repartition(n, "event_id"), form=form)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(fixture(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sentiment(prepared(spark, sf_dir))


def _documents_prepared(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return prepare(docs, date_col=None, verbatim_col="text", conversation_id_col="doc_id", parser="text")


# --------------------------------------------------------------------------- text
def q_clean_documents(spark, sf_dir):
    p = _documents_prepared(spark, sf_dir)
    return p.select(F.col("conversation_id").cast("bigint").alias("doc_id"), "clean")


def _turn_lists(spark, sf_dir):
    return conversations_from_turns(table(spark, sf_dir, "conversations"))


def q_parse_split(spark, sf_dir):
    raw = _turn_lists(spark, sf_dir).select("conversation_id", python_list_repr("verbatims").alias("raw"))
    parsed = raw.select("conversation_id", parse_list_split("raw").alias("msgs"))
    return parsed.select("conversation_id", F.size("msgs").alias("n_messages"),
                         F.array_join("msgs", ". ").alias("verbatim"))


def q_parse_json(spark, sf_dir):
    raw = _turn_lists(spark, sf_dir).select("conversation_id", F.to_json("verbatims").alias("raw"))
    parsed = raw.select("conversation_id", parse_list_json("raw").alias("msgs"))
    return parsed.select("conversation_id", F.size("msgs").alias("n_messages"),
                         F.array_join("msgs", ". ").alias("verbatim"))


def q_conversation_verbatims(spark, sf_dir):
    p = prepare(_turn_lists(spark, sf_dir), date_col=None)
    return p.select("conversation_id", "n_messages", "verbatim", "clean")


def q_date_bounds(spark, sf_dir):
    return date_bounds_df(prepared(spark, sf_dir))


def q_sentiment_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("date", "conversation_id", "n_messages", "neg_score", "is_negative")


def q_document_insult_scores(spark, sf_dir):
    s = with_sentiment(_documents_prepared(spark, sf_dir), INSULT_LEXICON)
    s = s.select(F.col("conversation_id").cast("bigint").alias("doc_id"), "neg_score", "is_negative")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return s.join(labels, "doc_id", "left").select("doc_id", "toxic", "neg_score", "is_negative")


# --------------------------------------------------------------------------- daily
_DAILY_DOUBLES = ["mean_neg_score", "negative_ratio", "rolling_mean", "rolling_std", "z_score",
                  "negative_ratio_corrected", "rolling_mean_corrected", "rolling_std_corrected",
                  "z_score_corrected", "error_ratio"]


def q_daily_sentiment(spark, sf_dir):
    return _r6(daily_sentiment(scored(spark, sf_dir)), _DAILY_DOUBLES)


def q_daily_spikes(spark, sf_dir):
    return _r6(daily_spikes(scored(spark, sf_dir)), _DAILY_DOUBLES)


def q_event_error_spikes(spark, sf_dir):
    daily = event_error_share(table(spark, sf_dir, "events"))
    return _r6(rolling_zscore(daily, "error_ratio").orderBy("date"), _DAILY_DOUBLES)


def _scored_table(spark, sf_dir):
    """The cleaned and scored conversations, written once for the passes of one query."""
    return materialize_table(scored(spark, sf_dir).select(
        "date", "conversation_id", "verbatim", "n_messages", "clean", "neg_score", "is_negative"), "scored")


def _combined(spark, sf_dir):
    """(daily table, term counts) of one pass over the conversations."""
    both = combined_counts(scored(spark, sf_dir))
    return rolling_zscore(daily_part(both), "negative_ratio").orderBy("date"), term_part(both)


def q_spike_top_terms(spark, sf_dir):
    s = _scored_table(spark, sf_dir)
    return spike_top_terms(s, collect_spike_dates(daily_spikes(s)))


def q_spike_samples(spark, sf_dir):
    s = _scored_table(spark, sf_dir)
    return spike_samples(s, collect_spike_dates(daily_spikes(s)))


def _flat_details(details: DataFrame) -> DataFrame:
    """The nested lists as text, entry by entry in order."""
    terms = F.transform("top_negative_terms", lambda t: F.concat(t["term"], F.lit("="), t["count"].cast("string")))
    return details.select("date", F.array_join(terms, ", ").alias("top_negative_terms"),
                          F.array_join("sample_verbatims", " | ").alias("sample_verbatims"))


def q_spike_details(spark, sf_dir):
    s = _scored_table(spark, sf_dir)
    return _flat_details(spike_details(s, daily_spikes(s)))


# --------------------------------------------------------------------------- terms
def q_term_daily_counts(spark, sf_dir):
    return term_daily_counts(prepared(spark, sf_dir))


def q_combined_daily(spark, sf_dir):
    return _r6(_combined(spark, sf_dir)[0], _DAILY_DOUBLES)


def q_combined_term_counts(spark, sf_dir):
    return _combined(spark, sf_dir)[1]


def q_trending_terms(spark, sf_dir):
    return trending_terms(_combined(spark, sf_dir)[1])


def _novel(daily, counts):
    b = bounds_from_daily(daily)
    return novel_terms(counts, b.min_date, b.max_date)


def q_novel_terms(spark, sf_dir):
    return _novel(*_combined(spark, sf_dir))


def q_term_examples(spark, sf_dir):
    s = _scored_table(spark, sf_dir)
    return term_examples(s, trending_terms(term_part(combined_counts(s))), n=EXAMPLES_PER_TERM)


def q_novel_examples(spark, sf_dir):
    s = _scored_table(spark, sf_dir)
    both = combined_counts(s)
    return term_examples(s, _novel(daily_part(both), term_part(both)), n=EXAMPLES_PER_TERM, order="id")


# --------------------------------------------------------------------------- topics
def q_topic_sample_plan(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return topic_sample_plan(p, date_bounds(p).max_date, sample_size=TOPIC_QUERY_SAMPLE, min_recent=TOPIC_MIN_RECENT)


def q_topic_sample(spark, sf_dir):
    p = prepared(spark, sf_dir)
    day = date_bounds(p).max_date
    plan = topic_sample_plan(p, day, sample_size=TOPIC_QUERY_SAMPLE, min_recent=TOPIC_MIN_RECENT)
    sample = topic_sample(p, day, plan=plan)
    return sample.select("conversation_id", "is_recent", F.col("sample_rank").cast("int").alias("sample_rank"))


def q_topic_vocabulary(spark, sf_dir):
    return topic_vocabulary(prepared(spark, sf_dir).select("conversation_id", "clean"))


def q_emerging_topics(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return emerging_topics(p, date_bounds(p).max_date)


def q_topic_emergence(spark, sf_dir):
    """The arithmetic after the fit, on topic vectors computed from the events."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("d"))
    last = events.agg(F.max("d")).first()[0]
    recent = F.col("d") >= F.lit(last - dt.timedelta(days=14))
    raw = F.array(*[((F.col("event_id") * (k + 3)) % 7 + 1 + F.when(recent, k * k).otherwise(0)).cast("double") for k in range(5)])
    held = events.select(recent.alias("is_recent"), F.explode(F.array(raw)).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    held = held.withColumn("total", total)
    return emergence(held.select("is_recent", array_to_vector(F.transform("w", lambda x: x / F.col("total"))).alias("p")))


# --------------------------------------------------------------------------- refine
def q_ambiguous_conversations(spark, sf_dir):
    return ambiguous(scored(spark, sf_dir)).select("date", "conversation_id", "neg_score")


def q_ambiguous_sample(spark, sf_dir):
    s = ambiguous_sample(scored(spark, sf_dir), sample_size=AMBIGUOUS_QUERY_SAMPLE)
    return s.select("conversation_id", F.col("sample_rank").cast("int").alias("sample_rank"), "neg_score")


def q_recovery_stats(spark, sf_dir):
    return recovery_stats(scored(spark, sf_dir))


def _refined(spark, sf_dir):
    s = _scored_table(spark, sf_dir)
    # the daily pass also counts the ambiguous band the refinement needs
    return refine_daily(s, daily_spikes(s, ambiguous_band=(0.01, 0.30)))


def q_daily_corrected(spark, sf_dir):
    return _r6(_refined(spark, sf_dir)[0], _DAILY_DOUBLES)


def q_refine_totals(spark, sf_dir):
    return _refined(spark, sf_dir)[1]


# --------------------------------------------------------------------------- report
def q_summary(spark, sf_dir):
    daily, counts = _combined(spark, sf_dir)
    return summary(daily, trending_terms(counts), _novel(daily, counts))


def q_dashboard_daily(spark, sf_dir):
    return _r6(dashboard_daily(daily_spikes(scored(spark, sf_dir))), _DAILY_DOUBLES)


def q_dashboard_spikes(spark, sf_dir):
    return _r6(dashboard_spikes(daily_spikes(scored(spark, sf_dir))), _DAILY_DOUBLES)


def q_dashboard_trending(spark, sf_dir):
    return dashboard_trending(q_trending_terms(spark, sf_dir))


def q_dashboard_novel(spark, sf_dir):
    return dashboard_novel(q_novel_terms(spark, sf_dir))


def _report(spark, sf_dir, form="python"):
    """The full report with the model pass, from list texts."""
    return full_report(fixture(spark, sf_dir, form), params=Params(use_model=True, max_samples_per_term=EXAMPLES_PER_TERM),
                       parser="split" if form == "python" else "json", scorer_factory=length_stars_scorer, with_topics=False)


def q_report_daily(spark, sf_dir):
    return _r6(_report(spark, sf_dir)["daily_stats"], _DAILY_DOUBLES)


def q_report_summary(spark, sf_dir):
    return _report(spark, sf_dir, "json")["summary"]


def q_report_spike_details(spark, sf_dir):
    return _flat_details(_report(spark, sf_dir)["spike_details"])


# --------------------------------------------------------------------------- other texts
def _list_texts(spark, sf_dir, form):
    """Conversations whose messages arrive as one list text."""
    raw = F.to_json("verbatims") if form == "json" else python_list_repr("verbatims")
    return prepare(_turn_lists(spark, sf_dir).select("conversation_id", raw.alias("verbatims")), date_col=None, parser=form)


def q_prepared_split(spark, sf_dir):
    return _list_texts(spark, sf_dir, "split").select("conversation_id", "n_messages", "clean")


def q_prepared_json(spark, sf_dir):
    return _list_texts(spark, sf_dir, "json").select("conversation_id", "n_messages", "clean")


def _broken_lists(turns):
    """Turns inside malformed lists, every second one with a second list after the first: nothing may be lost."""
    text = F.coalesce("text", F.lit(""))
    one = F.to_json(F.array(text))
    raw = F.when(F.col("turn") % 2 == 0, F.concat(one, F.lit(", "), one)).otherwise(
        F.concat(F.lit("['"), text, F.lit("' x 'b']")))
    msgs = turns.select("conv_id", "turn", parse_list_json(raw).alias("msgs"))
    return msgs.select("conv_id", "turn", F.size("msgs").alias("n_messages"), F.array_join("msgs", " | ").alias("joined"))


def q_parse_json_broken_all(spark, sf_dir):
    """The malformed lists of all turns: empty ones and those with brackets, quotes, backslashes or control characters too."""
    return _broken_lists(table(spark, sf_dir, "conversations"))


def q_parse_literal(spark, sf_dir):
    """Conversations rendered the way Python prints a list of strings, and read back."""
    raw = _turn_lists(spark, sf_dir).select("conversation_id", python_list_repr("verbatims").alias("raw"))
    parsed = raw.select("conversation_id", parse_list_literal("raw").alias("msgs"))
    return parsed.select("conversation_id", F.size("msgs").alias("n_messages"), F.array_join("msgs", ". ").alias("verbatim"))


def hard_literals(turns: DataFrame) -> DataFrame:
    """Every turn's text in a list that only a whole literal reader understands, one of five forms by its number.

    0: beside None, a nested list and a signed number; 1: as two neighbouring strings, beside a tuple; 2: every
    character as an eight-digit escape; 3: as JSON, beside null; 4: on lines of its own, with a comment and a trailing comma.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    one = lambda t: F.regexp_replace(python_list_repr(F.array(t)), r"^\[|\]$", "")
    escaped = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.concat(
        F.lit("\\U"), F.lpad(F.hex(F.ascii(c)), 8, "0"))), "")
    forms = [F.concat(F.lit("[None, "), one(text), F.lit(", ['x', 1.50], -2]")),
             F.concat(F.lit("["), one(F.substring(text, F.lit(1), half)), F.lit(" "), one(F.substring(text, half + 1, F.length(text))),
                      F.lit(", ('p',)]")),
             F.concat(F.lit("['"), escaped, F.lit("']")),
             F.to_json(F.array(text, F.lit(None).cast("string"))),
             F.concat(F.lit("[  # messages\n  "), one(text), F.lit(",\n]"))]
    raw = forms[-1]
    for k, form in enumerate(forms[:-1]):
        raw = F.when(F.col("turn") % len(forms) == k, form).otherwise(raw)
    return turns.select("conv_id", "turn", raw.alias("raw"))


def q_parse_literal_hard(spark, sf_dir):
    """All turns inside lists with None, nested lists, neighbouring strings, escapes, null and comments: see `hard_literals`."""
    parsed = hard_literals(table(spark, sf_dir, "conversations")).select("conv_id", "turn", parse_list_literal("raw").alias("msgs"))
    return parsed.select("conv_id", "turn", F.size("msgs").alias("n_messages"), F.array_join("msgs", " | ").alias("joined"))


def q_prepared_literal(spark, sf_dir):
    return _list_texts(spark, sf_dir, "literal").select("conversation_id", "n_messages", "clean")


def q_turn_scores(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    s = with_sentiment(prepare(turns, date_col=None, verbatim_col="text", conversation_id_col="id", parser="text"))
    return s.select(F.col("conversation_id").alias("id"), "neg_score", "is_negative")


def q_document_vocabulary(spark, sf_dir):
    return topic_vocabulary(_documents_prepared(spark, sf_dir).select("conversation_id", "clean"))


def q_document_all_term_counts(spark, sf_dir):
    """Document frequency by source of all content terms."""
    docs = table(spark, sf_dir, "documents").select("source", "text").withColumn("clean", clean_text("text"))
    rows = docs.select("source", F.explode(F.array_distinct(words("clean"))).alias("term")).where(is_content_term("term"))
    return rows.groupBy("source", "term").agg(F.count(F.lit(1)).alias("count"))


def q_prepared_row_counts(spark, sf_dir):
    """What `prepare` reads and drops of all turns, observed while the prepared table is written.

    The turns' dates are days for users, missing for every third turn and texts that are no date for the others.
    """
    day = F.when(F.col("role") == "user", F.date_add(F.lit(dt.date(2024, 1, 1)), F.pmod("conv_id", F.lit(30)).cast("int")).cast("string"))
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.when(F.col("turn") % 3 != 2, F.coalesce(day, F.lit("no day"))).alias("day"))
    seen = Observation()
    materialize_table(prepare(turns, "day", "text", "id", "text", seen), "observed")
    return row_counts(spark, seen)


def _content(clean: str):
    return F.filter(words(clean), lambda t: is_content_term(t))


def q_window_heavy_terms(spark, sf_dir):
    """Terms of over 1/33 of the term occurrences (once a conversation) of any seven days, from merged daily summaries."""
    rows = prepared(spark, sf_dir).select("date", F.array_distinct(_content("clean")).alias("terms"))
    return window_heavy_hitters(rows, "date", "terms", WINDOW_DAYS, WINDOW_COUNTERS).withColumnRenamed("value", "term")


def q_source_heavy_terms(spark, sf_dir):
    """Terms of over 1/257 of all term occurrences of a source's documents."""
    docs = table(spark, sf_dir, "documents").select("source", clean_text("text").alias("clean"))
    found = heavy_hitters(docs.select("source", _content("clean").alias("terms")), "source", "terms", SOURCE_COUNTERS)
    return found.withColumnsRenamed({"grp": "source", "value": "term"})


def q_composed_documents(spark, sf_dir):
    """`clean_documents` of texts in decomposed form (the stand-in input), composed before cleaning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.pandas_udf(normalised("NFD"), "string")("text").alias("text"))
    docs = prepare(docs, date_col=None, verbatim_col="text", conversation_id_col="doc_id", parser="text", compose=True)
    return docs.select(F.col("conversation_id").cast("bigint").alias("doc_id"), "clean")


def q_incremental_counts(spark, sf_dir):
    """Daily and term counts of conversations that arrive in files, some twice, kept by a streaming query.

    The files are the stand-in input: the fixture, a third of it once more.  Day rows have a null term.
    """
    conv = fixture(spark, sf_dir)
    again = conv.where(F.abs(F.xxhash64("conversation_id")) % 3 == 0)
    source = materialize_table(conv.unionByName(again).repartition(6), "arriving")
    stream = conversation_stream(spark, source.inputFiles()[0].rsplit("/", 1)[0], source.schema, max_files_per_trigger=3)
    out = scratch_path(spark, "counts")
    keep_counts(counts_stream(stream), out, scratch_path(spark, "stream"), trigger_once=True).awaitTermination()
    counts = current_counts(spark, out)
    return counts.select("date", "term", "count", F.when(F.col("term").isNull(), F.col("negative_count")).alias("negative_count"))


def q_csv_turns(spark, sf_dir):
    """All turns as multi-line CSV, read back by splits aligned to records; ``bad``: the record did not fit the schema.

    The files are the stand-in input: each turn's role, a line break, its text and a second line with quotes and commas.
    """
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", F.concat_ws("\n", "role", "text", F.lit('"x", y')).alias("text"), "turn")
    path = scratch_path(spark, "csv")
    # every seventh turn's number cannot be read
    turn = F.when(F.col("conv_id") % 7 == 3, F.concat(F.lit("turn "), F.col("turn"))).otherwise(F.col("turn").cast("string"))
    turns.withColumn("turn", turn).write.option("header", True).option("escape", '"').option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = read_csv_records(spark, path, "conv_id long, text string, turn long")
    return rows.select("conv_id", "turn", "text", F.col("_corrupt_record").isNotNull().alias("bad"))


def q_sql_turn_scores(spark, sf_dir):
    """`turn_scores` written in SQL with the registered functions."""
    register_functions(spark)
    return spark.sql("""
        SELECT id, neg_score(clean) AS neg_score, is_negative(clean) AS is_negative
        FROM (SELECT concat_ws('-', conv_id, turn) AS id, clean_text(text) AS clean FROM {turns}) WHERE length(clean) > 2""",
                     turns=table(spark, sf_dir, "conversations"))


def q_sql_message_rows(spark, sf_dir):
    """Every message of every list text, by the table function."""
    register_functions(spark)
    raw = _turn_lists(spark, sf_dir).select("conversation_id", python_list_repr("verbatims").alias("raw"))
    return spark.sql("SELECT l.conversation_id, m.pos, m.message FROM {lists} AS l, LATERAL message_rows(l.raw) AS m", lists=raw)


def q_document_phrase_counts(spark, sf_dir):
    """Documents that hold each word and each pair of neighbouring words of the benchmark's texts, between word edges."""
    terms = phrases(table(spark, sf_dir, "benchmark").select(clean_text("text").alias("clean")), "clean")
    docs = table(spark, sf_dir, "documents").select("doc_id", clean_text("text").alias("clean"))
    return term_document_counts(docs, terms, "doc_id", "clean")


# --------------------------------------------------------------------------- fitted model
def _text_model(spark, sf_dir):
    rows = labelled_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return fit_text_model(rows), rows


def q_document_model_labels(spark, sf_dir):
    """Every document's stars by the model fitted on ``labels`` (no row without both labels to fit on)."""
    model, _ = _text_model(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", clean_text(F.coalesce("text", F.lit(""))).alias("clean"))
    if model is None:
        return docs.limit(0).select("doc_id", held_out("doc_id").alias("held_out"), F.lit("").alias("model_label"))
    return model.label(docs).select("doc_id", held_out("doc_id").alias("held_out"), "model_label")


def q_document_recovery(spark, sf_dir):
    """Of the documents the insult lexicon is unsure about: the share the model calls negative, corrected by its errors on
    those of them that are labelled and held out."""
    unsure = ambiguous(with_sentiment(_documents_prepared(spark, sf_dir), INSULT_LEXICON))
    model, rows = _text_model(spark, sf_dir)
    schema = ("n_ambiguous long, n_recovered long, recovery_rate double, sensitivity double, specificity double, "
              "corrected_rate double, error_bound double")
    if model is None:
        return spark.createDataFrame([], schema)
    same = rows.where("held_out").join(unsure.select(F.col("conversation_id").cast("long").alias("id")), "id", "left_semi")
    errors = confusion(model, same)
    n, positives = label_sample(unsure.select("clean"), model).agg(F.count(F.lit(1)), F.count_if("model_negative")).first()
    rate, bound = errors.corrected(positives, n)
    return spark.createDataFrame([(n, positives, positives / n if n else 0.0, errors.sensitivity, errors.specificity, rate, bound)], schema)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_documents": q_clean_documents,
    "parse_split": q_parse_split,
    "parse_json": q_parse_json,
    "conversation_verbatims": q_conversation_verbatims,
    "date_bounds": q_date_bounds,
    "sentiment_scores": q_sentiment_scores,
    "document_insult_scores": q_document_insult_scores,
    "daily_sentiment": q_daily_sentiment,
    "daily_spikes": q_daily_spikes,
    "event_error_spikes": q_event_error_spikes,
    "spike_top_terms": q_spike_top_terms,
    "spike_samples": q_spike_samples,
    "term_daily_counts": q_term_daily_counts,
    "trending_terms": q_trending_terms,
    "novel_terms": q_novel_terms,
    "term_examples": q_term_examples,
    "topic_sample_plan": q_topic_sample_plan,
    "topic_sample": q_topic_sample,
    "topic_vocabulary": q_topic_vocabulary,
    "emerging_topics": q_emerging_topics,
    "ambiguous_conversations": q_ambiguous_conversations,
    "ambiguous_sample": q_ambiguous_sample,
    "recovery_stats": q_recovery_stats,
    "daily_corrected": q_daily_corrected,
    "summary": q_summary,
    "dashboard_daily": q_dashboard_daily,
    "dashboard_spikes": q_dashboard_spikes,
    "dashboard_trending": q_dashboard_trending,
    "dashboard_novel": q_dashboard_novel,
    "spike_details": q_spike_details,
    "combined_daily": q_combined_daily,
    "combined_term_counts": q_combined_term_counts,
    "novel_examples": q_novel_examples,
    "topic_emergence": q_topic_emergence,
    "refine_totals": q_refine_totals,
    "report_daily": q_report_daily,
    "report_summary": q_report_summary,
    "report_spike_details": q_report_spike_details,
    "prepared_split": q_prepared_split,
    "prepared_json": q_prepared_json,
    "parse_literal": q_parse_literal,
    "parse_literal_hard": q_parse_literal_hard,
    "prepared_literal": q_prepared_literal,
    "parse_json_broken_all": q_parse_json_broken_all,
    "turn_scores": q_turn_scores,
    "document_vocabulary": q_document_vocabulary,
    "document_all_term_counts": q_document_all_term_counts,
    "document_phrase_counts": q_document_phrase_counts,
    "prepared_row_counts": q_prepared_row_counts,
    "incremental_counts": q_incremental_counts,
    "csv_turns": q_csv_turns,
    "composed_documents": q_composed_documents,
    "window_heavy_terms": q_window_heavy_terms,
    "source_heavy_terms": q_source_heavy_terms,
    "sql_turn_scores": q_sql_turn_scores,
    "sql_message_rows": q_sql_message_rows,
    "document_model_labels": q_document_model_labels,
    "document_recovery": q_document_recovery,
}
