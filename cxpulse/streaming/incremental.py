"""Incremental daily and term statistics with Structured Streaming.

The analysis itself is batch: the reference processes its table in bounded
chunks only to cap memory.  The Spark form of "process the table chunk by
chunk and keep running counts" is a streaming query over the conversation
files: ``prepare`` and the lexicon score are stateless column expressions, and
the state kept between micro-batches is one row per calendar day
(`daily_counts_stream`), or one per day and term and the ids seen so far
(`counts_stream`, which counts a conversation that arrives twice once).  Each
micro-batch hands the days it changed (``update`` mode) to ``foreachBatch`` — e.g. to recompute the rolling z-score
on the (small) daily table — or to any streaming sink.  `keep_counts` writes them
as a table that `current_counts` reads at any time, also while the query runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lexicon import DEFAULT_LEXICON, Lexicon
from ..operators.prepare import prepare
from ..operators.sentiment import with_sentiment
from ..operators.terms import daily_and_term_counts


def conversation_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None,
                        fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def daily_counts_stream(stream: DataFrame, date_col: str = "date", verbatim_col: str = "verbatims",
                        conversation_id_col: str = "conversation_id", parser: str = "split",
                        lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Streaming daily aggregate: total, negative count and score sum per day.

    Sums (not means) are kept as state so that micro-batches combine exactly;
    ``finish_daily`` turns them into the batch ``daily_sentiment`` schema.
    """
    scored = with_sentiment(prepare(stream, date_col, verbatim_col, conversation_id_col, parser), lexicon)
    return scored.groupBy("date").agg(
        F.count(F.lit(1)).alias("total_conversations"),
        F.count_if("is_negative").alias("negative_count"),
        F.sum("neg_score").alias("neg_score_sum"),
    )


def finish_daily(counts: DataFrame) -> DataFrame:
    return counts.select(
        "date", "total_conversations", "negative_count",
        (F.col("neg_score_sum") / F.col("total_conversations")).alias("mean_neg_score"),
        (F.col("negative_count").cast("double") / F.col("total_conversations").cast("double")).alias("negative_ratio"),
    )


def start(agg: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str,
          output_mode: str = "update", trigger_once: bool = False) -> StreamingQuery:
    """Run ``agg`` with ``foreachBatch``; ``checkpoint`` must be a shared folder."""
    writer = agg.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def counts_stream(stream: DataFrame, date_col: str = "date", verbatim_col: str = "verbatims",
                  conversation_id_col: str = "conversation_id", parser: str = "split", lexicon: Lexicon = DEFAULT_LEXICON,
                  within: str | None = None) -> DataFrame:
    """Streaming form of `terms.daily_and_term_counts`: one row a day (null term) and a (day, term), for update mode.

    A conversation counts once, when its id is first met with a usable date and text; rows without an id are told apart
    by day and text.  The ids are kept for ever, so any order, delay and repetition gives the batch tables; with
    ``within`` (such as "30 days") they are kept that long behind the last date, and rows that come later than that
    are dropped.
    """
    rows = prepare(stream, date_col, verbatim_col, conversation_id_col, parser)
    key = F.coalesce(F.concat(F.lit("i"), "conversation_id"),
                     F.concat(F.lit("t"), F.sha2(F.concat_ws("\n", F.col("date").cast("string"), "verbatim"), 256)))
    rows = rows.withColumn("_key", key)
    if within:
        rows = rows.withColumn("_time", F.col("date").cast("timestamp")).withWatermark("_time", within)
        rows = rows.dropDuplicatesWithinWatermark(["_key"])
    else:
        rows = rows.dropDuplicates(["_key"])
    return daily_and_term_counts(with_sentiment(rows.select("date", "clean"), lexicon))


def keep_counts(counts: DataFrame, path: str, checkpoint: str, trigger_once: bool = False) -> StreamingQuery:
    """Write each micro-batch's changed counts under ``path``, one folder a batch.

    A batch that is run again after a failure replaces its own folder, so nothing counts twice.  ``path`` and
    ``checkpoint`` must be in a shared folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return start(counts, write, checkpoint, trigger_once=trigger_once)


_COUNTS = "date date, term string, count long, negative_count long, score_sum double, ambiguous_count long"


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last written row of each (day, term); `terms.daily_part` and `term_part` split it into the batch tables."""
    rows = spark.read.schema(_COUNTS + ", batch long").parquet(path)
    values = ["count", "negative_count", "score_sum", "ambiguous_count"]
    last = rows.groupBy("date", "term").agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select("date", "term", *[F.col(f"v.{c}").alias(c) for c in values])
