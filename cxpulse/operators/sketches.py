"""Heavy hitters by mergeable Misra-Gries summaries.

A summary of ``k`` counters holds, for each group (a day, a source), counts that fall short of the true ones by at most
its ``error``, where ``error * (k + 1) <= total - sum of the counters``: every value with more than ``total / (k + 1)``
rows has a counter.  Summaries merge: counters add up, the (k + 1)-th largest is taken off all, and what it takes off is
added to the error.  So one table of summaries a day answers for any window of days.

`summarise` keeps a summary a group in every task while it reads, so at most ``k`` counters a task and group are
shuffled, whatever the number of distinct values; `merge` adds them up.  `heavy_hitters` counts the candidates exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize_table, ship_package

COUNTERS = 256
_SCHEMA = "grp string, value string, count long, error long, total long"
_ARROW = pa.schema([("grp", pa.string()), ("value", pa.string()), ("count", pa.int64()), ("error", pa.int64()),
                    ("total", pa.int64())])


class Summary:
    """One Misra-Gries summary; counters may grow to twice ``k`` before they are cut back, which costs O(1) a row."""

    def __init__(self, k: int):
        if k < 1:
            raise ValueError("a summary needs at least one counter")
        self.k, self.counts, self.error, self.total = k, Counter(), 0, 0

    def add(self, values: list) -> None:
        self.counts.update(values)
        self.total += len(values)
        if len(self.counts) > 2 * self.k:
            self.cut()

    def cut(self) -> None:
        if len(self.counts) > self.k:
            least = sorted(self.counts.values(), reverse=True)[self.k]
            self.counts = Counter({v: n - least for v, n in self.counts.items() if n > least})
            self.error += least


def _summaries(k: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for group, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if values:
                    held.setdefault(group, Summary(k)).add([v for v in values if v is not None])
        for group, s in held.items():
            s.cut()
            n = len(s.counts)
            # the group's own row has no value; it carries what the counters lack and the number of rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * (n + 1), pa.string()), pa.array([None, *s.counts], pa.string()),
                 pa.array([0, *s.counts.values()], pa.int64()), pa.array([s.error] + [0] * n, pa.int64()),
                 pa.array([s.total] + [0] * n, pa.int64())], schema=_ARROW)
    return run


def summarise(df: DataFrame, group_col: str, values_col: str, k: int = COUNTERS) -> DataFrame:
    """(grp, value, count, error, total): a summary a group of all elements of an array column.

    ``grp`` is the group as a string (null is a group); null elements and arrays count nothing.  A group's row
    without a value holds ``error`` and ``total``.  The groups are to be few (days, sources): each task holds one
    summary of each it meets.
    """
    ship_package(df.sparkSession)
    if k < 1:
        raise ValueError("a summary needs at least one counter")
    rows = df.select(F.col(group_col).cast("string").alias("grp"), F.col(values_col).cast("array<string>").alias("value"))
    return merge(rows.mapInArrow(_summaries(k), _SCHEMA), k)


def merge(summaries: DataFrame, k: int = COUNTERS) -> DataFrame:
    """The rows of several summaries a group as one summary a group, of at most ``k`` counters.

    To merge over windows, give each day's rows the names of the windows they belong to as ``grp`` first.
    """
    added = summaries.groupBy("grp", "value").agg(*[F.sum(c).alias(c) for c in ("count", "error", "total")])
    # the group's own row, then the k + 1 largest counters, picked before the shuffle; the least of them is taken off
    group = Window.partitionBy("grp")
    places = group.orderBy(F.col("value").isNotNull(), F.desc("count"), F.asc("value"))
    top = added.withColumn("place", F.row_number().over(places)).where(F.col("place") <= k + 2)
    top = top.withColumn("least", F.coalesce(F.max(F.when(F.col("place") == k + 2, F.col("count"))).over(group), F.lit(0)))
    own = F.col("value").isNull()
    return top.where(own | (F.col("count") > F.col("least"))).select(
        "grp", "value", F.when(own, F.lit(0)).otherwise(F.col("count") - F.col("least")).alias("count"),
        F.when(own, F.col("error") + F.col("least")).otherwise(F.lit(0)).alias("error"), "total")


def bounds(summaries: DataFrame) -> DataFrame:
    """(grp, value, low, high, total): between which counts each value with a counter lies."""
    group = Window.partitionBy("grp")  # at most k + 1 rows each
    rows = summaries.withColumns({"e": F.max("error").over(group), "t": F.max("total").over(group)}).where("value is not null")
    return rows.select("grp", "value", F.col("count").alias("low"), (F.col("count") + F.col("e")).alias("high"), F.col("t").alias("total"))


def heavy_hitters(df: DataFrame, group_col: str, values_col: str, k: int = COUNTERS) -> DataFrame:
    """(grp, value, count, total): all values with more than ``total / (k + 1)`` of their group's elements, exactly.

    A first pass finds at most ``k`` candidates a group, a second one counts them alone.
    """
    found = _candidates(summarise(df, group_col, values_col, k), k)
    hit = _elements(df, group_col, values_col).join(found, F.col("g").eqNullSafe(F.col("grp")) & (F.col("v") == F.col("value")))
    hit = hit.groupBy("grp", "value", "total").agg(F.count(F.lit(1)).alias("count"))
    return hit.where(F.col("count") * (k + 1) > F.col("total")).select("grp", "value", "count", "total")


def window_heavy_hitters(df: DataFrame, date_col: str, values_col: str, days: int, k: int = COUNTERS) -> DataFrame:
    """(date, value, count, total): the same for every window of ``days`` days, named by its last day.

    The table is read once for the daily summaries, which are merged for all windows, and once to count the
    candidates by day.  Windows end on the table's days and those between them; rows without a date count nowhere.
    """
    daily = materialize_table(summarise(df.where(F.col(date_col).isNotNull()), date_col, values_col, k), "summaries")
    found = _candidates(merge(windows_of(daily, days), k), k)
    values = found.select("value").distinct()
    hit = _elements(df, date_col, values_col).join(values, F.col("v") == F.col("value")).groupBy("g", "value").agg(
        F.count(F.lit(1)).alias("n"))
    hit = hit.select(F.explode(F.sequence(F.col("g").cast("date"), F.date_add(F.col("g").cast("date"), days - 1))).alias("date"),
                     F.col("value").alias("v"), "n").groupBy("date", "v").agg(F.sum("n").alias("count"))
    found = found.select(F.col("grp").cast("date").alias("end"), "value", "total")
    hit = hit.join(found, (F.col("date") == F.col("end")) & (F.col("v") == F.col("value")))
    return hit.where(F.col("count") * (k + 1) > F.col("total")).select("date", "value", "count", "total")


def windows_of(daily: DataFrame, days: int) -> DataFrame:
    """Daily summaries under the name of every window of ``days`` days they lie in (a window is named by its last day).

    Windows that would end after the last day of the table are left out.
    """
    if days < 1:
        raise ValueError("a window has at least one day")
    day = F.col("grp").cast("date")
    last = daily.agg(F.max(day).alias("last"))  # one row
    ends = daily.withColumn("end", F.explode(F.sequence(day, F.date_add(day, days - 1))))
    return ends.join(F.broadcast(last), F.col("end") <= F.col("last")).select(
        F.col("end").cast("string").alias("grp"), "value", "count", "error", "total")


def _candidates(summaries: DataFrame, k: int) -> DataFrame:
    """Values that may pass, at most ``k`` a group; stored, so that the join with them is chosen by their true size."""
    likely = bounds(summaries).where(F.col("high") * (k + 1) > F.col("total"))
    return materialize_table(likely.select("grp", "value", "total"), "candidates")


def _elements(df: DataFrame, group_col: str, values_col: str) -> DataFrame:
    return df.select(F.col(group_col).cast("string").alias("g"), F.explode(F.col(values_col).cast("array<string>")).alias("v"))
