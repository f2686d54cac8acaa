"""Exact, deterministic fixed-size samples without a global sort.

The sample of size n is "the n rows with the smallest md5(seed | key)" — the
same rows on any cluster layout, reproducible in SQL.  The hash space is cut
into 65 536 bins; one aggregation counts the rows of each (segment, bin), the
running sum of these counts gives every bin its first rank, and only bins that
start below n are read and ranked, each by itself.  No task ever sorts more
than a bin, whatever n is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DEFAULT_SEED = 42


def hash_key(key_cols: list[str], seed: int = DEFAULT_SEED, others: list[str] | None = None) -> Column:
    """md5(seed | key); a row whose key is null throughout is hashed by its other columns, so that such rows spread."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    if not others:
        return F.md5(key)
    no_key = F.lit(True)
    for c in key_cols:
        no_key = no_key & F.col(c).isNull()
    row = F.concat_ws("|", F.lit(str(seed)), F.lit("null"), F.xxhash64(*others).cast("string"))
    return F.md5(F.when(no_key, row).otherwise(key))


def exact_sample(df: DataFrame, sizes: dict, key_cols: list[str], segment_col: str | None = None,
                 seed: int = DEFAULT_SEED, materialized: bool = True) -> DataFrame:
    """The ``sizes[s]`` rows of smallest hash in each segment ``s`` (None: all of it), with ``sample_rank`` from 1.

    Without ``segment_col`` pass ``{None: n}``.  Segments not listed give nothing.  Ties in the hash (repeated
    keys) are broken by the key columns, then by a hash of the whole row.  The input is read twice: for the counts
    of the bins and for the bins that are taken.
    """
    seg = F.col(segment_col) if segment_col else F.lit(None).cast("string")
    others = [c for c in df.columns if c not in key_cols]
    keyed = df.withColumns({"_h": hash_key(key_cols, seed, others), "_seg": seg})
    keyed = keyed.withColumn("_bin", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    limit = F.lit(0).cast("long")
    for s, n in sizes.items():
        here = F.col("_seg").isNull() if s is None else F.col("_seg") == F.lit(s)
        limit = F.when(here, F.lit(2 ** 62 if n is None else max(0, int(n)))).otherwise(limit)
    counts = keyed.groupBy("_seg", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_seg").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.select("_seg", "_bin", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), limit.alias("_limit"))
    bins = bins.where("_before < _limit").withColumnsRenamed({"_seg": "_s", "_bin": "_b"})
    taken = keyed.join(bins, keyed["_seg"].eqNullSafe(bins["_s"]) & (keyed["_bin"] == bins["_b"]))
    order = Window.partitionBy("_seg", "_bin").orderBy("_h", *key_cols, F.xxhash64(*df.columns))
    ranked = taken.withColumn("sample_rank", (F.col("_before") + F.row_number().over(order)))
    out = ranked.where(F.col("sample_rank") <= F.col("_limit")).select(*df.columns, "sample_rank")
    return materialize(out) if materialized else out


def topic_sample_sizes(n_recent_total: int, n_history_total: int, sample_size: int | None,
                       min_recent: int = 10_000) -> tuple[int, int]:
    """Recent / history sample sizes.

    Recent gets its share of the sample, at least ``min_recent``, history the rest; what one segment cannot fill
    goes to the other.  Without ``sample_size`` both are taken whole.
    """
    if sample_size is None:
        return n_recent_total, n_history_total
    total = n_recent_total + n_history_total
    ratio = n_recent_total / total if total else 0.0
    wanted = max(int(sample_size * ratio), min_recent)
    n_recent = min(wanted, n_recent_total, sample_size)
    n_history = min(sample_size - n_recent, n_history_total)
    return min(n_recent_total, sample_size - n_history), n_history
