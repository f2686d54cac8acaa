"""Mixing sources to target weights by entropy balancing.

Among all non-negative document rates whose tokens meet every source's target,
the ones closest to 1 in token-weighted relative entropy are exponential tilts:
``rate = exp(lambda_source)``.  ``lambda`` minimises the convex dual
``S exp(lambda) - T lambda`` (S: tokens of the source, T: its target).  The
constraints touch disjoint sources, so the Hessian is diagonal and Newton's
steps run for all sources at once over the per-source sums, which one partial
aggregation of the documents gives.

Rates are rounded into copies: everybody gets the whole part, and documents in
hash order get one copy more until the source's remainder is used up.  The
cut in that order is found by two histograms of the hash (1024 bins each, so
no window ever sees more than that, or about a millionth of a source).  What is
then left of the remainder is below the cutting document's size, which can be
nearly all of it.  So the cut is repeated over all documents not taken that
still fit, until what is left is below ``FEW`` words; there at most as many
different sizes can fit, and one fold over the counts of all documents by size
takes the rest, long documents first.  No document not taken fits in the end.

Everything is DataFrame operations: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, text_of, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_RATE = 3
NEWTON_STEPS = 128  # steps of at most one below the root, quadratic near it: enough for rates down to exp(-100)
FEW = 1000  # words below which the sizes that still fit are counted one by one (ranks below it are cut on the map side)
SEED = 42


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from (source, source_size) rows: shares by repeating weights, water-filled below the cap.

    One row a source: this table is the catalogue of sources, not data, and is ordered by one window.
    """
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * max_rate
    t = sizes.withColumn("w", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    t = t.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everyone)).withColumn(
        "all_w", F.sum("w").over(everyone))
    # sources in the order in which a rising level reaches their caps; the level each would see
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("capped", F.col("w") * level > F.col("cap"))
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everyone)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everyone)
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(
        F.col("w") * left / free).alias("target"))


def tilt(source_size: Column, target: Column, steps: int = NEWTON_STEPS) -> Column:
    """The dual's root lambda by Newton's method from 0 (null where the target or the source is empty)."""
    newton = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0),
                         lambda lam, _: lam - (source_size * F.exp(lam) - target) / (source_size * F.exp(lam)))
    return F.when((source_size > 0) & (target > 0), newton)


def _cut(mass: DataFrame, level: str, want: str) -> DataFrame:
    """(source, level, rest): per source the bin in which the running mass passes ``want``, and what is wanted of it."""
    w = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    run = mass.withColumn("before", F.coalesce(F.sum("mass").over(w), F.lit(0)))
    here = run.where((F.col("before") <= F.col(want)) & (F.col("before") + F.col("mass") > F.col(want)))
    return here.select("source", level, (F.col(want) - F.col("before")).alias("rest"))


def _with_source(rows: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
    """Join on source, null equal to null (a hot source is split by the join's skew handling)."""
    t = table.withColumnRenamed("source", "__source")
    return rows.join(t, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def _hash_prefix(units: DataFrame) -> DataFrame:
    """``units`` (doc_id, source, priority, size, mass, want: one value a source) with ``taken``: those up to the first one
    in hash order with which the source's masses pass ``want``."""
    keyed = units.withColumn("bin1", F.shiftrightunsigned("priority", 54)).withColumn(
        "bin2", F.shiftrightunsigned("priority", 44).bitwiseAND(F.lit(1023)))
    cut1 = _cut(keyed.groupBy("source", "bin1").agg(F.sum("mass").alias("mass"), F.first("want").alias("want")),
                "bin1", "want")
    cut1 = checkpointed(cut1.select("source", F.col("bin1").alias("cut1"), F.col("rest").alias("rest1")))
    near = _with_source(keyed, cut1)
    edge1 = near.where("bin1 = cut1")
    cut2 = _cut(edge1.groupBy("source", "bin2").agg(F.sum("mass").alias("mass"), F.first("rest1").alias("rest1")),
                "bin2", "rest1")
    cut2 = checkpointed(cut2.select("source", F.col("bin2").alias("cut2"), F.col("rest").alias("rest2")))
    near = _with_source(near, cut2)
    # inside the two cutting bins: whole units while they fit
    edge = near.where("bin1 = cut1 and bin2 = cut2")
    w = Window.partitionBy("source").orderBy("priority", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("taken", F.sum("mass").over(w) <= F.col("rest2"))
    # with no cutting bin the whole source is wanted once more
    sure = near.withColumn("taken", F.when(F.col("cut1").isNull(), True).otherwise(
        (F.col("bin1") < F.col("cut1")) | ((F.col("bin1") == F.col("cut1")) & (F.col("bin2") < F.col("cut2")))))
    outside = F.coalesce((F.col("bin1") != F.col("cut1")) | (F.col("bin2") != F.col("cut2")), F.lit(True))
    cols = ["doc_id", "source", "priority", "size", "mass", "taken"]
    return sure.where(outside).select(cols).unionByName(edge.select(cols))


def _largest_first(units: DataFrame) -> DataFrame:
    """Those of ``units`` (as above, masses from 1 to a ``want`` below ``FEW``) that fill ``want`` taken by falling mass.

    The masses of a source are at most ``FEW`` different ones, each with its count; equal masses go by hash order.
    """
    counts = units.groupBy("source", "mass").agg(F.count("*").alias("n"), F.first("want").alias("want"))
    lists = counts.groupBy("source").agg(F.first("want").alias("want"), F.reverse(F.sort_array(F.collect_list(
        F.struct("mass", "n")))).alias("list"))
    none = F.array().cast("array<struct<fits:bigint,n:bigint>>")
    fold = F.aggregate(
        "list", F.struct(F.col("want").alias("want"), none.alias("picked")),
        lambda acc, x: F.when(x["mass"] <= acc["want"], F.struct(
            (acc["want"] - x["mass"] * F.least(x["n"], F.floor(acc["want"] / x["mass"]))).alias("want"),
            F.concat(acc["picked"], F.array(F.struct(
                x["mass"].alias("fits"), F.least(x["n"], F.floor(acc["want"] / x["mass"])).alias("n")))).alias("picked"),
        )).otherwise(acc))
    quota = lists.select("source", F.inline(fold["picked"]))
    t = quota.withColumnRenamed("source", "__source")
    nth = F.row_number().over(Window.partitionBy("source", "mass").orderBy("priority", "doc_id", "size"))
    short = units.withColumn("nth", nth).where(F.col("nth") < FEW)  # no mass fits as often as that
    return short.join(t, F.col("source").eqNullSafe(F.col("__source")) & (F.col("mass") == F.col("fits"))
                      & (F.col("nth") <= F.col("n")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_rate: int = MAX_RATE, seed: int = SEED) -> DataFrame:
    """One row per distinct (id, text, source): doc_id, source, priority, size, repeats, source_size, target, copies.

    ``size``: words of the text (null: 0).  ``repeats``: how many rows are equal in id, text and source; all of them
    get the same ``copies`` (0 to ``max_rate``).  A null source is a source of its own, last in order.  Empty texts
    have size 0 and take what whole copies their source's rate gives.  An empty table gives an empty result.
    Reruns agree: rows that tie in the hash order are equal and share one unit.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        priority(F.col(id_col).cast("long"), text_of(text_col), seed).alias("priority"),
        word_count(text_col).alias("size"))
    units = checkpointed(rows.groupBy("doc_id", "source", "priority", "size").agg(F.count("*").alias("repeats")))
    mass = F.col("size") * F.col("repeats")
    by_source = units.groupBy("source").agg(F.sum(mass).alias("source_size"))
    plan = source_targets(by_source, weights, max_rate).withColumn("lambda", tilt(F.col("source_size"), F.col("target")))
    rate = F.least(F.coalesce(F.exp("lambda"), F.lit(0.0)), F.lit(float(max_rate)))
    plan = plan.withColumn("whole", F.floor(rate + F.lit(1e-9)).cast("long")).withColumn(
        "extra", F.greatest(F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5), F.lit(0)).cast("long"))
    plan = checkpointed(plan.select("source", "source_size", "target", "whole", "extra"))

    cols = ["doc_id", "source", "priority", "size"]
    want = checkpointed(plan.where("extra > 0").select("source", F.col("extra").alias("want")))
    left = _with_source(units.select(*cols, mass.alias("mass")), want, "inner")
    more = units.select(cols).limit(0)
    few = 0
    while few is not None:  # each round takes the first document left of every source, or all that are left
        dealt = checkpointed(_hash_prefix(left))
        more = more.unionByName(dealt.where("taken").select(cols))
        want = checkpointed(_with_source(want, dealt.groupBy("source").agg(
            F.sum(F.when(F.col("taken"), F.col("mass")).otherwise(0)).alias("got"))).select(
            "source", (F.col("want") - F.coalesce("got", F.lit(0))).alias("want")).where("want > 0"))
        left = _with_source(dealt.where("not taken and mass > 0").select(*cols, "mass"), want, "inner").where("mass <= want")
        few = left.agg(F.max("want")).first()[0]
        if few is not None and few < FEW:
            more = more.unionByName(_largest_first(left).select(cols))
            break
    more = more.withColumn("more", F.lit(1))
    same = [F.col(f"u.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("doc_id", "source", "priority", "size")]
    out = units.alias("u").join(more.alias("m"), same[0] & same[1] & same[2] & same[3], "left").select(
        "u.*", F.coalesce("more", F.lit(0)).alias("more"))
    return _with_source(out, plan).select(
        "doc_id", "source", "priority", "size", "repeats", "source_size", "target",
        F.least(F.col("whole") + F.col("more"), F.lit(max_rate)).cast("long").alias("copies"))


def priority(doc_id: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, text)


def mixed_sizes(docs: DataFrame, **kw) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repeats counted)."""
    units = mix(docs, **kw)
    rows = units.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    seed: int = SEED, **kw) -> DataFrame:
    """The input rows, each as often as the mix copies it, with their own columns."""
    unit_id, unit_source, unit_key, copies, key, i = fresh(
        docs, "unit_id", "unit_source", "unit_key", "unit_copies", "priority", "copy")
    units = mix(docs, id_col, text_col, source_col, seed=seed, **kw).where("copies > 0").select(
        F.col("doc_id").alias(unit_id), F.col("source").alias(unit_source), F.col("priority").alias(unit_key),
        F.col("copies").alias(copies))
    keyed = docs.withColumn(key, priority(F.col(id_col).cast("long"), text_of(text_col), seed))
    joined = keyed.join(units, (F.col(key) == F.col(unit_key))
                        & F.col(id_col).cast("long").eqNullSafe(F.col(unit_id))
                        & F.col(source_col).cast("string").eqNullSafe(F.col(unit_source)))
    return joined.withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
