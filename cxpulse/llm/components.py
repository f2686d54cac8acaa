"""Connected components by randomised contraction.

Each round gives every vertex a random priority, maps it to the vertex of
smallest priority in its closed neighbourhood and contracts the graph along
that map; the expected number of vertices falls by a constant factor a round,
whatever the shape of the graph (paths, stars and cliques included).  All work
is joins and partial aggregates over (u, v) rows: no group is collected, and a
hub's rows can be split by the skew handling of the joins.  What a round
leaves is checkpointed to the shared folder, so a lost executor costs at most
one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every vertex of the undirected graph; equal roots mean one component.

    Vertices are longs.  Loops, repeated and reversed edges are harmless, rows with a null end are ignored; an
    empty edge table gives an empty result.
    """
    level = checkpointed(
        edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
        .where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") < F.col("v"))).distinct())
    maps: list[DataFrame] = []
    while not level.isEmpty():
        # the multiplier differs by round, so do the priorities
        priority = lambda c, n=len(maps): F.struct(F.xxhash64(F.lit(n), c).alias("p"), c.alias("node"))
        both = level.select("u", "v").unionByName(level.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(priority(F.col("v"))).alias("best"))
        rep = checkpointed(best.select("u", F.least(F.col("best"), priority(F.col("u")))["node"].alias("rep")))
        ends = (level.join(rep.select("u", F.col("rep").alias("ru")), "u")
                .join(rep.select(F.col("u").alias("v"), F.col("rep").alias("rv")), "v")
                .where(F.col("ru") != F.col("rv")))
        level = checkpointed(ends.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        maps.append(rep)
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    roots = maps[-1].select(F.col("u").alias("node"), F.col("rep").alias("root"))
    for rep in reversed(maps[:-1]):
        nxt = roots.select(F.col("node").alias("rep"), "root")
        roots = rep.join(nxt, "rep", "left").select(F.col("u").alias("node"), F.coalesce("root", "rep").alias("root"))
    return roots
