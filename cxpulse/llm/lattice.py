"""Embedding near-dedup by lattice hashing.

Unit vectors are rotated by seeded random projections; each table reads
``blocks`` groups of eight projected coordinates and decodes every group to its
nearest point of the E8 lattice (all integers or all halves, even sum).  The
points' hash is the vector's cell in that table.  Vectors are filed under their
own cell and looked up under ``probes`` cells: their own and the neighbours
(one of E8's 240 shortest vectors added in a block) that the residual points
to.  Pairs that meet are screened by the Hamming distance of 64 projected signs
inside the join and verified by cosine in double precision.

Equal vectors are one class before hashing, so a third of all rows may be one
vector.  Cells are joined, never collected; classes come from `components`.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import components

COSINE = 0.9
TABLES = 6
BLOCKS = 2
PROBES = 24
SCALE = 2.0  # side of a lattice cell, in standard deviations of a random projection
SIGNS = 23  # sign bits (of 64) in which a linked pair may differ; the expected number at cosine 0.9 is 9, its deviation 3
SEED = 42


@lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    rows = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[rows]).argmax(1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of x (n x 8)."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=8)
def _projections(dim: int, tables: int, blocks: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(dim x 8*blocks*tables in cells of ``scale``, dim x 64 for the signs); seeded by the dimension too."""
    rng = np.random.default_rng([seed, dim])
    width = 8 * blocks
    cells = []
    for _ in range(tables):
        g = rng.normal(size=(dim, width))
        if dim >= width:  # orthonormal within a table
            g = np.linalg.qr(g)[0] * np.sqrt(dim)
        cells.append(g / scale)
    return np.concatenate(cells, 1), rng.normal(size=(dim, 64))


_MIX = 0x9E3779B97F4A7C15


def _cell_keys(table: int, points: np.ndarray, blocks: int) -> np.ndarray:
    """64-bit keys of (table, lattice points): points is n x (8 * blocks), in halves."""
    h = np.full(len(points), ((table + 1) * _MIX) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    for k in range(8 * blocks):
        h ^= doubled[:, k] + np.uint64(_MIX) + (h << np.uint64(6)) + (h >> np.uint64(2))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(unit: np.ndarray, tables: int, blocks: int, probes: int, scale: float, seed: int):
    """(home keys n x tables, probed keys n x tables x probes, signs n) of unit vectors."""
    planes, signs = _projections(unit.shape[1], tables, blocks, scale, seed)
    projected = unit @ planes
    n, short = len(unit), shortest()
    home = np.empty((n, tables), np.int64)
    probed = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        x = projected[:, t * 8 * blocks:(t + 1) * 8 * blocks]
        point = np.concatenate([decode_e8(x[:, 8 * b:8 * b + 8]) for b in range(blocks)], 1)
        home[:, t] = _cell_keys(t, point, blocks)
        # distance gained by moving one block (or each of two) to a neighbouring point, least first
        few = min(len(short), probes)
        moves, costs = [], []
        for b in range(blocks):
            rest = x[:, 8 * b:8 * b + 8] - point[:, 8 * b:8 * b + 8]
            cost = 2.0 - 2.0 * rest @ short.T
            best = np.argpartition(cost, few - 1, axis=1)[:, :few]
            order = np.take_along_axis(cost, best, 1).argsort(1, kind="stable")
            moves.append(np.take_along_axis(best, order, 1))
            costs.append(np.take_along_axis(cost, moves[b], 1))
        # choices: (block moves), -1 for none; pairs of moves among the few best of the first two blocks
        pairs = [(b, i, None, None) for b in range(blocks) for i in range(few)]
        if blocks > 1:
            pairs += [(0, i, 1, j) for i in range(few) for j in range(few) if (i + 1) * (j + 1) <= probes]
        total = np.stack([costs[a][:, i] + (costs[b][:, j] if b is not None else 0.0) for a, i, b, j in pairs], 1)
        best = np.argpartition(total, probes - 2, axis=1)[:, :probes - 1]
        table_a, table_i = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        table_b, table_j = (np.array([-1 if p[k] is None else p[k] for p in pairs]) for k in (2, 3))
        rows = np.arange(n)
        probed[:, t, 0] = home[:, t]
        for k in range(probes - 1):
            moved = point.copy()
            choice = best[:, k]
            for blk, which in ((table_a, table_i), (table_b, table_j)):
                for b in range(blocks):
                    hit = rows[blk[choice] == b]
                    if len(hit):
                        moved[hit, 8 * b:8 * b + 8] += short[moves[b][hit, which[choice[hit]]]]
            probed[:, t, k + 1] = _cell_keys(t, moved, blocks)
    bits = np.packbits(unit @ signs > 0, axis=1, bitorder="little").view("<i8")[:, 0]
    return home, probed, bits


def _vector(v) -> np.ndarray | None:
    """The vector in double precision, its largest component scaled by a power of two to between 1/2 and 1; None where it
    links with nothing.

    The scaling is exact and changes no cosine; squares and products of scaled vectors neither overflow nor vanish
    (components 2^-500 of the largest and less add nothing to them in double precision).
    """
    if v is None or not len(v) or any(x is None for x in v):
        return None
    x = np.asarray(v, np.float64) + 0.0  # minus zero is zero
    if not np.isfinite(x).all() or not x.any():
        return None
    exponent = int(np.frexp(np.abs(x).max())[1])
    half = exponent // 2  # in two steps: the power itself may be out of range
    return np.ldexp(np.ldexp(x, -half), half - exponent) + 0.0


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> (vec_id, digest, vector): 128 bits of the scaled vector, null if it cannot link."""
    for batch in batches:
        vectors = [_vector(v) for v in batch.column(1).to_pylist()]
        digests = [None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in vectors]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()),
                                          pa.array([None if x is None else x.tolist() for x in vectors], pa.list_(pa.float64()))],
                                         names=["vec_id", "digest", "vector"])


def _files(tables: int, blocks: int, probes: int, scale: float, seed: int, look_up: bool):
    """(class, vector) -> (class, dim, key, signs): the cells a vector is filed under, or those it is looked up in."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            vectors = batch.column(1).to_pylist()
            dims = np.array([len(v) for v in vectors], np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.array([vectors[i] for i in at])
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                home, probed, bits = cells(unit, tables, blocks, probes, scale, seed)
                keys = probed.reshape(len(at), -1) if look_up else home
                k = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[at], k)), pa.array(np.full(len(at) * k, dim, np.int32)),
                     pa.array(keys.reshape(-1)), pa.array(np.repeat(bits, k))], names=["class", "dim", "key", "signs"])

    return work


def class_links(classes: DataFrame, cosine: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS,
                probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """(u, v), u < v: pairs of classes (columns class, vector) found and verified at ``cosine`` or more, once each."""
    schema = "class long, dim int, key long, signs long"
    src = classes.select("class", "vector")
    filed = src.mapInArrow(_files(tables, blocks, probes, scale, seed, False), schema).alias("f")
    asked = src.mapInArrow(_files(tables, blocks, probes, scale, seed, True), schema).alias("a")
    met = asked.join(filed, (F.col("a.key") == F.col("f.key")) & (F.col("a.dim") == F.col("f.dim"))
                     & (F.col("a.class") != F.col("f.class"))
                     & (F.bit_count(F.col("a.signs").bitwiseXOR(F.col("f.signs"))) <= SIGNS))
    pairs = met.select(F.least("a.class", "f.class").alias("u"), F.greatest("a.class", "f.class").alias("v")).distinct()
    left = src.select(F.col("class").alias("u"), F.col("vector").alias("x"))
    right = src.select(F.col("class").alias("v"), F.col("vector").alias("y"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    found = pairs.join(left, "u").join(right, "v")
    return found.where(dot("x", "y") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))) >= cosine).select("u", "v")


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
               **params) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows whose vector was found at ``cosine`` or more (equal vectors among them);
    ``component_id`` is the smallest id reachable by links.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing and stay.  Vectors of different dimensions never link.  Repeated rows
    are vectors of their own, linked with each other.  Null ids are never a component's id unless all its ids are.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.mapInArrow(_digests, "vec_id long, digest binary, vector array<double>")
    # numbers of classes hold from here on: what is checkpointed is read by all that follows
    classes = checkpointed(rows.where("digest is not null").groupBy("digest").agg(
        F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("first_id")).withColumn(
        "class", F.monotonically_increasing_id()))
    links = checkpointed(class_links(classes, cosine, **params))
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sizes = classes.select(F.col("class").alias("v"), "n")
    degree = both.join(sizes, "v").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("near"))
    roots = components(links).withColumnRenamed("node", "class")
    named = classes.select("class", "digest", "n", "first_id").join(degree, "class", "left").join(roots, "class", "left")
    named = named.withColumn("root", F.coalesce("root", "class"))
    heads = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = checkpointed(named.join(heads, "root").select(
        "digest", "component_id", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")))
    out = rows.select("vec_id", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
