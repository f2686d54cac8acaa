"""Exact dedup on a cuckoo-filter index.

Texts are equal when they are identical after deleting ASCII white space.  Their
SHA-256 digests are the keys; digests are dealt to shards, and a shard is one
cuckoo filter (16-bit fingerprints, four to a bucket, two candidate buckets)
beside its stored keys.  The filter answers "certainly new" at once; a hit is
verified against the content kept in the shard's bucket, byte by byte, before
it counts.  When an insertion finds no room after `MAX_KICKS` moves, the filter
is rebuilt at twice its size from the stored keys.  Live digests can be deleted.

`exact_classes` runs a whole table through the index: every Arrow batch is
merged by digest first, so a text that a third of all rows share reaches its
shard once per batch, and rows reach a shard sorted by digest, so only one
content is held at a time.  `CuckooIndex` keeps shards as Parquet for tables
that arrive and leave piece by piece.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, checkpointed, fresh, text_of

SLOTS = 4
MAX_KICKS = 500
_SPACE = ASCII_SPACE.encode()


def normalise(text: bytes) -> bytes:
    return text.translate(None, _SPACE)


class CuckooFilter:
    """A cuckoo filter over 32-byte digests: insert, contains, delete."""

    def __init__(self, log2_buckets: int = 4, table: np.ndarray | None = None):
        self.log2 = log2_buckets
        self.mask = (1 << log2_buckets) - 1
        self.table = [0] * (SLOTS << log2_buckets) if table is None else table.tolist()

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * 0x5BD1E995 >> 3) & self.mask)

    def contains(self, digest: bytes) -> bool:
        tag, i, j = self._places(digest)
        t = self.table
        return tag in t[i * SLOTS:i * SLOTS + SLOTS] or tag in t[j * SLOTS:j * SLOTS + SLOTS]

    def insert(self, digest: bytes) -> bool:
        """False if there is no room (the filter is then to be rebuilt: one tag may have been moved out)."""
        tag, i, j = self._places(digest)
        t = self.table
        for b in (i, j):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not t[s]:
                    t[s] = tag
                    return True
        b = j
        for kick in range(MAX_KICKS):
            s = b * SLOTS + kick % SLOTS  # a fixed order of victims: reruns agree
            tag, t[s] = t[s], tag
            b = self._other(b, tag)
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not t[s]:
                    t[s] = tag
                    return True
        return False

    def delete(self, digest: bytes) -> bool:
        tag, i, j = self._places(digest)
        for b in (i, j):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.table[s] == tag:
                    self.table[s] = 0
                    return True
        return False


class Shard:
    """One filter and the keys it was built from."""

    def __init__(self, keys=(), filter_: CuckooFilter | None = None):
        self.keys: set[bytes] = set(keys)
        self.filter = filter_ or CuckooFilter()
        if filter_ is None and self.keys:
            self._rebuild(self.filter.log2)

    def _rebuild(self, log2: int) -> None:
        """A filter of at least ``log2`` that holds all stored keys (each failure doubles it)."""
        while True:
            new = CuckooFilter(log2)
            if all(new.insert(k) for k in sorted(self.keys)):
                self.filter = new
                return
            log2 += 1

    def hit(self, digest: bytes) -> bool:
        """A filter hit that the stored keys confirm."""
        return self.filter.contains(digest) and digest in self.keys

    def insert(self, digest: bytes) -> bool:
        """True if the digest is new."""
        if self.hit(digest):
            return False
        self.keys.add(digest)
        if not self.filter.insert(digest):
            self._rebuild(self.filter.log2 + 1)
        return True

    def delete(self, digest: bytes) -> bool:
        if not self.hit(digest):
            return False
        self.keys.discard(digest)
        return self.filter.delete(digest)


@F.arrow_udf(T.BinaryType())
def digest_udf(texts: pa.Array) -> pa.Array:
    """SHA-256 of the text without ASCII white space (null: the empty text)."""
    raw = texts.cast(pa.large_binary()).to_pylist()
    return pa.array([hashlib.sha256(normalise(t or b"")).digest() for t in raw], pa.binary())


_LAST = 2 ** 63 - 1  # where a null id sorts
_BATCH_SCHEMA = "digest binary, n long, best_len long, best_id long, best_n long, content binary"


def _better(a: tuple, b: tuple) -> bool:
    """a before b: more code points, then the smaller id, null last (tuples of length, id)."""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


def _merge(into: list, n: int, length: int, doc_id, best_n: int) -> None:
    """into: [n, best length, best id, rows that equal the best in both]."""
    into[0] += n
    if (length, doc_id) == (into[1], into[2]):
        into[3] += best_n
    elif _better((length, doc_id), (into[1], into[2])):
        into[1:] = [length, doc_id, best_n]


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, n_points) -> one row per distinct content of the batch."""
    for batch in batches:
        ids, texts, points = (batch.column(i) for i in range(3))
        found: dict[bytes, tuple[bytes, list]] = {}
        for doc_id, text, length in zip(ids.to_pylist(), texts.cast(pa.large_binary()).to_pylist(), points.to_pylist()):
            content = normalise(text)
            digest = hashlib.sha256(content).digest()
            if digest in found:
                _verify(found[digest][0], content)
                _merge(found[digest][1], 1, length, doc_id, 1)
            else:
                found[digest] = (content, [1, length, doc_id, 1])
        keys = list(found)
        sums = [found[k][1] for k in keys]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), *(pa.array([s[i] for s in sums], pa.int64()) for i in range(4)),
             pa.array([found[k][0] for k in keys], pa.binary())],
            names=["digest", "n", "best_len", "best_id", "best_n", "content"])


def _verify(kept: bytes, content: bytes) -> None:
    if kept != content:
        raise ValueError("two different texts share a SHA-256 digest")


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: rows sorted by digest go through the filter; hits are compared with the content held, then merged."""
    shard, live, content, sums = Shard(), None, b"", []

    def rows(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in done], pa.binary())]
            + [pa.array([s[i] for _, s in done], pa.int64()) for i in (0, 2, 3)],
            names=["digest", "group_size", "keep_id", "keep_copies"])

    for batch in batches:
        done = []
        for digest, n, length, doc_id, best_n, text in zip(*(c.to_pylist() for c in batch.columns)):
            if shard.insert(digest):
                if live is not None:
                    done.append((live, sums))
                live, content, sums = digest, text, [n, length, doc_id, best_n]
            else:
                _verify(content, text)
                _merge(sums, n, length, doc_id, best_n)
        if done:
            yield rows(done)
    if live is not None:
        yield rows([(live, sums)])


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, group_size, keep_id, keep_copies): one row per class of equal texts.

    ``keep_id`` is the id of the row that stays: most code points in the original text, then the smallest id (null
    ids last).  ``keep_copies`` counts rows equal to it in id, length and text (over 1 only if whole rows repeat).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("n_points", F.length("text").cast("long"))
    merged = rows.mapInArrow(_merge_batches, _BATCH_SCHEMA)
    shards = merged.repartition("digest").sortWithinPartitions("digest")
    return shards.mapInArrow(_resolve, "digest binary, group_size long, keep_id long, keep_copies long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept.

    Null texts count as empty; empty texts are one class.  Of whole rows that repeat (id and text) every one has
    ``kept`` where the id stays; `drop_copies` leaves one of them.  An empty table gives an empty result.  Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_udf(text_of(text_col)).alias("digest"))
    return rows.join(exact_classes(docs, id_col, text_col), "digest").select(
        "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, one of each class, with their own columns."""
    digest, keep, copies = fresh(docs, "digest", "keep_id", "keep_copies")
    classes = checkpointed(exact_classes(docs, id_col, text_col)).select(
        F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("keep_copies").alias(copies))
    keyed = docs.withColumn(digest, digest_udf(text_of(text_col)))
    kept = keyed.join(classes, digest).where(F.col(id_col).cast("long").eqNullSafe(F.col(keep)))
    once = kept
    if not classes.where(F.col(copies) > 1).isEmpty():  # whole rows that repeat
        again = kept.where(F.col(copies) > 1).dropDuplicates([digest])
        once = kept.where(F.col(copies) == 1).unionByName(again)
    return once.select(*docs.columns)


class CuckooIndex:
    """Live digests as Parquet shards in a shared folder; every change writes a new version beside the old one.

    ``insert`` and ``delete`` take digests (32-byte ``digest`` column, repeats and nulls ignored) and report, per
    distinct digest, whether the index changed; ``contains`` reports hits.  A shard is read by one task, so choose
    ``n_shards`` with the number of keys (a few million keys to a shard).
    """

    SCHEMA = "shard int, log2 int, table binary, keys binary"

    def __init__(self, spark: SparkSession, folder: str, n_shards: int = 64):
        self.spark, self.folder, self.n_shards, self.version = spark, folder.rstrip("/"), n_shards, None

    def shards(self) -> DataFrame:
        if self.version is None:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/{self.version}")

    def _cogroup(self, digests: DataFrame, work, schema: str) -> DataFrame:
        n = self.n_shards
        keys = digests.where("digest is not null").select("digest").distinct().withColumn(
            "shard", F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int"))
        return (self.shards().groupBy("shard").cogroup(keys.groupBy("shard"))
                .applyInPandas(lambda old, new: work(old, new), schema))

    def _change(self, digests: DataFrame, action: str) -> DataFrame:
        def work(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            shard = _load(old)
            changed = [d for d in sorted(new["digest"]) if getattr(shard, action)(d)]
            number = int(old["shard"].iloc[0] if len(old) else new["shard"].iloc[0])
            return pd.DataFrame({"shard": [number], "log2": [shard.filter.log2],
                                 "table": [np.array(shard.filter.table, "<u2").tobytes()],
                                 "keys": [b"".join(sorted(shard.keys))], "changed": [b"".join(changed)]})

        version = uuid.uuid4().hex
        self._cogroup(digests, work, self.SCHEMA + ", changed binary").write.parquet(f"{self.folder}/{version}")
        self.version = version
        packed = self.spark.read.parquet(f"{self.folder}/{version}").select("changed")
        return packed.select(F.explode(F.sequence(F.lit(0), F.expr("length(changed) div 32"))).alias("i"), "changed").where(
            F.col("i") * 32 < F.length("changed")).select(F.expr("substring(changed, i * 32 + 1, 32)").alias("digest"))

    def insert(self, digests: DataFrame) -> DataFrame:
        """The digests that were new."""
        return self._change(digests, "insert")

    def delete(self, digests: DataFrame) -> DataFrame:
        """The digests that were live and are so no longer."""
        return self._change(digests, "delete")

    def contains(self, digests: DataFrame) -> DataFrame:
        """The digests that are live."""
        def work(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            shard = _load(old)
            return pd.DataFrame({"digest": [d for d in new["digest"] if shard.hit(d)]}, columns=["digest"])

        return self._cogroup(digests, work, "digest binary")


def _load(old: pd.DataFrame) -> Shard:
    if not len(old):
        return Shard()
    row = old.iloc[0]
    keys = bytes(row["keys"])
    return Shard((keys[i:i + 32] for i in range(0, len(keys), 32)),
                 CuckooFilter(int(row["log2"]), np.frombuffer(row["table"], "<u2")))
