"""Substring dedup: common-prefix interval trees over an enhanced sparse suffix array.

A string of ``length`` bytes that starts twice anywhere is a repeat; every byte
such a string covers is removed.  A suffix array of all suffixes of a corpus
does not fit any budget, so the array is sparse: its suffixes start at content
chosen anchors.  In every window of ``length`` bytes the k-gram of least hash is
an anchor, so equal windows have equal anchors at equal offsets, and two windows
are equal exactly if their anchors' suffixes agree to the window's right end
and the texts before the anchors agree to its left end.

1. One pass hashes k-grams and keeps the anchors (a little over one in a hundred
   bytes) with a hash of all that any window through them can see, their context.
2. Anchors whose k-gram occurs once are dropped: most by a filter of fixed size
   made from the counts of the grams, the rest by an exact count and a join.
   Occurrences whose whole context occurs again are repeats at once.
3. What is left, one occurrence of each context, goes to buckets by what a window
   must share on its longer side of the anchor: half of the rest of its bytes
   after the gram, or half of them before it.  Buckets of one are done.
4. The others get their bytes: sorted by suffix, with the common prefixes of
   neighbours, and scanned with a stack into the intervals of the common-prefix
   tree.  Inside each interval the texts before the anchors are treated alike; an
   interval there is a set of occurrences that cannot be extended to the left
   together.  Each pair of intervals that spans ``length`` bytes is a maximal
   repeat of all its occurrences.
5. Buckets of more than ``BUCKET`` contexts (the edge of a passage that a third of
   all documents share) are resolved exactly by counting: windows are taken in
   runs of ``RUN`` starts; a run whose union occurs again is a repeat as a whole, a
   run whose intersection does not has none, and only runs between the two count
   their windows one by one.  Counts spread over all tasks.

Spans go back to their documents through a shuffle of the texts.  Every step's
result is stored, and what it shuffled is removed with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_scratch, materialize_table, scratch_tables
from .common import text_of

LENGTH = 200
GRAM = 32
BUCKET = 32
RUN = 12
PIECE = 1 << 20  # bytes hashed at a time
LOW = 1 << 16  # what packs two offsets into one number
FILTER_BITS = 1 << 25  # bits of the filter of repeated grams (at most 2^19 rows are broadcast, whatever the input)

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)


@lru_cache(maxsize=2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of the base and of its inverse modulo 2^64."""
    n = PIECE + 8 * LENGTH + 4096
    table = np.random.default_rng(base % (1 << 32)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)

    def run(b: int) -> np.ndarray:
        x = np.full(n, b, np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    return table, run(base), run(pow(base, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


class Hashes:
    """Polynomial hashes of all substrings of a buffer (arithmetic modulo 2^64)."""

    def __init__(self, buf: np.ndarray, base: int):
        table, power, self.inverse = _powers(base)
        self.prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(table[buf] * power[:len(buf)], out=self.prefix[1:])

    def of(self, starts, stops) -> np.ndarray:
        return (self.prefix[stops] - self.prefix[starts]) * self.inverse[starts]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.prefix) - k
        return (self.prefix[k:] - self.prefix[:n]) * self.inverse[:n]


def _sliding(a: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over each window of w values, by running values within blocks of w."""
    n = len(a) - w + 1
    rows = -(-len(a) // w)
    full = np.full(rows * w, fill, a.dtype)
    full[:len(a)] = a
    full = full.reshape(rows, w)
    ahead = op.accumulate(full, axis=1).ravel()
    back = op.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1:w - 1 + n])


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Lots of about PIECE bytes: (text, first byte, last byte, first window start, end of window starts).

    Longer texts are cut with margins, so that every window start is in one piece and every context whole.
    """
    lot, size = [], 0
    for i, t in enumerate(texts):
        n = len(t)
        if n < length:
            continue
        if n > PIECE:
            for a in range(0, n - length + 1, PIECE - 4 * length):
                b = min(a + PIECE - 4 * length, n - length + 1)
                yield [(i, max(0, a - length), min(n, b + 2 * length), a, b)]
            continue
        if size + n > PIECE and lot:
            yield lot
            lot, size = [], 0
        lot.append((i, 0, n, 0, n - length + 1))
        size += n
    if lot:
        yield lot


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Arrays (text, position, gram hash, context hash, bytes before, bytes after) of all anchors; each anchor once."""
    out = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2]
    w, last = length - gram + 1, (-1, np.zeros(0, np.int64))
    for lot in _pieces(texts, length):
        buf = np.frombuffer(b"".join(texts[i][a:b] for i, a, b, _, _ in lot), np.uint8)
        first, second = (Hashes(buf, b) for b in _BASES)
        h = _mix(first.grams(gram))
        low = _sliding(h, w, np.minimum, _U(2 ** 64 - 1))
        allowed = np.zeros(len(low), bool)
        base = np.zeros(len(lot), np.int64)
        at = 0
        for j, (_, a, b, s, e) in enumerate(lot):
            allowed[at + s - a:at + e - a] = True
            base[j] = at
            at += b - a
        low[~allowed] = 0
        padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
        found = np.flatnonzero((_sliding(padded, w, np.maximum, _U(0)) == h) & (h != 0))
        j = np.searchsorted(base, found, "right") - 1
        text, a, b = (np.array([x[k] for x in lot], np.int64)[j] for k in range(3))
        local = found - base[j]
        before, after = np.minimum(local, length - gram), np.minimum(b - a - local, length)
        context = _mix(second.of(found - before, found + after) + _U(1) * before.astype(np.uint64) * _U(0x2545F4914F6CDD1D)
                       + after.astype(np.uint64))
        position = local + a
        keep = np.ones(len(found), bool)
        if len(lot) == 1 and last[0] == lot[0][0]:  # anchors of the piece before
            keep = ~np.isin(position, last[1])
        last = (lot[-1][0], position[position > position.max(initial=0) - 4 * length]) if len(lot) == 1 else (-1, position[:0])
        out.append([x[keep] for x in (text, position, h[found], context, before, after)])
    return [np.concatenate(x) for x in zip(*out)]


def _anchor_batches(length: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            text, position, h, context, before, after = anchors(texts, length, gram)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(position.astype(np.int32)),
                 pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(before.astype(np.int16)),
                 pa.array(after.astype(np.int16))],
                names=["doc_id", "text_key", "position", "gram", "context", "before", "after"])

    return work


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def intervals(prefixes: list[int]) -> list[tuple[int, int, int]]:
    """(first, last, length) of the common-prefix intervals of a sorted list; prefixes[i]: common to i and i + 1.

    Each interval is a maximal range whose neighbours share ``length``, so its members differ right after it.
    """
    out, stack = [], []
    for i, p in enumerate([*prefixes, -1]):
        first = i
        while stack and stack[-1][1] > p:
            first, length = stack.pop()
            out.append((first, i, length))
        if p >= 0 and (not stack or stack[-1][1] < p):
            stack.append((first, p))
    return out


def bucket_repeats(rows: list[tuple[bytes, bytes]], length: int) -> list[tuple[int, int, list[int]]]:
    """(bytes before, bytes after, members) of the maximal repeats of ``length`` or more through one anchor.

    ``rows``: (text before, reversed; text from the anchor on), sorted by the latter.
    """
    if len(rows) == 2:
        (left, right), (other_left, other_right) = rows
        before, after = common(left, other_left), common(right, other_right)
        return [(before, after, [0, 1])] if before + after >= length else []
    out, reach = [], max(len(r[0]) for r in rows)
    for lo, hi, after in intervals([common(a[1], b[1]) for a, b in zip(rows, rows[1:])]):
        if after + reach < length:
            continue
        members = sorted(range(lo, hi + 1), key=lambda i: rows[i][0])
        for first, last, before in intervals([common(rows[a][0], rows[b][0]) for a, b in zip(members, members[1:])]):
            if before + after >= length:
                out.append((before, after, members[first:last + 1]))
    return out


_SPAN = "doc_id long, text_key long, start long, stop long, repeat long"


def _resolve(length: int):
    """Rows sorted by bucket and suffix -> spans of the occurrences whose context does not occur again."""
    names = ("key", "left", "right", "doc_id", "text_key", "position", "n")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []  # rows of the bucket that the next batch may go on with

        def spans(group: list[tuple]) -> list[tuple]:
            # all repeats of an occurrence hold its anchor: together they cover from the first to the last byte of any
            reach: dict[int, list[int]] = {}
            for before, after, members in bucket_repeats([r[1:3] for r in group], length):
                for m in members:
                    r = reach.setdefault(m, [0, 0])
                    r[0], r[1] = max(r[0], before), max(r[1], after)
            out = []
            for m, (before, after) in reach.items():
                key, left, right, doc_id, text_key, position, n = group[m]
                if n == 1:
                    out.append((doc_id, text_key, position - before, position + after, key))
            return out

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(5)],
                                              names=["doc_id", "text_key", "start", "stop", "repeat"])

        for batch in batches:
            rows = rest + list(zip(*(batch.column(n).to_pylist() for n in names)))
            keys = np.array([r[0] for r in rows], np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist()]
            found = [x for lo, hi in zip(cuts, cuts[1:]) if hi - lo > 1 for x in spans(rows[lo:hi])]
            rest = rows[cuts[-1]:]
            if found:
                yield batch_of(found)
        if len(rest) > 1 and (found := spans(rest)):
            yield batch_of(found)

    return work


class Contexts:
    """The contexts of a batch in one buffer, with polynomial hashes of their substrings."""

    def __init__(self, lefts: list[bytes], rights: list[bytes], keys: list[int]):
        self.before = np.fromiter(map(len, lefts), np.int64, len(lefts))
        self.after = np.fromiter(map(len, rights), np.int64, len(rights))
        buf = np.frombuffer(b"".join(x for a, b in zip(lefts, rights) for x in (a[::-1], b)), np.uint8)
        ends = np.cumsum(self.before + self.after)
        self.anchor = ends - self.after  # places of the anchors in the buffer
        self.keys = np.array(keys, np.int64).view(np.uint64)
        self.hashes = [Hashes(buf, b) for b in _BASES]

    def of(self, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of text from ``start`` to ``stop`` (relative to the anchors of the rows).

        The same place is met once for each anchor near it, so bucket and offset are part of what is hashed.
        """
        one, two = (_mix(h.of(self.anchor[row] + start, self.anchor[row] + stop)) for h in self.hashes)
        one = _mix(one + self.keys[row] + (start - 4096 * stop).astype(np.uint64))
        return one.view(np.int64), two.view(np.int64)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def _runs(length: int, gram: int):
    """Contexts of large buckets -> their runs of windows: hash of the intersection, two hashes of the union (null: cut off).

    ``at``: the run's first and last offset before the anchor, in one number; ``n``: 2 where the context occurs again.
    """
    half = (length - gram) // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            col = {n: batch.column(n) for n in batch.schema.names}
            texts = Contexts(col["left"].to_pylist(), col["right"].to_pylist(), col["key"].to_pylist())
            side = np.array(col["side"].to_pylist(), np.int64)
            firsts = [np.arange(0, half + 1, RUN), np.arange(half, length - gram + 1, RUN)]
            row = np.concatenate([np.repeat(np.flatnonzero(side == s), len(firsts[s])) for s in (0, 1)])
            a = np.concatenate([np.tile(firsts[s], np.count_nonzero(side == s)) for s in (0, 1)])
            b = np.minimum(a + RUN - 1, np.where(side[row] == 0, half, length - gram))
            some = (texts.before[row] >= a) & (texts.after[row] >= length - b)
            row, a, b = row[some], a[some], b[some]
            shared, _ = texts.of(row, -a, length - b)
            full = (texts.before[row] >= b) & (texts.after[row] >= length - a)
            start, stop = np.where(full, -b, -a), np.where(full, length - a, length - b)
            one, two = texts.of(row, start, stop)
            often = np.minimum(col["n"].to_numpy(), 2).astype(np.int8)[row]
            yield pa.RecordBatch.from_arrays(
                [col["cid"].take(pa.array(row)), pa.array(often), pa.array((a * LOW + b).astype(np.int32)), pa.array(shared),
                 pa.array(one, mask=~full), pa.array(two, mask=~full)], names=["cid", "n", "at", "shared", "one", "two"])

    return work


def _windows(length: int):
    """Contexts with runs to open -> their windows: context, offset before the anchor, occurrences, two hashes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            col = {n: batch.column(n) for n in batch.schema.names}
            texts = Contexts(col["left"].to_pylist(), col["right"].to_pylist(), col["key"].to_pylist())
            triples = [(i, o, r["n"]) for i, runs in enumerate(col["runs"].to_pylist()) for r in runs
                       for o in range(r["at"] // LOW, r["at"] % LOW + 1)]
            row, o, n = (np.array([x[k] for x in triples], np.int64) for k in (0, 1, 2))
            some = (texts.before[row] >= o) & (texts.after[row] >= length - o)
            row, o, n = row[some], o[some], n[some]
            one, two = texts.of(row, -o, length - o)
            yield pa.RecordBatch.from_arrays([col["cid"].take(pa.array(row)), pa.array(o.astype(np.int32)), pa.array(n.astype(np.int8)),
                                              pa.array(one), pa.array(two)], names=["cid", "offset", "n", "one", "two"])

    return work


def _each(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, dict[str, np.ndarray], dict[str, pa.Array]]:
    """(doc_id, text_key, text, found list of structs) -> texts, and for each struct its row, number fields and columns."""
    lists = batch.column(3)
    flat = lists.flatten()
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    cols = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
    at = pa.array(row)
    numbers = {k: v.to_numpy(zero_copy_only=False).astype(np.int64) for k, v in cols.items() if k in ("position", "before", "after")}
    return batch.column(2).to_pylist(), row, numbers, {"doc_id": batch.column(0).take(at), "text_key": batch.column(1).take(at), **cols}


def _sides(length: int, gram: int):
    """(doc_id, text_key, text, anchors) -> a row per anchor and side with the bucket's key, where the side has the bytes."""
    half = (length - gram) // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, row, num, cols = _each(batch)
            p = num["position"]
            for side, (a, b) in enumerate(((0, length - half), (-half, gram))):
                some = np.flatnonzero((num["before"] >= -a) & (num["after"] >= b))
                digests = b"".join([hashlib.blake2b(texts[i][x:y], digest_size=8, salt=bytes([side])).digest() for i, x, y in
                                    zip(row[some].tolist(), (p[some] + a).tolist(), (p[some] + b).tolist())])
                at = pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [*(cols[c].take(at) for c in ("doc_id", "text_key", "position", "n", "before", "after")),
                     pa.array(np.full(len(some), side, np.int8)), pa.array(np.frombuffer(digests, "<i8"))],
                    names=["doc_id", "text_key", "position", "n", "before", "after", "side", "key"])

    return work


def _context_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text, sides) -> a row per side with the bytes before (reversed) and after its anchor."""
    for batch in batches:
        texts, row, num, cols = _each(batch)
        p, first, last = num["position"], num["position"] - num["before"], num["position"] + num["after"]
        left = [texts[i][a:b][::-1] for i, a, b in zip(row.tolist(), first.tolist(), p.tolist())]
        right = [texts[i][a:b] for i, a, b in zip(row.tolist(), p.tolist(), last.tolist())]
        yield pa.RecordBatch.from_arrays(
            [cols["doc_id"], cols["text_key"], pa.array(p), *(cols[c] for c in ("key", "n", "side", "wide")),
             pa.array(left, pa.binary()), pa.array(right, pa.binary())],
            names=["doc_id", "text_key", "position", "key", "n", "side", "wide", "left", "right"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       text.cast("binary").alias("text"))


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table; what the writing shuffled is removed when it is done (nothing else reads it)."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return materialize_table(df, name)
    finally:
        conf.set(key, before)


def _maybe_repeated(found: DataFrame) -> DataFrame:
    """``found`` without most anchors whose gram occurs once: before anything but the grams' counts is shuffled.

    The repeated grams set bits of a filter of fixed size, whose words are broadcast.  All anchors of a gram stay or all
    go; those that stay by chance are dropped by the exact count that follows.
    """
    slot = F.col("gram").bitwiseAND(F.lit(FILTER_BITS - 1))
    word = F.shiftright(slot, 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    again = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    words = _stored(again.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "gram-filter")
    return found.join(F.broadcast(words), (word == F.col("word")) & (F.col("bits").bitwiseAND(bit) != 0), "left_semi")


def _occurrences(rows: DataFrame, length: int, gram: int, bucket: int):
    """(spans of anchors whose whole context occurs again, numbered contexts in buckets)."""
    spark, stored = rows.sparkSession, _stored
    scratch = set(scratch_tables(spark))
    found = materialize_table(rows.mapInArrow(
        _anchor_batches(length, gram),
        "doc_id long, text_key long, position int, gram long, context long, before short, after short"), "anchors")
    maybe = _maybe_repeated(found)
    of_anchors = [t for t in scratch_tables(spark) if t not in scratch]
    again = maybe.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"))
    again = again.where("n > 1").select("gram", (F.col("lo") == F.col("hi")).alias("alike"))
    repeated = stored(maybe.join(again, "gram"), "repeated")
    drop_scratch(spark, of_anchors)
    mixed = repeated.where("not alike")
    classes = stored(mixed.groupBy("gram", "context").agg(
        F.count("*").alias("n"),
        F.min(F.struct("doc_id", "text_key", "position", "before", "after")).alias("at")).select("gram", "context", "n", "at.*"),
        "contexts")
    place = ["doc_id", "text_key", "position", "before", "after"]
    whole = repeated.where("alike").select(place).unionByName(
        mixed.join(classes.where("n > 1").select("gram", "context"), ["gram", "context"]).select(place))
    whole = whole.select("doc_id", "text_key", (F.col("position") - F.col("before")).cast("long").alias("start"),
                         (F.col("position") + F.col("after")).cast("long").alias("stop"))

    def with_texts(anchors_: DataFrame, *columns: str) -> DataFrame:
        wanted = anchors_.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*columns)).alias("found"))  # a document's own
        return rows.alias("t").join(wanted.alias("w"), _same("t", "w")).select("t.doc_id", "t.text_key", "t.text", "w.found")

    sides = stored(with_texts(classes, "position", "n", "before", "after").mapInArrow(
        _sides(length, gram), "doc_id long, text_key long, position int, n long, before short, after short, side byte, key long"),
        "sides")
    shared = sides.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", (F.col("m") > bucket).alias("wide"))
    contexts = stored(with_texts(sides.join(shared, "key"), "position", "key", "n", "side", "wide", "before", "after").mapInArrow(
        _context_bytes, "doc_id long, text_key long, position long, key long, n long, side byte, wide boolean, left binary, "
        "right binary").withColumn("cid", F.monotonically_increasing_id()), "context-bytes")
    return whole, contexts


def repeat_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text_key, start, stop): covered bytes around every anchor of keyed rows (`_keyed`)."""
    whole, contexts = _occurrences(rows, length, gram, bucket)
    near = contexts.where("not wide").drop("cid").repartition("key").sortWithinPartitions("key", "right").mapInArrow(_resolve(length), _SPAN)
    return whole.unionByName(near.drop("repeat")).unionByName(_wide_spans(contexts.where("wide"), length, gram))


def maximal_repeats(rows: list[tuple[bytes, bytes]], length: int, gram: int, low: int, reach: int):
    """Maximal repeats whose first anchor is that of ``rows``, and lists of members that need a longer reach.

    ``rows``: (up to length - gram + 1 bytes before, reversed; up to ``reach`` bytes from the anchor on), sorted by the
    latter.  Repeats of ``low`` to ``reach`` - 1 bytes after the anchor are given as (bytes before, bytes after,
    members).  One that starts more than length - gram bytes before has an earlier anchor and is met there.
    """
    out, longer, margin = [], [], length - gram + 1
    for lo, hi, after in intervals([common(a[1], b[1]) for a, b in zip(rows, rows[1:])]):
        if after < low or after + margin <= length:
            continue
        members = sorted(range(lo, hi + 1), key=lambda i: rows[i][0])
        if common(rows[members[0]][0], rows[members[-1]][0]) >= margin:
            continue
        if after >= reach:
            longer.append(members)
            continue
        for first, last, before in intervals([common(rows[a][0], rows[b][0]) for a, b in zip(members, members[1:])]):
            if before >= margin or before + after < length:
                continue
            found = members[first:last + 1]
            # what goes on alike to the right is met in a deeper interval
            if common(rows[min(found)][1], rows[max(found)][1]) == after:
                out.append((before, after, found))
    return out, longer


def _group_bytes(margin: int, reach: int):
    """(doc_id, text_key, text, anchors) -> a row per anchor with the bytes before (reversed) and after it."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, row, num, cols = _each(batch)
            at = list(zip(row.tolist(), num["position"].tolist()))
            for first in range(0, len(at), 500):
                some = at[first:first + 500]
                yield pa.RecordBatch.from_arrays(
                    [*(cols[c].slice(first, 500) for c in ("key", "doc_id", "text_key")),
                     pa.array([p for _, p in some], pa.int64()),
                     pa.array([texts[i][max(0, p - margin):p][::-1] for i, p in some], pa.binary()),
                     pa.array([texts[i][p:p + reach] for i, p in some], pa.binary())],
                    names=["key", "doc_id", "text_key", "position", "left", "right"])

    return work


def _group_rows(length: int, gram: int, low: int, reach: int):
    """Rows sorted by bucket and suffix -> occurrences (repeat, doc_id, text_key, start, stop) of maximal repeats, and
    (key, doc_id, text_key, position) of anchors to be looked at again with a longer reach."""
    names = ("key", "left", "right", "doc_id", "text_key", "position")
    fields = ("repeat", "key", "doc_id", "text_key", "start", "stop")

    def number(x: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []  # rows of the bucket that the next batch may go on with

        def resolved(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            repeats, longer = maximal_repeats([r[1:3] for r in group], length, gram, low, reach)
            for before, after, members in repeats:
                _, left, right, *_ = group[members[0]]
                name = number(left[:before][::-1] + right[:after])
                yield batch_of([(name, None, r[3], r[4], r[5] - before, r[5] + after) for r in (group[m] for m in members)])
            for members in longer:
                key = number(group[members[0]][2])
                yield batch_of([(None, key, r[3], r[4], r[5], r[5]) for r in (group[m] for m in members)])

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(6)], names=list(fields))

        for batch in batches:
            rows = rest + list(zip(*(batch.column(n).to_pylist() for n in names)))
            keys = np.array([r[0] for r in rows], np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist()]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo > 1:
                    yield from resolved(rows[lo:hi])
            rest = rows[cuts[-1]:]
        if len(rest) > 1:
            yield from resolved(rest)

    return work


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                  gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(repeat, length, doc_id, start): all maximal repeats of ``length`` bytes or more, each with all its occurrences.

    A maximal repeat is a string that starts twice anywhere and that neither a byte more before nor one more after all
    its occurrences has in common.  Rows of one ``repeat`` (64-bit digest of the bytes) are equal strings; whole rows
    that repeat repeat each other and are listed as often.  Every repeat is met at its first anchor, at most ``length``
    - ``gram`` bytes after its start, so only the bytes after the anchor have to be read on, four times as far in every
    round, and only for anchors whose repeats are longer.  The result does not depend on ``bucket``.  One task resolves
    all anchors of one gram.
    """
    spark, margin = docs.sparkSession, length - gram + 1
    keyed = _keyed(docs, id_col, text_col)
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("doc_id"))
    rows = keyed.select("doc_id", F.xxhash64("text_key", copy).alias("text_key"), "text")  # copies told apart
    before = set(scratch_tables(spark))
    found = materialize_table(rows.mapInArrow(
        _anchor_batches(length, gram),
        "doc_id long, text_key long, position int, gram long, context long, before short, after short"), "anchors")
    again = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    todo = found.join(again, "gram").select("doc_id", "text_key", F.col("position").cast("long").alias("position"),
                                            F.col("gram").alias("key"))
    parts, low, reach = [], 0, length
    while parts == [] or not todo.isEmpty():
        wanted = todo.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("position", "key")).alias("found"))
        texts = rows.alias("t").join(wanted.alias("w"), _same("t", "w")).select("t.doc_id", "t.text_key", "t.text", "w.found")
        near = texts.mapInArrow(_group_bytes(margin, reach), "key long, doc_id long, text_key long, position long, left binary, "
                                "right binary").repartition("key").sortWithinPartitions("key", "right")
        part = materialize_table(near.mapInArrow(
            _group_rows(length, gram, low, reach),
            "repeat long, key long, doc_id long, text_key long, start long, stop long"), "groups")
        parts.append(part.where("repeat is not null"))
        todo = part.where("repeat is null").select("doc_id", "text_key", F.col("start").alias("position"), "key").distinct()
        low, reach = reach, 4 * reach
    every = reduce(DataFrame.unionByName, parts).select(
        "repeat", (F.col("stop") - F.col("start")).alias("length"), "doc_id", "text_key", "start").distinct()
    out = materialize_table(every.drop("text_key"), "repeat-groups")
    drop_scratch(spark, [t for t in scratch_tables(spark) if t not in before and "cxpulse-repeat-groups-" not in t])
    return out


def _wide_spans(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans of the occurrences in large buckets, by counting runs of windows and then the windows of unclear runs.

    All windows of a context hold its anchor, so what they cover is one span from the first to the last of them.
    """
    spark = contexts.sparkSession
    before = set(scratch_tables(spark))
    low, high = F.floor(F.col("at") / LOW).cast("int"), (F.col("at") % LOW).cast("int")
    runs = _stored(contexts.mapInArrow(_runs(length, gram), "cid long, n byte, at int, shared long, one long, two long"), "runs")
    twice = runs.where("one is not null").groupBy("one", "two").agg(F.sum("n").alias("m")).where("m > 1").select(
        "one", "two", F.lit(True).alias("whole"))
    known = _stored(runs.join(twice, ["one", "two"], "left"), "known-runs")
    covered = known.where("whole and n = 1").select("cid", low.alias("low"), high.alias("high"))
    is_open = F.col("whole").isNull() & (F.col("n") == 1)
    unclear = known.groupBy("shared").agg(F.sum("n").alias("m"), F.max(is_open).alias("any")).where("m > 1 and any").select("shared")
    # to open: the unclear ones, and of those known to be alike one as their partner
    partner = known.where("whole").groupBy("shared", "one", "two").agg(F.min(F.struct("cid", "at")).alias("first"))
    asked = known.where("whole is null").select("shared", "cid", "at", "n").unionByName(
        partner.select("shared", "first.*", F.lit(2).cast("byte").alias("n")))
    opened = _stored(asked.join(unclear, "shared").groupBy("cid").agg(
        F.collect_list(F.struct("at", "n")).alias("runs")), "open-runs")  # at most a dozen runs a context
    grams = _stored(contexts.join(opened, "cid").select("cid", "key", "left", "right", "runs").mapInArrow(
        _windows(length), "cid long, offset int, n byte, one long, two long"), "windows")
    again = grams.groupBy("one", "two").agg(F.sum("n").alias("m")).where("m > 1").select("one", "two")
    single = grams.where("n = 1").join(again, ["one", "two"]).select("cid", F.col("offset").alias("low"), F.col("offset").alias("high"))
    ends = covered.unionByName(single).groupBy("cid").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spans = contexts.select("cid", "doc_id", "text_key", "position").join(ends, "cid").select(
        "doc_id", "text_key", (F.col("position") - F.col("high")).alias("start"), (F.col("position") + length - F.col("low")).alias("stop"))
    out = _stored(spans, "wide-spans")
    drop_scratch(spark, [t for t in scratch_tables(spark) if t not in before and "cxpulse-wide-spans-" not in t])
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, start, stop) sorted -> a row per document: its maximal runs of covered bytes."""
    rest: pa.RecordBatch | None = None

    def merged(batch: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        start, stop = (batch.column(i).to_numpy() for i in (2, 3))
        group = np.zeros(len(start), np.int64)
        group[first[1:]] = 1
        group = np.cumsum(group)
        # documents one after the other on one line, so that a running maximum serves them all
        room = int(stop.max()) + 1
        reached = np.maximum.accumulate(stop + group * room)
        new = np.r_[True, start[1:] + group[1:] * room > reached[:-1]]
        new[first] = True
        at = np.flatnonzero(new)
        last = np.r_[at[1:], len(start)] - 1
        offsets = np.searchsorted(at, np.r_[first, len(start)]).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(start[at]), pa.array(reached[last] - group[last] * room)], fields=list(_RUNS.value_type))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), batch.column(1).take(pa.array(first)),
                                           pa.ListArray.from_arrays(pa.array(offsets), runs)], names=["doc_id", "text_key", "runs"])

    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        ids, keys = batch.column(0), batch.column(1).to_numpy()
        gone = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        change = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (gone[1:] != gone[:-1])
        first = np.r_[0, np.flatnonzero(change) + 1]
        if len(first) > 1:  # the last document may go on in the next batch
            yield merged(batch.slice(0, first[-1]), first[:-1])
        rest = batch.slice(first[-1])
    if rest is not None and rest.num_rows:
        yield merged(rest, np.zeros(1, np.int64))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text, at, parts = text or b"", 0, []
            for r in runs or []:
                parts.append(text[at:r["start"]])
                at = r["stop"]
            kept.append(b"".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t or b"") for t in batch.column(1).to_pylist()], pa.int64()),
             pa.array([r or [] for r in batch.column(2).to_pylist()], _RUNS), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, n_bytes, removed (array of start, stop in bytes), kept (the remaining bytes).

    Null texts count as empty; texts shorter than ``length`` lose nothing; whole rows that repeat repeat each other
    and lose all a window covers.  Cuts may fall inside a UTF-8 character.  Other columns are not read.
    """
    rows, spark = _keyed(docs, id_col, text_col), docs.sparkSession
    before = set(scratch_tables(spark))
    spans = repeat_spans(rows, length, gram, bucket).select("doc_id", "text_key", "start", "stop")
    # a document's own spans: rows dealt and sorted by document, merged as they stream by
    runs = spans.repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "start").mapInArrow(
        _merge_spans, "doc_id long, text_key long, runs array<struct<start:bigint,stop:bigint>>")
    done = [t for t in scratch_tables(spark) if t not in before]
    runs = _stored(runs, "covered")
    drop_scratch(spark, done)  # nothing but the runs is read from here on
    joined = rows.alias("t").join(runs.alias("s"), _same("t", "s"), "left").select("t.doc_id", "t.text", "s.runs")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, removed array<struct<start:bigint,stop:bigint>>, kept binary")
