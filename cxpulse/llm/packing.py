"""Packing token sequences by non-negative least squares over a length histogram.

One pass tokenises whole texts and keeps, per document, only lengths and the
checksums of the pieces it could be cut into: full windows, the remainder
(shorter than a window) and the remainder's binary parts (its length's powers
of two, largest first).  The rest is arithmetic on the histogram of remainder
lengths, which has at most ``window - 1`` bins whatever the corpus:

1. enumerate shallow combinations of two or three lengths that fill a window;
2. solve for their repeat counts by non-negative least squares against the
   histogram, and round down to what the histogram holds;
3. residual documents are packed greedily, largest first, as binary parts:
   aligned powers of two never cross a window's end, and the last window is
   left as sequences of powers of two, which need no padding.

Documents find their place by their rank within their remainder's length
(offsets of their input partition plus a running index, no global sort), and
so by a small table of rank intervals; its size depends on the window alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize_table
from .common import text_of

WINDOW = 1024
END = 0  # id that closes every document
MEMO = 100_000  # remembered pre-tokens a worker


@lru_cache(maxsize=1)
def _library(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


@lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k"):
    """text -> its ids as little-endian unsigned 32-bit bytes; equal to the `tokenizers` file of that name.

    Byte-level BPE works on each pre-token by itself, so pre-tokens are memoised.  Texts with characters outside
    the plain set below, whose classes differ between regular-expression engines, go through the library itself.
    """
    import base64
    import re

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path
    with open(path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    del ranks
    letters = "A-Za-zÀ-ÖØ-öø-ÿ"
    pre_tokens = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[0-9]+| ?[^\s{letters}0-9]+|\s+(?!\S)|\s+").findall
    odd = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÿ]|<\|").search

    class Memo(dict):
        def __missing__(self, piece: str) -> bytes:
            ids = plain.encode_ordinary(piece)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(self) >= MEMO:
                self.clear()
            if len(piece) <= 32:
                self[piece] = packed
            return packed

    memo = Memo()

    def encode(text: str) -> bytes:
        if odd(text):
            ids = _library(name).encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(memo.__getitem__, pre_tokens(text)))

    return encode


_SUMMARY = ("doc_id long, doc_tokens long, rem int, part int, idx long, blocks_before long, "
            "block_crc array<long>, rem_crc long, bit_crc array<long>")


def _summaries(window: int, tokenizer: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, crc, end = encoder(tokenizer), zlib.crc32, struct.pack("<I", END)
        part, blocks, seen = TaskContext.get().partitionId(), 0, [0] * window
        size = 4 * window
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                full = len(ids) // size
                tail = ids[full * size:]
                rem = len(tail) // 4
                bits, at = [], 0
                for j in range(window.bit_length() - 2, -1, -1):
                    if rem >> j & 1:
                        bits.append(crc(tail[4 * at:4 * (at + (1 << j))]))
                        at += 1 << j
                row = (doc_id, len(ids) // 4, rem, part, seen[rem], blocks,
                       [crc(ids[i * size:(i + 1) * size]) for i in range(full)], crc(tail), bits)
                for column, value in zip(out, row):
                    column.append(value)
                seen[rem] += 1
                blocks += full
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(),
                     pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)],
                                             names=[f.split()[0] for f in _SUMMARY.split(", ")])

    return work


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, a + b + c = window, of lengths in the histogram (c = 0: two lengths)."""
    lengths = np.flatnonzero(present)
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    have[0] = True
    a = np.repeat(np.arange(1, window), window)
    b = np.tile(np.arange(window), window - 1)
    keep = (a >= b) & (a + b <= window) & (b > 0)
    a, b = a[keep], b[keep]
    c = window - a - b
    keep = (b >= c) & have[a] & have[b] & have[c]
    return np.stack([a[keep], b[keep], c[keep]], 1)


def solve_counts(hist: np.ndarray, window: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, whole repeat counts): min |A x - hist|, x >= 0, by accelerated projected gradient; then rounded.

    A has a column per combination with how often it uses each length.
    """
    combos = combinations(window, hist > 0)
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    want = hist.astype(float)
    scale = max(want.max(), 1.0)
    want = want / scale
    used = lambda x: sum(np.bincount(combos[:, k], x, window + 1) for k in range(3))[:window] * mask
    mask = np.r_[0.0, np.ones(window - 1)]
    back = lambda r: sum(np.r_[r, 0.0][combos[:, k]] for k in range(3))
    # the step: one over a bound of the largest eigenvalue of A'A (power method)
    v = np.ones(len(combos))
    for _ in range(20):
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(0.0, y - back(used(y) - want) / (1.05 * top))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nxt + (t - 1) / s * (nxt - x), nxt, s
    x = x * scale

    # round down, then up where the fraction is large, then whatever still fits; never more than the histogram holds
    left, rows, counts = hist.tolist(), combos.tolist(), np.zeros(len(combos), np.int64)

    def repeat(i: int, most: float) -> None:
        a, b, c = rows[i]
        if a == b == c:
            n = left[a] // 3
        elif a == b:
            n = min(left[a] // 2, left[c] if c else left[a])
        elif b == c:
            n = min(left[a], left[b] // 2)
        else:
            n = min(left[a], left[b], left[c] if c else left[a])
        n = int(min(n, most))
        if n > 0:
            counts[i] += n
            for k in (a, b, c):
                left[k] -= n if k else 0

    whole = np.floor(x)
    for i in np.argsort(-x, kind="stable")[:np.count_nonzero(whole)].tolist():
        repeat(i, whole[i])
    up = x - whole
    for i in np.argsort(-up, kind="stable")[:np.count_nonzero(up > 0.5)].tolist():
        repeat(i, 1)
    for i in np.argsort(combos[:, 2], kind="stable").tolist():
        repeat(i, np.inf)
    return combos[counts > 0], counts[counts > 0]


def plan_remainders(hist: np.ndarray, window: int) -> tuple[list[tuple], list[tuple], int, dict]:
    """(slots, residuals, sequences, tail) from the histogram alone.

    slots: (rem, first rank, last rank, first sequence, offset): ranks of a length that fill combination slots.
    residuals: (rem, first rank, bit, start, token position of the first one's part): positions in the residual stream.
    tail: the token position of the last, incomplete window and its fill.
    """
    combos, counts = solve_counts(hist, window)
    slots, sequence, used = [], 0, np.zeros(window, np.int64)
    for combo, n in zip(combos.tolist(), counts.tolist()):
        offset = 0
        for length in combo:
            if length:
                slots.append((length, int(used[length]), int(used[length]) + n - 1, sequence, offset))
                used[length] += n
                offset += length
        sequence += n
    left = hist - used
    residuals, position = [], 0
    for j in range(window.bit_length() - 2, -1, -1):
        for rem in np.flatnonzero(left).tolist():
            if rem >> j & 1:
                start = rem >> (j + 1) << (j + 1)
                residuals.append((rem, int(used[rem]), j, start, position))
                position += int(left[rem]) << j
    return slots, residuals, sequence, {"position": position // window * window, "fill": position % window}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of one token, the closing id.  Rows that repeat, in id or altogether, are
    documents of their own.  Every sequence is full but the last few, whose lengths are powers of two.  An empty
    table gives an empty result.  Other columns are not read.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    summary = materialize_table(rows.mapInArrow(_summaries(window, tokenizer), _SUMMARY), "packing")
    hist = np.zeros(window, np.int64)
    for r in summary.where("rem > 0").groupBy("rem").count().collect():  # at most window - 1 rows
        hist[r["rem"]] = r["count"]
    slots, residuals, sequences, tail = plan_remainders(hist, window)

    # ranks: documents of the same length in earlier partitions, then the running index
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = summary.groupBy("part", "rem").agg(F.count("*").alias("n"))
    ranks = counts.select("part", "rem", F.coalesce(F.sum("n").over(
        earlier.partitionBy("rem")), F.lit(0)).alias("rank0"))
    blocks = summary.groupBy("part").agg(F.max(F.col("blocks_before") + F.size("block_crc")).alias("n"))
    blocks = blocks.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("block0"))  # a row a partition
    placed = summary.join(ranks, ["part", "rem"]).join(blocks, "part").withColumn("rank", F.col("rank0") + F.col("idx"))

    # ids: combinations, full residual windows, the last one's parts, full blocks
    first_block = sequences + tail["position"] // window + tail["fill"].bit_count()

    def struct_(start, length, crc, sequence, offset):
        return F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), crc.alias("ids_crc32"),
                        sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))

    full = F.transform("block_crc", lambda crc, i: struct_(
        i * window, F.lit(window), crc, F.lit(first_block) + F.col("block0") + F.col("blocks_before") + i, F.lit(0)))
    out = [placed.select("doc_id", "doc_tokens", F.explode(full).alias("p")).select("doc_id", "doc_tokens", "p.*")]
    whole = placed.where("rem > 0").select("doc_id", "doc_tokens", "rem", "rank", "rem_crc", "bit_crc",
                                           (F.size("block_crc") * window).cast("long").alias("tail_start"))
    # both tables: rows bounded by the window (a few thousand), never by the corpus
    slot_table = F.broadcast(spark.createDataFrame(slots, "rem int, lo long, hi long, seq0 long, off int")) if slots else None
    if slots:
        hit = whole.join(slot_table, "rem").where("rank between lo and hi")
        out.append(hit.select("doc_id", "doc_tokens", struct_(
            F.col("tail_start"), F.col("rem"), F.col("rem_crc"), F.col("seq0") + F.col("rank") - F.col("lo"),
            F.col("off")).alias("p")).select("doc_id", "doc_tokens", "p.*"))
    if residuals:
        table = F.broadcast(spark.createDataFrame(residuals, "rem int, first long, bit int, at int, pos0 long"))
        hit = whole.join(table, "rem").where("rank >= first")
        length = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
        hit = hit.withColumn("length", length).withColumn("pos", F.col("pos0") + (F.col("rank") - F.col("first")) * F.col("length"))
        nth = F.bit_count(F.call_function("shiftright", F.col("rem"), F.col("bit") + 1)) + 1
        within = F.col("pos") - tail["position"]  # in the last window: one sequence for each bit of its fill
        sequence, offset = F.lit(sequences) + F.floor(F.col("pos") / window), F.pmod("pos", F.lit(window))
        at, k = 0, 0
        for j in range(window.bit_length() - 2, -1, -1):
            if tail["fill"] >> j & 1:
                inside = (within >= at) & (within < at + (1 << j))
                sequence = F.when(inside, F.lit(sequences + tail["position"] // window + k)).otherwise(sequence)
                offset = F.when(inside, within - at).otherwise(offset)
                at, k = at + (1 << j), k + 1
        out.append(hit.select("doc_id", "doc_tokens", struct_(
            F.col("tail_start") + F.col("at"), F.col("length"), F.element_at("bit_crc", nth.cast("int")), sequence,
            offset).alias("p")).select("doc_id", "doc_tokens", "p.*"))
    pieces = out[0]
    for more in out[1:]:
        pieces = pieces.unionByName(more)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
