"""Line dedup on content-defined chunks of lines.

Lines are hashed (the first eight bytes of their MD5, as a 32-bit number); a
rolling hash over the hashes of the last two lines puts a chunk boundary after
a line when it is divisible by ``DIVISOR``.  Boundaries depend on nearby lines
only, so an inserted or removed line shifts one chunk and the next ones fall
back into step.  Chunks of two lines or more that occur again anywhere, their
bytes compared, are removed everywhere but at their first place (smallest
document id, then place in the document).

Every Arrow batch sends each distinct chunk once, with its content; chunks
arrive sorted by digest, so one content at a time is held for the comparison,
and a chunk that a third of all documents share costs a row a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, text_of

DIVISOR = 4
BASE = 31
_MOD = 1 << 32


def chunks(text: str, divisor: int = DIVISOR) -> list[tuple[int, int]]:
    """(first line, lines) of each chunk of a text; lines are cut at line feeds."""
    out, first, before = [], 0, 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        h = int.from_bytes(hashlib.md5(line.encode()).digest()[:8], "little") % _MOD
        rolled = (h + BASE * before) % _MOD
        before = h
        if rolled % divisor == 0 or i == len(lines) - 1:
            out.append((first, i + 1 - first))
            first = i + 1
    return out


def _chunk_rows(text: str, divisor: int) -> tuple[int, list[tuple[bytes, int, int, bytes]]]:
    """(chunks, [(digest, first line, lines, content)] of those of two lines or more)."""
    cut, lines = chunks(text, divisor), text.split("\n")
    out = []
    for first, n in cut:
        if n > 1:
            content = "\n".join(lines[first:first + n]).encode()
            out.append((hashlib.blake2b(content, digest_size=16).digest(), first, n, content))
    return len(cut), out


def _merge_batches(divisor: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for digest, first, _, content in _chunk_rows(text, divisor)[1]:
                    place = (doc_id is None, doc_id or 0, first)
                    if digest not in found:
                        found[digest] = [1, place, content]
                        continue
                    _same(found[digest][2], content)
                    found[digest][0] += 1
                    found[digest][1] = min(found[digest][1], place)
            rows = list(found.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([None if r[1][0] else r[1][1] for r in rows], pa.int64()),
                 pa.array([r[1][2] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                names=["digest", "n", "first_id", "first_line", "content"])

    return work


def _same(a: bytes, b: bytes) -> None:
    if a != b:
        raise ValueError("two different chunks share a digest")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest -> the chunks that occur more than once, contents compared."""
    live: list | None = None

    def out(done):
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([None if d[2][0] else d[2][1] for d in done], pa.int64()), pa.array([d[2][2] for d in done], pa.int64())],
            names=["digest", "n", "first_id", "first_line"])

    for batch in batches:
        done = []
        for digest, n, doc_id, line, content in zip(*(c.to_pylist() for c in batch.columns)):
            place = (doc_id is None, doc_id or 0, line)
            if live is not None and live[0] == digest:
                _same(live[3], content)
                live[1] += n
                live[2] = min(live[2], place)
                continue
            if live is not None and live[1] > 1:
                done.append(live)
            live = [digest, n, place, content]
        if done:
            yield out(done)
    if live is not None and live[1] > 1:
        yield out([live])


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """(digest, n, first_id, first_line): the multi-line chunks that occur more than once and where they stay."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    merged = rows.mapInArrow(_merge_batches(divisor), "digest binary, n long, first_id long, first_line long, content binary")
    return merged.repartition("digest").sortWithinPartitions("digest").mapInArrow(
        _repeated, "digest binary, n long, first_id long, first_line long")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """One row per input row: doc_id, text_key, n_lines, n_chunks, removed (array of first line and lines, in order).

    Null and empty texts are one empty line.  Rows that share an id keep a chunk all of them or none (they tie for
    its first place); null ids come last.  ``text_key`` (XXH64 of the text) tells rows of one id apart.
    """
    def list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("digest", pa.binary()), ("line", pa.int64()), ("lines", pa.int64())]))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            cut = [_chunk_rows(t, divisor) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t.count("\n") + 1 for t in texts], pa.int64()),
                 pa.array([n for n, _ in cut], pa.int64()),
                 pa.array([[{"digest": d, "line": f, "lines": n} for d, f, n, _ in c] for _, c in cut], kind)],
                names=["doc_id", "text_key", "n_lines", "n_chunks", "chunks"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key"),
                       text_of(text_col).alias("text"))
    listed = rows.mapInArrow(list_chunks, "doc_id long, text_key long, n_lines long, n_chunks long, "
                             "chunks array<struct<digest:binary,line:bigint,lines:bigint>>")
    listed = checkpointed(listed.withColumn("row", F.monotonically_increasing_id()))
    again = repeated_chunks(docs, id_col, text_col, divisor)
    each = listed.select("row", "doc_id", F.inline("chunks")).join(again, "digest")
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("line") == F.col("first_line"))
    gone = each.where(~stays).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("line", "lines"))).alias("removed"))
    none = F.array().cast("array<struct<line:bigint,lines:bigint>>")
    return listed.join(gone, "row", "left").select("doc_id", "text_key", "n_lines", "n_chunks",
                                                   F.coalesce("removed", none).alias("removed"))


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """The input rows, their texts without the removed chunks (a text that loses all its lines becomes empty)."""
    plan_id, plan_key, gone = fresh(docs, "plan_id", "plan_key", "gone")
    plan = line_dedup(docs, id_col, text_col, divisor).where("size(removed) > 0").select(
        F.col("doc_id").alias(plan_id), F.col("text_key").alias(plan_key), F.col("removed").alias(gone))
    plan = plan.dropDuplicates([plan_id, plan_key])
    joined = docs.join(plan, F.col(id_col).cast("long").eqNullSafe(F.col(plan_id))
                       & (F.xxhash64(text_of(text_col)) == F.col(plan_key)), "left")

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for text, runs in zip(texts.to_pylist(), removed.to_pylist()):
            lines = text.split("\n")
            for r in reversed(runs):
                del lines[r["line"]:r["line"] + r["lines"]]
            out.append("\n".join(lines))
        return pa.array(out, pa.string())

    none = F.array().cast("array<struct<line:bigint,lines:bigint>>")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(cut(text_of(text_col), F.coalesce(gone, none)))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


#: the same in DuckDB SQL
LINE_SQL = rf"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, r, len(ls) AS n_lines, unnest(ls) AS txt, unnest(range(len(ls))) AS line FROM d),
    h AS (SELECT *, (md5_number_upper(txt) % {_MOD})::BIGINT AS h FROM l),
    b AS (SELECT *, ((h + {BASE} * coalesce(lag(h) OVER (PARTITION BY r ORDER BY line), 0)) % {_MOD}) % {DIVISOR} = 0 AS cut FROM h),
    c AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY r ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM b),
    k AS (SELECT doc_id, r, chunk, n_lines, min(line) AS line, count(*) AS lines, string_agg(txt, chr(10) ORDER BY line) AS content
          FROM c GROUP BY doc_id, r, chunk, n_lines),
    g AS (SELECT content, count(*) AS n, min((doc_id IS NULL, coalesce(doc_id, 0), line)) AS place FROM k WHERE lines > 1 GROUP BY content),
    x AS (SELECT k.*, coalesce(g.n > 1 AND (doc_id IS NULL, coalesce(doc_id, 0), line) <> g.place, false) AS gone
          FROM k LEFT JOIN g ON k.lines > 1 AND k.content = g.content)
    SELECT doc_id, max(n_lines)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed_chunks,
           coalesce(sum(lines) FILTER (gone), 0)::BIGINT AS n_removed_lines,
           coalesce(string_agg(line::VARCHAR || '+' || lines::VARCHAR, ',' ORDER BY line) FILTER (gone), '') AS removed
    FROM x GROUP BY doc_id, r"""
