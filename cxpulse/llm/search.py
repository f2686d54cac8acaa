"""Ranked lexical search by the Best Position Algorithm.

Per document and query term an integer impact is known, so each term has a list
of documents by falling impact.  A query reads its terms' lists in step from
the top; every document met is looked up in all the other lists (direct
access), which gives its whole score and marks its positions as seen there.
The best position of a list is the end of its unbroken run of seen positions,
often far below the last one read.  No unseen document can score more than the
sum of the impacts at the best positions; once that is strictly below the k-th
score (equal scores still compete by id), the query is done.

On Spark: one pass turns whole texts into their counts of query terms, stored
as a narrow table; document frequencies, the number of documents and their
length are aggregates of it.  The table is dealt into shards of a bounded
number of postings, each shard has its own lists and answers all queries for
its documents exactly, and the k best of all shards' answers are kept.  Terms
are never a key, so a term in every document is spread like any other.  Items
are worked in blocks of a bounded number of (item, term) rows, which are the
only thing sent to all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_scratch, materialize_table, scratch_tables
from .common import text_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
BLOCK = 200_000  # (item, term) rows answered in one pass over the documents (plus at most one bin of items)
BINS = 4096
SHARD = 3_000_000  # postings a task holds at a time
STEP = 64  # positions first read of each list between two looks at the threshold; doubles

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _byte_table() -> bytes:
    """Separators to a blank, A-Z to a-z; bytes of other characters stay."""
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"0123456789" + LOWER.encode():
        out[c] = c
    for a, b in zip(UPPER.encode(), LOWER.encode()):
        out[a] = b
    return bytes(out)


def term_counts(text: bytes, table: bytes = _byte_table()) -> tuple[Counter, int]:
    """Terms of a UTF-8 text with their occurrences, and how many terms it has."""
    terms = text.translate(table).split()
    return Counter(terms), len(terms)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item_id, term, block) rows; blocks hold about ``BLOCK`` of them and every item is in one block."""
    text = F.translate(text_of(text_col), UPPER, LOWER)
    rows = items.select(F.col(id_col).alias("item_id"), F.explode(
        F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1))).alias("term")).distinct()
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("item_id"), F.lit(BINS)))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    bins = rows.groupBy("bin").count().select(
        "bin", F.floor(F.coalesce(F.sum("count").over(before), F.lit(0)) / BLOCK).cast("long").alias("block"))
    return materialize_table(rows.join(bins, "bin").select("item_id", "term", "block"), "items")


def _postings(terms: dict[bytes, int]):
    """(doc_id, text) -> (doc_id, n, terms, counts): documents with a term, and the query terms they hold."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.get
        for batch in batches:
            ids, sizes, ends, held, counts = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, n = term_counts(text)
                if not n:
                    continue
                for term, count in found.items():
                    if (i := number(term)) is not None:
                        held.append(i)
                        counts.append(count)
                ids.append(doc_id)
                sizes.append(n)
                ends.append(len(held))
            end = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(end, pa.array(held, pa.int32())),
                 pa.ListArray.from_arrays(end, pa.array(counts, pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    return work


class ImpactLists:
    """The impact lists of one shard: postings by term and falling impact, with direct access by document."""

    def __init__(self, doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, docs: np.ndarray, terms: np.ndarray,
                 counts: np.ndarray, n_terms: int, n_docs: int, all_terms: int):
        self.doc_ids, self.known = doc_ids, known
        m = 100 - 50 + (50 * sizes * n_docs) // all_terms
        impact = (1_000_000_000 * counts) // (1000 * counts + 20 * m[docs])
        order = np.lexsort((docs, -impact, terms))
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.docs, self.impacts = docs[order], impact[order]
        # direct access: documents of a term in ascending order, and where its list has them
        place = np.lexsort((self.docs, terms[order]))
        self.sorted_docs = self.docs[place]
        self.positions = place - self.starts[terms[order][place]]

    def look_up(self, term: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``docs``, in ascending order, are in the term's list; their positions there)."""
        a, b = self.starts[term], self.starts[term + 1]
        own = self.sorted_docs[a:b]
        at = np.searchsorted(own, docs)
        hit = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == docs) if len(own) else np.zeros(0, np.int64)
        return hit, self.positions[a:b][at[hit]]

    def best(self, terms: list[int], weights: list[int], top: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``top`` highest scores above 0, equal ones by id (null last): best positions."""
        lists = [(t, w, int(self.starts[t]), int(self.starts[t + 1] - self.starts[t])) for t, w in zip(terms, weights)]
        lists = [x for x in lists if x[3] and x[1] > 0]
        seen = [np.zeros(n, bool) for *_, n in lists]
        best = [0] * len(lists)  # length of the run of seen positions
        met = np.zeros(len(self.doc_ids), bool)
        docs, scores, step = np.zeros(0, np.int64), np.zeros(0, np.int64), STEP
        while any(b < x[3] for b, x in zip(best, lists)):
            # sorted access: the next positions of every list that are not known yet
            new = np.concatenate([self.docs[a + b:a + min(b + step, n)] for b, (_, _, a, n) in zip(best, lists)])
            new = np.unique(new)
            new = new[~met[new]]
            met[new] = True
            step *= 2
            # direct access: whole scores, and positions seen in every list
            score = np.zeros(len(new), np.int64)
            for j, (term, weight, a, n) in enumerate(lists):
                hit, at = self.look_up(term, new)
                score[hit] += weight * self.impacts[a + at]
                seen[j][at] = True
                run = seen[j][best[j]:]
                best[j] += int(run.argmin()) if not run.all() else len(run)
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, score])
            keep = np.lexsort((self.doc_ids[docs], ~self.known[docs], -scores))[:top]
            docs, scores = docs[keep], scores[keep]
            bound = sum(w * int(self.impacts[a + b - 1]) for b, (_, w, a, n) in zip(best, lists) if b < n)
            if len(docs) == top and bound < scores[-1]:
                break
        return docs[scores > 0], scores[scores > 0]


def _answers(items: list[tuple], weights: list[int], n_docs: int, all_terms: int, top: int, shard: int):
    """(doc_id, n, terms, counts) -> (item, doc_id, score): the best of each shard of the partition's documents."""
    def answer(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, lists = table.column("doc_id").combine_chunks(), table.column("terms").combine_chunks()
        held = np.diff(lists.offsets.to_numpy())
        docs = np.repeat(np.arange(len(held)), held)
        index = ImpactLists(
            ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), table.column("n").to_numpy(),
            docs, lists.flatten().to_numpy().astype(np.int64), table.column("counts").combine_chunks().flatten().to_numpy(),
            len(weights), n_docs, all_terms)
        for number, terms in items:
            found, scores = index.best(terms, [weights[t] for t in terms], top)
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), number, np.int32)), ids.take(pa.array(found)), pa.array(scores)],
                    names=["item", "doc_id", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten()) + len(batch)
            if size >= shard:
                yield from answer(held)
                held, size = [], 0
        if held:
            yield from answer(held)

    return work


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", top: int = TOP, shard: int = SHARD) -> DataFrame:
    """The ``top`` highest-scoring documents of every item: item_id, rank (from 1), doc_id, score.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased.  Only scores above 0 count;
    equal ones rank by ascending doc_id, null last.  Null and empty texts have no term; rows that repeat are documents
    of their own; rows of one item_id (null is one too) are one item with the terms of all of them.  An item without
    terms or hits has no row, nor has an empty table.  Other columns are not read.
    """
    spark = docs.sparkSession
    wanted = item_terms(items, item_col, item_text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    kind = dict(wanted.dtypes)["item_id"]
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for (block,) in wanted.select("block").distinct().orderBy("block").collect():  # one a pass over the documents
        asked = wanted.where(F.col("block") == block).select("item_id", "term").collect()  # at most BLOCK and a bin
        numbers = {t: i for i, t in enumerate(sorted({r["term"] for r in asked}))}
        terms: dict = {}
        for r in asked:
            terms.setdefault(r["item_id"], []).append(numbers[r["term"]])
        before = scratch_tables(spark)
        stored = materialize_table(rows.mapInArrow(
            _postings({t.encode("utf-8"): i for t, i in numbers.items()}),
            "doc_id long, n long, terms array<int>, counts array<long>"), "postings")
        n_docs, all_terms, postings = stored.agg(
            F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))).first()
        used = [path for path in scratch_tables(spark) if path not in before]
        if not n_docs:
            drop_scratch(spark, used)
            return out
        weights = [0] * len(numbers)
        for term, df in stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        shards = max(math.ceil((postings + n_docs) / shard), spark.sparkContext.defaultParallelism)
        ids = list(terms)
        best = stored.coalesce(shards).mapInArrow(
            _answers([(i, sorted(terms[x])) for i, x in enumerate(ids)], weights, n_docs, all_terms, top, shard),
            "item int, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
        # the answers are kept, the postings not
        out = out.unionByName(materialize_table(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), "hits"))
        drop_scratch(spark, used)
    return out


#: DuckDB SQL for the rows of `search` on documents and benchmark
SEARCH_SQL = r"""
    WITH p AS (
        SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
    tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM p GROUP BY rid, doc_id, term),
    size AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
    whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
          FROM tf, whole WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
    s AS (SELECT item_id, rid, doc_id,
                 sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))))::BIGINT AS score
          FROM q JOIN tf USING (term) JOIN w USING (term) JOIN size USING (rid), whole
          GROUP BY item_id, rid, doc_id),
    r AS (SELECT item_id, doc_id, score,
                 row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
          FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""
