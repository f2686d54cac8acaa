"""Filter interaction audit by the Hart-Mas-Colell potential of the removal game.

The players are the filters, and the worth ``v(S)`` of a coalition S of them is
the number of documents that at least one filter of S removes.  A document
matters only through the set of filters it fails, so one pass reduces the
corpus to at most ``2^k`` counts a part.  On those the potential

    P(S) = (v(S) + sum over i in S of P(S without i)) / |S|,  P(empty) = 0

is computed recursively over all coalitions; the Shapley value of filter i is
``P(all) - P(all without i)``.  ``k! P`` is whole, so everything is 64-bit
integers.  Whatever an order of filters does at a step is a difference of two
coalitions: the filters before the step, and those with the step's own.

The duplicate filter needs the corpus: a text is known by its SHA-256, rows of
one text and part are summed before they meet, so a text that a third of all
rows hold is as many rows as it has parts.  DataFrame operations only.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_of


def too_short(text: Column, words: Column) -> Column:
    return F.size(words) < 50


def repetitive(text: Column, words: Column) -> Column:
    return F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(65).cast("long")


def shouting(text: Column, words: Column) -> Column:
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return capitals * F.lit(100).cast("long") > F.length(text) * F.lit(5).cast("long")


def symbols(text: Column, words: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: filters of a text and its words (true: the document fails), by letter; the duplicate filter comes last
FILTERS = {"A": too_short, "B": repetitive, "C": shouting, "D": symbols}
DUPLICATE = "E"
COUNTS = ("n", "good", "toxic")


def failure_sets(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source", filters=None) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail, bit i for the i-th filter.

    Null texts and parts count as empty.  A null id is neither smaller nor larger than another: its row never fails
    the duplicate filter.  Rows that repeat an id with one text do not fail through each other.  ``labels`` holds
    quality and toxic by doc_id; of several rows for one id the larger values hold.
    """
    filters = FILTERS if filters is None else filters
    text, words = F.col("text"), F.col("words")
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails(text, words), F.lit(1 << i)).otherwise(F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).select(
        "doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where(
        "doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = rows.join(known, "doc_id", "left").withColumn("n", F.lit(1).cast("long"))
    total = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS]
    by_id = rows.groupBy("doc_id", "digest", "part").agg(F.first("mask").alias("mask"), *total)
    # rows of a text and part: all of them, and those of the smallest id among them
    has_id = F.col("doc_id").isNotNull()
    by_text = by_id.groupBy("digest", "part").agg(
        F.first("mask").alias("mask"), *[F.sum(c).alias(c) for c in COUNTS],
        *[F.sum(F.when(has_id, F.col(c)).otherwise(0)).alias(f"{c}_id") for c in COUNTS],
        F.min(F.when(has_id, F.struct("doc_id", *COUNTS))).alias("first"))
    first_id = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a row a part, however many copies
    by_text = by_text.withColumn("leads", F.coalesce(F.col("first.doc_id") == first_id, F.lit(False)))
    copies = {c: F.col(f"{c}_id") - F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(0) for c in COUNTS}
    bit = 1 << len(filters)
    both = F.array(
        F.struct((F.col("mask") + bit).alias("mask"), *[copies[c].alias(c) for c in COUNTS]),
        F.struct(F.col("mask").alias("mask"), *[(F.col(c) - copies[c]).alias(c) for c in COUNTS]))
    return by_text.select("part", F.inline(both)).where("n > 0").groupBy("part", "mask").agg(
        *[F.sum(c).alias(c) for c in COUNTS])


def coalitions(sets: DataFrame, k: int) -> DataFrame:
    """One row a part: total, removed_n, removed_good, removed_toxic (arrays over the 2^k coalitions) and potential.

    ``potential`` is k! times the Hart-Mas-Colell potential of the game ``removed_n``.
    """
    # at most 2^k rows a part
    parts = sets.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("mask", *COUNTS)).alias("sets"))

    def removed(count: str) -> Column:
        worth = lambda s: F.aggregate("sets", F.lit(0).cast("long"), lambda acc, x: acc + F.when(
            x["mask"].bitwiseAND(s) != 0, x[count]).otherwise(F.lit(0).cast("long")))
        return F.transform(F.sequence(F.lit(0), F.lit(2 ** k - 1)), worth)

    parts = parts.select("part", "total", *[removed(c).alias(f"removed_{c}") for c in COUNTS])
    none = F.lit(0).cast("long")

    def extend(known: Column, s: Column) -> Column:
        without = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s.bitwiseXOR(F.lit(1 << i)))).otherwise(none)
                   for i in range(k)]
        worth = F.get("removed_n", s) * F.lit(math.factorial(k)).cast("long")
        here = F.call_function("div", sum(without, worth), F.bit_count(s).cast("long"))
        return F.concat(known, F.array(here))

    # subsets of a coalition have smaller numbers, so their potentials are known before it
    potential = F.aggregate(F.sequence(F.lit(1), F.lit(2 ** k - 1)), F.array(none), extend)
    return parts.withColumn("potential", potential)


def interaction_audit(docs: DataFrame, labels: DataFrame, filters=None, **cols) -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter does after those before it.

    Columns: part, filter_order (the letters in order), step (from 1), kept, removed, redundant (fails the filter,
    removed earlier), unique_fails (fails this filter only), good_lost, toxic_lost (removed here with quality or
    toxic 1), shapley (removed by the filter, summed over all k! orders).  Every part has all k * k! rows, zeros
    included; an empty table has no part.  Nulls, repeated rows: see `failure_sets`.  Other columns are not read.
    """
    filters = FILTERS if filters is None else filters
    letters = "".join(filters) + DUPLICATE
    k = len(letters)
    everyone = 2 ** k - 1
    games = coalitions(failure_sets(docs, labels, filters=filters, **cols), k)
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(letters)])
    bit_of = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), letter) - 1)
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn(
        "own", bit_of(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn(
        "before", F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0), lambda acc, i: F.when(
            i < F.col("step"), acc.bitwiseOR(bit_of(F.substring("filter_order", i, F.lit(1))))).otherwise(acc)))
    v = lambda coalition, count="n": F.get(f"removed_{count}", coalition)
    before, own = F.col("before"), F.col("own")
    after, others = before.bitwiseOR(own), F.lit(everyone).bitwiseXOR(own)
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - v(after)).alias("kept"), (v(after) - v(before)).alias("removed"),
        (v(before) + v(own) - v(after)).alias("redundant"), (v(F.lit(everyone)) - v(others)).alias("unique_fails"),
        (v(after, "good") - v(before, "good")).alias("good_lost"), (v(after, "toxic") - v(before, "toxic")).alias("toxic_lost"),
        (F.get("potential", F.lit(everyone)) - F.get("potential", others)).alias("shapley"))


#: DuckDB SQL for the rows of `interaction_audit` on documents and labels, by counting every order's steps
AUDIT_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
    known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT w.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
                 (len(words) < 50)::INT
                 + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
                 + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
                 + 8 * regexp_matches(t, '[#$%&*|]')::INT
                 + 16 * coalesce(w.doc_id > first_id, false)::INT AS mask
          FROM w LEFT JOIN known k ON w.doc_id = k.doc_id),
    c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
    l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(letter, bit)),
    o AS (SELECT a.letter || b.letter || c1.letter || d1.letter || e.letter AS filter_order,
                 [a.bit, b.bit, c1.bit, d1.bit, e.bit] AS bits
          FROM l a, l b, l c1, l d1, l e WHERE (a.bit | b.bit | c1.bit | d1.bit | e.bit) = 31),
    s AS (SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step - 1])::INT AS before
          FROM (SELECT *, unnest(range(1, 6))::INT AS step FROM o)),
    r AS (SELECT part, filter_order, step, own, coalesce(before, 0) AS b FROM s, (SELECT DISTINCT part FROM c)),
    counted AS (
        SELECT r.part, filter_order, step, own,
               sum(CASE WHEN mask & (b | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
               sum(CASE WHEN mask & b = 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
               sum(CASE WHEN mask & b <> 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
               sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
               sum(CASE WHEN mask & b = 0 AND mask & own <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
               sum(CASE WHEN mask & b = 0 AND mask & own <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM r JOIN c ON c.part = r.part GROUP BY r.part, filter_order, step, own)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM counted"""
