"""Example conversations per reported term.

A conversation is an example of a term when its cleaned text contains the term
with word boundaries (``\\bterm\\b``).  All terms are found in one scan of the
texts by an automaton (`matching.term_hits`; a list of any length works), and
only the hits leave it.

Ranking moves narrow rows only — term, date, id and a hash of the text — and
``row_number() <= n`` is cut on the map side (``WindowGroupLimit``).  The texts
of the survivors are fetched afterwards.  Terms without any match keep one row
with null example columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .matching import term_hits


def _ordering(order: str):
    if order == "recent":
        return [F.desc("date"), F.asc("conversation_id"), F.asc("_key")]
    if order == "id":
        return [F.asc("conversation_id"), F.asc("_key")]
    raise ValueError("order must be 'recent' or 'id'")


def _examples(prepared: DataFrame, terms: DataFrame, n: int, order: str) -> DataFrame:
    """(_term, rn, date, conversation_id, verbatim): up to n matches of each distinct term (column ``_term``)."""
    rows = prepared.select("date", "conversation_id", F.xxhash64("verbatim").alias("_key"), "clean")
    met = term_hits(rows, terms, "clean", "_term", name="_term")
    w = Window.partitionBy("_term").orderBy(*_ordering(order))
    best = met.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    best = materialize(best)  # at most n narrow rows a term, read twice
    texts = prepared.select("date", "conversation_id", F.xxhash64("verbatim").alias("_key"), "verbatim").alias("p")
    keys = best.select("date", "conversation_id", "_key").distinct().alias("k")
    same = lambda a, b: (F.col(f"{a}.conversation_id").eqNullSafe(F.col(f"{b}.conversation_id"))
                         & F.col(f"{a}.date").eqNullSafe(F.col(f"{b}.date")) & (F.col(f"{a}._key") == F.col(f"{b}._key")))
    found = texts.join(keys, same("p", "k"), "left_semi").dropDuplicates(["date", "conversation_id", "_key"]).alias("f")
    return best.alias("b").join(found, same("b", "f")).select("b._term", "b.rn", "b.date", "b.conversation_id", "f.verbatim")


def _attach(terms_df: DataFrame, ex: DataFrame, term_col: str) -> DataFrame:
    joined = terms_df.alias("t").join(ex.alias("e"), F.col(f"t.{term_col}") == F.col("e._term"), "left")
    return joined.select(*[F.col(f"t.{c}") for c in terms_df.columns], F.col("e.rn").cast("int").alias("rn"),
                         "e.date", "e.conversation_id", "e.verbatim")


def term_examples(prepared: DataFrame, terms_df: DataFrame, n: int = 20, order: str = "recent",
                  term_col: str = "term") -> DataFrame:
    """terms_df columns + rn, date, conversation_id, verbatim (up to n rows per term).

    ``order="recent"``: newest first, ties by conversation_id; ``"id"``: by conversation_id.
    """
    return term_examples_many(prepared, {"one": terms_df}, n, order, term_col)["one"]


def term_examples_many(prepared: DataFrame, term_lists: dict[str, DataFrame], n: int = 20,
                       order: str = "recent", term_col: str = "term") -> dict[str, DataFrame]:
    """``term_examples`` for several term lists with a single pass over the conversations."""
    _ordering(order)
    lists = {k: materialize(df) for k, df in term_lists.items()}  # each is read twice
    terms = None
    for df in lists.values():
        own = df.select(F.col(term_col).alias("_term"))
        terms = own if terms is None else terms.unionByName(own)
    ex = _examples(prepared, terms, n, order)
    if len(lists) > 1:
        ex = materialize(ex)
    return {k: _attach(df, ex, term_col) for k, df in lists.items()}
