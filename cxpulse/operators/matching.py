"""Word-bounded matching of a term list of any length against texts.

A text holds a term where the term stands in it between word edges
(``\\bterm\\b``).  All terms go into one Aho-Corasick automaton, and every text
is read once: its Arrow batch is scanned where it lies, an occurrence counts if
both its ends are word edges, and only the (row, term) hits leave the scan.  No
text is shuffled and none is copied for its words.

A list longer than `BLOCK` terms is dealt into blocks by the terms' hash; each
block is an automaton of its own and one more scan of the texts, so neither the
driver nor a task ever holds more than about `BLOCK` terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package

#: terms an automaton holds (and the driver reads at once)
BLOCK = 200_000
#: what separates words in a cleaned text; the edge of a text does too
SEPARATORS = frozenset(" '-")

_AUTOMATA: dict[str, object] = {}  # of a Python worker: the last block it has built


def _automaton(key: str, terms: list[str]):
    import ahocorasick

    if key not in _AUTOMATA:
        found = ahocorasick.Automaton()
        for t in terms:
            found.add_word(t, (t, len(t), t[0] in SEPARATORS, t[-1] in SEPARATORS))
        found.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = found
    return _AUTOMATA[key]


def matcher(terms: list[str]) -> Callable[[str], list[str]]:
    """text -> the distinct terms it holds between word edges, sorted; built where it is first called."""
    key = uuid.uuid4().hex

    def find(text: str) -> list[str]:
        out, padded = set(), f" {text} "
        for end, (term, n, first, last) in _automaton(key, terms).iter(padded):
            # an edge lies between a separator and a character that is none
            if (padded[end - n] in SEPARATORS) != first and (padded[(end + 1) % len(padded)] in SEPARATORS) != last:
                out.add(term)
        return sorted(out)

    return find


def _held_terms(terms: list[str], text: Column) -> Column:
    find = matcher(terms)

    @F.arrow_udf("array<string>")
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([find(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return held(text)


def term_hits(rows: DataFrame, terms: DataFrame, text_col: str, term_col: str = "term", keep: list[str] | None = None,
              block: int = BLOCK, name: str = "term") -> DataFrame:
    """The ``keep`` columns of ``rows`` (all but the text by default) and ``name``: one row a row and distinct term it holds.

    ``text_col`` is cleaned text (letters, blanks, ``'`` and ``-``).  Null and empty texts hold nothing; null and empty
    terms and those without a letter are held by nothing; a term that is listed twice counts once; rows that repeat
    stay repeated.
    """
    ship_package(rows.sparkSession)
    keep = [c for c in rows.columns if c != text_col] if keep is None else keep
    usable = F.length(F.translate(F.col(term_col), " '-", "")) > 0
    wanted = materialize(terms.where(usable).select(F.col(term_col).alias("term")).distinct())
    n_blocks = max(1, -(-wanted.count() // block))
    hits = None
    for i in range(n_blocks):
        part = [r["term"] for r in wanted.where(F.pmod(F.xxhash64("term"), F.lit(n_blocks)) == i).collect()]
        if not part:
            continue
        found = rows.select(*keep, F.explode(_held_terms(part, F.col(text_col))).alias(name))
        hits = found if hits is None else hits.unionByName(found)
    return rows.select(*keep, F.lit("").alias(name)).limit(0) if hits is None else hits


def term_document_counts(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, term_col: str = "term",
                         block: int = BLOCK) -> DataFrame:
    """term, n_docs long, first_id: for every usable term that a text holds (see `term_hits`)."""
    hits = term_hits(docs, terms, text_col, term_col, [id_col], block)
    return hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.min(id_col).alias("first_id"))


def phrases(texts: DataFrame, text_col: str) -> DataFrame:
    """term: the distinct words of cleaned texts and pairs of neighbouring words, from letter to letter."""
    tokens = F.split(F.col(text_col), " ")
    held = texts.select(tokens.alias("w"), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))).alias("next"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("next")), "next", lambda a, b: F.concat(a, F.lit(" "), b))
    terms = held.select(F.explode(F.array_distinct(F.concat("w", pairs))).alias("term"))
    return terms.where(F.rlike("term", F.lit(r"^[^ '-](.*[^ '-])?$"))).distinct()
