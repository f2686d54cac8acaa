"""The text functions for `spark.sql`.

`register_functions` makes temporary SQL functions of a session.  They are SQL
expressions that Catalyst inlines, so a query that calls them is planned like
one written with the Column forms: no Python runs and filters still move.

========================  =====================================================
``clean_text(t)``         `text.clean_text`
``letter_runs(clean)``    `text.letter_runs`
``messages(t)``           `text.parse_list_split`: array of the messages of a list text
``neg_score(clean)``      `scoring.neg_score` of the lexicon given
``is_negative(clean)``    score above the lexicon's threshold
``message_rows(t)``       table function: (pos, message) rows of a list text
========================  =====================================================
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .lexicon import CLEAN_LETTERS, DEFAULT_LEXICON, Lexicon
from .scoring import can_overlap
from .text import WHITESPACE


def literal(s: str) -> str:
    """A SQL string literal of any text."""
    return "'" + "".join(c if c.isascii() and (c.isalnum() or c == " ") else f"\\U{ord(c):08x}" for c in s) + "'"


def _bodies(lexicon: Lexicon) -> list[tuple[str, str, str, str]]:
    if can_overlap(lexicon.bigrams) or any(not w.isalpha() for w in lexicon.words):
        raise ValueError("SQL functions need a lexicon of plain words and of phrases that cannot overlap")
    blank = literal(WHITESPACE)
    clean = "lower(t)"
    for pattern, put in ((r"(?U)http\S+", ""), (r"(?U)[^" + CLEAN_LETTERS + r"\s'-]", " "), (r"(?U)\s+", " ")):
        clean = f"regexp_replace({clean}, {literal(pattern)}, {literal(put)})"
    runs = f"split(translate(clean, {literal(chr(39) + '-')}, '  '), ' ')"
    items = (f"array_remove(transform(split(btrim(btrim(btrim(t, {blank}), {literal('[]')}), {blank}), {literal(', ')}, -1), "
             f"x -> btrim(btrim(btrim(x, {blank}), {literal(chr(39) + chr(34))}), {blank})), '')")
    hits = [f"size(filter({runs}, x -> x IN ({', '.join(map(literal, lexicon.words))})))"] if lexicon.words else []
    hits += [f"(octet_length(clean) - octet_length(replace(clean, {literal(b)}, ''))) div {len(b.encode())}" for b in lexicon.bigrams]
    score = (f"CASE WHEN clean IS NOT NULL THEN least(CAST({' + '.join(hits) or '0'} AS DOUBLE) "
             "/ CAST(greatest(size(split(clean, ' ')), 1) AS DOUBLE), 1.0D) END")
    return [("clean_text", "t STRING", "STRING", f"btrim({clean}, ' ')"),
            ("letter_runs", "clean STRING", "ARRAY<STRING>", runs),
            ("messages", "t STRING", "ARRAY<STRING>", items),
            ("neg_score", "clean STRING", "DOUBLE", score),
            ("is_negative", "clean STRING", "BOOLEAN", f"({score}) > {float(lexicon.threshold)}D"),
            ("message_rows", "t STRING", "TABLE (pos INT, message STRING)", f"SELECT * FROM posexplode({items})")]


def register_functions(spark: SparkSession, lexicon: Lexicon = DEFAULT_LEXICON) -> list[str]:
    """Create (or replace) the session's temporary functions; their names."""
    bodies = _bodies(lexicon)
    for name, takes, gives, body in bodies:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    return [b[0] for b in bodies]
