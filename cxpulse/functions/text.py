"""Column -> Column text expressions.

Everything here is a native Spark expression (JVM side, whole-stage codegen);
no Python runs per row.  Regular expressions use ``(?U)`` so that Java's
character classes are Unicode aware (NBSP is whitespace, ``\\w`` covers é...).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CLEAN_LETTERS, DEFAULT_STOPWORDS

_URL = r"(?U)http\S+"
_NOT_KEPT = r"(?U)[^" + CLEAN_LETTERS + r"\s'-]"
_SPACES = r"(?U)\s+"

# The Unicode White_Space characters (what Java's (?U)\s and Rust's trim()
# treat as whitespace), built by rule: Python's isspace() minus the four
# information separators U+001C..U+001F, which are not White_Space.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace() and not "\x1c" <= ch <= "\x1f")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip Unicode whitespace at both ends.

    ``F.trim`` only strips the ASCII space; ``btrim`` with the White_Space set
    strips them all with a character-set scan (no regex, ~5x cheaper).
    """
    return F.btrim(_col(c), F.lit(WHITESPACE))


def clean_text(c) -> Column:
    """Lower-case, drop URLs, keep letters/whitespace/'/-, collapse spaces, strip.

    The result only contains the cleaning letters, single ASCII spaces, ``'`` and ``-``.
    """
    x = F.lower(_col(c))
    x = F.regexp_replace(x, _URL, "")
    x = F.regexp_replace(x, _NOT_KEPT, " ")
    x = F.regexp_replace(x, _SPACES, " ")
    # after the collapse every whitespace run is one ASCII space
    return F.btrim(x, F.lit(" "))


def normalised(form: str):
    """A function of Arrow batches of texts to their Unicode normal form, for `pandas_udf`."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")
    return run


def compose_accents(c) -> Column:
    """Letters followed by combining marks as one letter where Unicode has one (form NFC); null stays null.

    The cleaner keeps accented letters but no marks, so a text in decomposed form loses its accents and is cut at
    them unless it is composed first.  Only texts that hold a mark go to Python, in Arrow batches.
    """
    text = _col(c)
    compose = F.pandas_udf(normalised("NFC"), "string")
    return F.coalesce(compose(F.when(text.rlike(r"\p{M}"), text)), text)


#: the cleaner's letters that are a plain letter with an accent, and those plain letters
_ACCENTED = "".join(ch for ch in CLEAN_LETTERS if len(unicodedata.normalize("NFD", ch)) == 2)
_PLAIN = "".join(unicodedata.normalize("NFD", ch)[0] for ch in _ACCENTED)


def fold_accents(clean) -> Column:
    """A cleaned text without its accents (ligatures stay)."""
    return F.translate(_col(clean), _ACCENTED, _PLAIN)


def words(clean) -> Column:
    """Whitespace tokens of a cleaned text (``clean`` has single ASCII spaces)."""
    return F.split(_col(clean), " ")


def letter_runs(clean) -> Column:
    """Maximal letter runs of a cleaned text: split at space, ``'`` and ``-``.

    On cleaned text this equals the set of ``\\b\\w+\\b`` matches, so word-bounded
    lexicon matching becomes an array membership test (no regex per row).
    Empty strings appear between adjacent separators; callers filter them.
    """
    return F.split(F.translate(_col(clean), "'-", "  "), " ")


def is_content_term(term, stopwords: Iterable[str] = DEFAULT_STOPWORDS, min_len: int = 3) -> Column:
    """Row predicate on an exploded token (generated code; no per-element lambda)."""
    t = _col(term)
    return (F.length(t) >= min_len) & ~t.isin(list(stopwords))


def truncate(c, n: int | None) -> Column:
    """The first ``n`` characters; all of them without ``n``."""
    return _col(c) if n is None else F.substring(_col(c), 1, n)


# ---------------------------------------------------------------------------
# message-list parsers
# ---------------------------------------------------------------------------

def parse_list_split(c) -> Column:
    """Parse a list rendered as text by bracket stripping and splitting at ", ".

    Strip whitespace, strip ``[`` / ``]`` chars at both ends, strip whitespace,
    split at the literal ", ", strip whitespace / quotes / whitespace from each
    item and drop empty items.  A message containing ", " is cut in two, and
    ``"x","y"`` (no space) stays one item — both are intended.  Every step is
    linear in the text: character-set trims, no pattern that could backtrack.
    """
    inner = strip_ws(F.btrim(strip_ws(_col(c)), F.lit("[]")))
    items = F.transform(F.split(inner, ", ", -1), lambda x: strip_ws(F.btrim(strip_ws(x), F.lit("'\""))))
    return F.array_remove(items, "")


_JSON_OPTS = {
    "allowSingleQuotes": "true",
    "allowBackslashEscapingAnyCharacter": "true",
    "allowUnquotedControlChars": "true",
}


def _whole_list(raw: Column) -> Column:
    """array<string> if the whole text is one JSON (or single-quoted) list, else null.

    ``from_json`` stops at the end of the first value, so the text is read inside an object that goes on after it:
    a text that closes the list early leaves out the key that follows, or adds one.  That key is the text's own
    digest, which no text can contain.
    """
    key = F.md5(raw)
    wrapped = F.concat(F.lit('{"a":['), raw, F.lit('],"'), key, F.lit('":[["z"]]}'))
    read = F.from_json(wrapped, "map<string,array<array<string>>>", _JSON_OPTS)
    lists = F.element_at(read, F.lit("a"))
    whole = (F.map_keys(read) == F.array(F.lit("a"), key)) & (F.size(lists) == 1)
    return F.when(whole, F.get(lists, F.lit(0)))


def parse_list_json(c) -> Column:
    """Parse a list rendered as JSON or as a Python literal.

    A text that is one list from its first to its last character is read as such (single quotes and backslash
    escapes allowed); any other bracketed text loses its brackets and is split at quote-comma-quote, so nothing
    that follows a first list is lost; a text that is not bracketed becomes a one-element list; null becomes [].
    """
    raw = strip_ws(_col(c))
    parsed = _whole_list(raw)
    bracketed = raw.startswith("[") & raw.endswith("]")
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    pieces = F.split(inner, r"""['"],\s*['"]""", -1)
    pieces = F.transform(pieces, lambda s: F.btrim(strip_ws(s), F.lit("'\"")))
    fallback = F.filter(pieces, lambda s: F.length(s) > 0)
    return (
        F.when(_col(c).isNull(), F.array().cast("array<string>"))
        .when(bracketed & parsed.isNotNull(), parsed)
        .when(bracketed, fallback)
        .otherwise(F.array(raw))
    )


def parse_plain_text(c) -> Column:
    """A plain text column is one message."""
    return F.when(_col(c).isNotNull(), F.array(_col(c)))


PARSERS = {"split": parse_list_split, "json": parse_list_json, "text": parse_plain_text}
