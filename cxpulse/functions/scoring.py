"""Lexicon negativity score as native column expressions.

score = (unigram hits + bigram hits) / max(#whitespace tokens, 1), capped at 1.

* unigrams are word-bounded: on cleaned text a word-bounded match of a
  letter-only word is exactly an element of ``letter_runs(clean)``, so the count
  is an array filter with a hash-set membership test — no regex per row;
* bigrams are plain substrings (no boundary), counted per phrase as
  ``(len(text) - len(replace(text, phrase, ''))) / len(phrase)``;
* a lexicon whose phrases can overlap in a text (or whose words hold a
  separator) is counted by one alternation instead, leftmost and
  non-overlapping; which way applies depends on the lexicon alone.
* a word and a bigram containing it both count.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import DEFAULT_LEXICON, Lexicon
from .text import _col, letter_runs, words


def _alternation(items) -> str:
    return "(" + "|".join(re.escape(x) for x in items) + ")"


def can_overlap(phrases) -> bool:
    """Whether occurrences of two phrases (or of one with itself) can share characters in some text."""
    ps = list(dict.fromkeys(phrases))
    for a in ps:
        for b in ps:
            if a != b and a in b:
                return True
            if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                return True
    return False


def unigram_hits(clean, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    if not lexicon.words:
        return F.lit(0)
    if all(re.fullmatch(r"[^\s'-]+", w) for w in lexicon.words):
        simple = list(lexicon.words)
        return F.size(F.filter(letter_runs(clean), lambda t: t.isin(simple)))
    return F.regexp_count(_col(clean), F.lit(r"(?U)\b" + _alternation(lexicon.words) + r"\b"))


def bigram_hits(clean, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    c = _col(clean)
    if can_overlap(lexicon.bigrams):
        return F.regexp_count(c, F.lit(_alternation(lexicon.bigrams)))
    # replace() removes whole occurrences, so the byte-length difference is an
    # exact multiple of the phrase's byte length (octet_length is O(1))
    total = F.lit(0)
    for b in lexicon.bigrams:
        removed = F.octet_length(c) - F.octet_length(F.replace(c, F.lit(b), F.lit("")))
        total = total + F.floor(removed / F.lit(len(b.encode("utf-8"))))
    return total.cast("int")


def token_count(clean) -> Column:
    return F.size(words(clean))


def neg_score(clean, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    c = _col(clean)
    hits = (unigram_hits(c, lexicon) + bigram_hits(c, lexicon)).cast("double")
    ratio = hits / F.greatest(token_count(c), F.lit(1)).cast("double")
    # least() skips nulls, so guard the null text explicitly
    return F.when(c.isNotNull(), F.least(ratio, F.lit(1.0)))


def stars_to_score(label) -> Column:
    """Model label ("1 star" .. "5 stars") -> negativity 1 - (stars - 1) / 4; no leading digit -> 3 stars."""
    lab = _col(label)
    stars = F.when(lab.rlike("^[0-9]"), F.split(lab, " ").getItem(0).cast("int")).otherwise(F.lit(3))
    return F.lit(1.0) - (stars - F.lit(1)).cast("double") / F.lit(4.0)
