"""Cleaning, scoring and parsing expressions on hand-checked cases."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cxpulse.functions.lexicon import DEFAULT_LEXICON, Lexicon
from cxpulse.functions.scoring import bigram_hits, can_overlap, neg_score, token_count, unigram_hits
from cxpulse.functions.text import clean_text, parse_list_json, parse_list_split
from cxpulse.sources.fixtures import ALL_TEMPLATES, python_list_repr

# (messages, unigram hits, bigram hits, tokens, score, negative, clean prefix) for the 20 templates
GOLDEN = [
    (3, 0, 0, 12, 0.0, False, "bonjour je souhaite modifier mon offre"),
    (3, 0, 0, 12, 0.0, False, "quand sera traitée ma demande"),
    (3, 0, 0, 12, 0.0, False, "je veux des informations sur mon contrat"),
    (3, 0, 0, 8, 0.0, False, "pouvez-vous me rappeler"),
    (3, 0, 0, 12, 0.0, False, "j'aimerais changer mon mot de passe"),
    (2, 0, 0, 12, 0.0, False, "comment accéder à mon espace client"),
    (3, 0, 0, 10, 0.0, False, "je voudrais un conseiller"),
    (3, 3, 1, 16, 0.25, True, "c'est scandaleux personne ne me répond"),
    (3, 2, 1, 10, 0.3, True, "ça fait trois semaines que j'attends"),
    (3, 2, 0, 11, 0.1818, True, "service incompétent je vais résilier"),
    (3, 1, 0, 16, 0.0625, False, "panne depuis ce matin rien ne fonctionne"),
    (3, 2, 0, 15, 0.1333, False, "bug sur l'application impossible"),
    (2, 1, 0, 12, 0.0833, False, "je suis très déçu de votre service"),
    (2, 1, 0, 10, 0.1, False, "arnaque pure et simple remboursez-moi"),
    (2, 2, 0, 10, 0.2, True, "votre service est lamentable"),
    (3, 1, 1, 15, 0.1333, False, "je vais aller chez le concurrent"),
    (2, 2, 0, 10, 0.2, True, "surfacturation sur ma dernière facture"),
    (3, 0, 0, 18, 0.0, False, "problème avec la nouvelle mise à jour fibre"),
    (3, 2, 0, 12, 0.1667, True, "depuis la migration fibre plus rien ne marche"),
    (3, 2, 0, 8, 0.25, True, "migration fibre catastrophique"),
]


@pytest.fixture(scope="module")
def templates(spark):
    rows = [(i, list(t)) for i, t in enumerate(ALL_TEMPLATES)]
    df = spark.createDataFrame(rows, "idx int, msgs array<string>")
    df = df.withColumn("clean", clean_text(F.array_join("msgs", ". ")))
    return df.select(
        "idx", F.size("msgs").alias("n"), "clean",
        unigram_hits("clean").alias("u"), bigram_hits("clean").alias("b"),
        token_count("clean").alias("w"), neg_score("clean").alias("s"),
    ).orderBy("idx").collect()


def test_golden_templates(templates):
    assert len(templates) == 20
    for row, (n, u, b, w, score, negative, prefix) in zip(templates, GOLDEN):
        assert (row.n, row.u, row.b, row.w) == (n, u, b, w), row
        assert round(row.s, 4) == score
        assert (row.s > DEFAULT_LEXICON.threshold) == negative
        assert row.clean.startswith(prefix)


def score_by_definition(clean, lexicon):
    """Word-bounded words plus phrases, each counted leftmost and non-overlapping, over the number of tokens."""
    import re

    count = lambda items, edge: len(re.findall(edge + "(?:" + "|".join(map(re.escape, items)) + ")" + edge, clean)) if items else 0
    hits = count(lexicon.words, r"\b") + count(lexicon.bigrams, "")
    return min(1.0, hits / max(1, len(clean.split())))


def test_score_equals_its_definition(templates):
    for row in templates:
        assert row.s == pytest.approx(score_by_definition(row.clean, DEFAULT_LEXICON))


def test_overlapping_phrases_count_once(spark):
    lex = Lexicon(words=(), bigrams=("marche pas", "pas bien"), threshold=0.1)
    assert can_overlap(lex.bigrams) and not can_overlap(("a b", "c d"))
    df = spark.createDataFrame([("ca marche pas bien",), ("pas bien",)], "clean string")
    assert [r.s for r in df.select(neg_score("clean", lex).alias("s")).collect()] == [0.25, 0.5]
    hyphen = Lexicon(words=("rendez-vous", "vous"), bigrams=(), threshold=0.1)
    got = spark.createDataFrame([("rendez-vous chez vous",)], "clean string").select(neg_score("clean", hyphen).alias("s"))
    assert got.first().s == pytest.approx(score_by_definition("rendez-vous chez vous", hyphen))
    empty = Lexicon(words=(), bigrams=(), threshold=0.1)
    assert df.select(neg_score("clean", empty).alias("s")).first().s == 0.0


def _one(spark, expr_fn, value, schema="x string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr_fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,expected", [
    ("voir http://x.fr panne 12,5€ j’ai", "voir panne j ai"),
    ("été", "e te"),
    ("  Déjà   VU!!  ", "déjà vu"),
    ("l'appli-mobile", "l'appli-mobile"),
    ("123 456", ""),
])
def test_cleaning_cases(spark, text, expected):
    assert _one(spark, clean_text, text) == expected


def test_word_bounds_and_bigram_substrings(spark):
    # "démarche passe" contains "marche pas" as a substring: bigrams need no boundary
    assert _one(spark, bigram_hits, "démarche passe") == 1
    # unigrams are word-bounded: "bugs" is not "bug", "l'application" has "application"
    assert _one(spark, unigram_hits, "bugs bug nul-nulle") == 3
    # a word and the bigram containing it both count
    assert _one(spark, lambda c: unigram_hits(c) + bigram_hits(c), "porter plainte") == 2
    # cap at 1.0
    assert _one(spark, neg_score, "nul nul") == 1.0
    lex = Lexicon(words=("idiot",), bigrams=(), threshold=0.15)
    assert _one(spark, lambda c: neg_score(c, lex), "you idiot") == 0.5


def test_score_null_text(spark):
    assert _one(spark, neg_score, None) is None


@pytest.mark.parametrize("text,split_expected,json_expected", [
    ("['a, b', \"d'accord\", 'c']", ["a", "b", "d'accord", "c"], ["a, b", "d'accord", "c"]),
    ('["x","y"]', ['x","y'], ["x", "y"]),
    ("plain", ["plain"], ["plain"]),
    ("[]", [], []),
    ("", [], [""]),
    (None, None, []),
    ("  [ 'a' ,  'b' ]  ", ["a", "b"], ["a", "b"]),
])
def test_parser_cases(spark, text, split_expected, json_expected):
    assert _one(spark, parse_list_split, text) == split_expected
    assert _one(spark, parse_list_json, text) == json_expected


def test_json_parser_fallback_for_python_only_literals(spark):
    # `None` is not JSON even with relaxed quoting: the quote-comma-quote split
    # finds no separator, so the whole inner text is one (quote-trimmed) item
    assert _one(spark, parse_list_json, "[1, None, 'k']") == ["1, None, 'k"]
    assert _one(spark, parse_list_json, "['a' 'b', 'c']") == ["a' 'b", "c"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc")), max_size=12), max_size=5))
def test_json_round_trip(spark, items):
    df = spark.createDataFrame([(items,)], "x array<string>")
    got = df.select(parse_list_json(F.to_json("x")).alias("y")).first().y
    assert got == items


@pytest.mark.parametrize("text, expected", [
    ('["a"], ["b"]', ['a"], ["b']),
    ("['a'] ['b']", ["a'] ['b"]),
    ("['a', 'b'] x [c]", ["a", "b'] x [c"]),
    ('["a"]],"q":[["b"]', ['a"]],"q":[["b']),
    ('["a"]]} {"b":[["c"]', ['a"]]} {"b":[["c']),
])
def test_json_parser_keeps_what_follows_a_first_list(spark, text, expected):
    got = _one(spark, parse_list_json, text)
    assert got == expected


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abc é,", min_size=1, max_size=6), min_size=1, max_size=3),
       st.text(alphabet="xyz [,", min_size=1, max_size=6))
def test_trailing_content_is_never_lost(spark, items, tail):
    import json

    raw = json.dumps(items, ensure_ascii=False) + tail + "]"
    got = "".join(_one(spark, parse_list_json, raw))
    letters = lambda s: sorted(c for c in s if c.isalpha())
    assert letters(got) == letters("".join(items) + tail)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abc é'\"\\\n", min_size=1, max_size=8), max_size=4))
def test_python_repr_matches_python(spark, items):
    df = spark.createDataFrame([(items,)], "x array<string>")
    assert df.select(python_list_repr("x").alias("y")).first().y == str(items)


def _split_parser_reference(text):
    """The split parser's documented steps, written out in Python."""
    from cxpulse.functions.text import WHITESPACE

    if text is None:
        return None
    inner = text.strip(WHITESPACE).strip("[]").strip(WHITESPACE)
    items = [i.strip(WHITESPACE).strip("'\"").strip(WHITESPACE) for i in inner.split(", ")]
    return [i for i in items if i]


def test_split_parser_matches_its_definition(spark):
    import random

    rng = random.Random(7)
    alphabet = " ,'\"[]ab\n\t\u00a0\u3000"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(5000)]
    texts += ["['a, b', \"d'accord\", 'c']", "[ ' x ' ,  ' y ' ]", "' ', ''", "[, , ]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", parse_list_split("x").alias("y")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _split_parser_reference(t), t


def test_long_texts_take_linear_time(spark):
    import time

    from cxpulse.operators.topics import with_topic_grams

    blanks = spark.createDataFrame([("['a" + " " * 100_000 + "b', 'c']",)], "x string")
    words = spark.createDataFrame([(" ".join(f"mot{i % 977}x" for i in range(20_000)),)], "clean string")
    plans = [blanks.select(F.size(parse_list_split("x")).alias("n")),
             with_topic_grams(words).select(F.size("grams").alias("n"))]
    for plan, n in zip(plans, (2, 39_999)):
        plan.collect()  # compile
        began = time.time()
        assert plan.first().n == n
        assert time.time() - began < 4


def test_broken_lists_of_all_turns(spark, tmp_path):
    from cxpulse.plans.catalog import QUERIES

    texts = ["plain", "", None, "it's", 'say "x"', "a\nb\tc", "back\\slash", "[x], ['y', 'z']", "', '", '", "', "\x01", "ends\\", "]['"]
    rows = [(i, t, x) for i, x in enumerate(texts) for t in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = set()
    for i, turn, x in rows:  # no such text is one list: its brackets go, it is cut at quote-comma-quote
        one = json.dumps([x or ""], ensure_ascii=False)
        raw = f"{one}, {one}" if turn == 0 else f"['{x or ''}' x 'b']"
        parts = [y for p in re.split(r"""['"],[ \t\n]*['"]""", raw[1:-1]) if (y := p.strip(" \t\n").strip("'\""))]
        want.add((i, turn, len(parts), " | ".join(parts)))
    got = {tuple(r) for r in QUERIES["parse_json_broken_all"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 2 * len(texts)


def test_terms_of_one_document_are_counted(spark, tmp_path):
    from cxpulse.plans.catalog import QUERIES

    rows = [("a", "shared alone"), ("a", "shared shared"), ("b", "alone")]
    spark.createDataFrame(rows, "source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["document_all_term_counts"](spark, str(tmp_path)).collect()}
    assert got == {("a", "shared", 2), ("a", "alone", 1), ("b", "alone", 1)}
