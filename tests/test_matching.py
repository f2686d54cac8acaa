"""Term lists against texts: the automaton's hits equal a regular expression's."""

import random
import re

import pytest

from cxpulse.functions.text import clean_text
from cxpulse.operators.matching import matcher, phrases, term_document_counts, term_hits
from pyspark.sql import functions as F

TEXTS = ["l'application plante", "nouvelle application", "applications partout", "qu'est-ce que c'est", "a-b-c a b c", "", None,
         "- '", "aaa aa a", "a'tis", "'tis", "x" * 50_000 + " fin", "nouvelle application"]
TERMS = ["application", "nouvelle application", "est-ce", "b-c", "b c", "a", "aa", "c'est", "'tis", "l'", "fin", "absent", "fin",
         "", None, "-", " ", "plante "]


def brute(text, term):
    return bool(term and re.search(r"[^ '-]", term) and text and re.search(r"\b" + re.escape(term) + r"\b", text))


@pytest.mark.parametrize("block", [200_000, 3, 1])
def test_hits_equal_a_regular_expression(spark, block):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, clean string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    got = sorted(map(tuple, term_hits(rows, terms, "clean", block=block).collect()))
    assert got == sorted((i, t) for i, x in enumerate(TEXTS) for t in {t for t in TERMS if brute(x, t)})
    counts = {r.term: (r.n_docs, r.first_id) for r in term_document_counts(rows, terms, "id", "clean", block=block).collect()}
    assert counts["nouvelle application"] == (2, 1) and "absent" not in counts and "" not in counts


def test_nothing_to_find_and_nowhere_to_look(spark):
    rows = spark.createDataFrame([(1, "a b")], "id long, clean string")
    terms = spark.createDataFrame([("a",)], "term string")
    assert term_hits(rows, terms.limit(0), "clean").columns == ["id", "term"]
    assert term_hits(rows, terms.limit(0), "clean").count() == 0 == term_hits(rows.limit(0), terms, "clean").count()
    clash = rows.withColumn("term", F.lit(7))
    assert term_hits(clash, terms, "clean", keep=["id"], name="found").collect() == [(1, "a")]


def test_random_texts_and_terms():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("ab é'-") for _ in range(rng.randint(0, 30)))
        terms = sorted({"".join(rng.choice("ab é'-") for _ in range(rng.randint(1, 5))) for _ in range(20)})
        terms = [t for t in terms if t.strip(" '-")]
        assert matcher(terms)(text) == [t for t in terms if brute(text, t)]


def test_a_hundred_thousand_terms(spark):
    from conftest import SF0001

    docs = spark.read.parquet(SF0001 + "/documents.parquet").select("doc_id", clean_text("text").alias("clean"))
    texts = {r.doc_id: r.clean for r in docs.collect()}
    rng = random.Random(2)
    words = sorted({w for t in texts.values() for w in t.split(" ")} - {""})
    terms = {rng.choice(words) + rng.choice([" ", "-", "'", ""]) + rng.choice(words) for _ in range(100_000)} | set(words[:3000])
    terms = {t for t in terms if re.fullmatch(r"[^ '-](.*[^ '-])?", t)}
    parts = {i: re.findall(r"[^ '-]+|[ '-]", t) for i, t in texts.items()}
    sizes = {len(re.findall(r"[^ '-]+|[ '-]", t)) for t in terms}
    want = {(i, t) for i, p in parts.items() for k in sizes for t in {"".join(p[a:a + k]) for a in range(len(p) - k + 1)} & terms}
    frame = spark.createDataFrame([(t,) for t in sorted(terms)], "term string")
    assert {tuple(r) for r in term_hits(docs, frame, "clean").collect()} == want and len(want) > 1000


def test_phrases(spark):
    rows = spark.createDataFrame([("a b-c d",), ("a",), ("",), (None,), ("'x y'",)], "clean string")
    assert sorted(r.term for r in phrases(rows, "clean").collect()) == ["a", "a b-c", "b-c", "b-c d", "d"]
