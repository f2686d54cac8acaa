"""The pattern grammar and its fit."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from helpers import docs, frame, no_docs, rows  # noqa: F401

from cxpulse.llm import toxicity
from cxpulse.llm.toxicity import Model, fit, held_out, keep_clean, logistic, matches, score_documents, training_rows

STEMS = {"idiot$": 1.0, "scum$": 0.5}
NOT, SAID, LOOSE = toxicity.NEGATED, toxicity.REPORTED_SPEECH, toxicity.UNAIMED


@pytest.mark.parametrize("clause, want", [
    ("you are an idiot", [("idiot$", 1.0)]),
    ("idiot , that is you", [("idiot$", 1.0)]),
    ("what an idiot", [("idiot$", LOOSE)]),
    ("you are not an idiot", [("idiot$", NOT)]),
    ("nobody should ever be called an idiot", [("idiot$", NOT * SAID * LOOSE)]),
    ("she said the idiot left", [("idiot$", SAID)]),
    ('the word "idiot" is old , idiot', [("idiot$", SAID * LOOSE), ("idiot$", LOOSE)]),
    ("never call people scum , idiot", [("scum$", NOT * LOOSE), ("idiot$", LOOSE)]),
    ("not nice but an idiot", [("idiot$", LOOSE)]),
    ("i will kill you", [("", 1.0)]),
    ("je vais te tuer", [("", 1.0)]),
    ("i will never hurt you", [("", NOT)]),
    ("i will never hurt anyone", []),
    ("they kill time", []),
    ("idiotic ideas", []),
])
def test_composed_transducers(clause, want):
    got = matches(clause, STEMS)
    assert [s for s, _ in got] == [s for s, _ in want] and [w for _, w in got] == pytest.approx([w for _, w in want])


def test_the_product_machine_is_complete():
    states = {s for s, _ in toxicity.ARCS}
    assert states == set(range(len(states))) and len(toxicity.ARCS) == len(states) * len(toxicity.SYMBOLS)
    assert all(0 <= a <= 1 and 0 <= b <= 1 and to in states for to, a, b in toxicity.ARCS.values())


def test_scores_follow_the_context():
    model = Model(STEMS)
    score = {t: model.score(t) for t in ("You are an idiot.", "What an idiot.", "He said: what an idiot.", "You are not an idiot.",
                                         "A nice day.", "", "I will kill you.")}
    assert score["You are an idiot."] > score["What an idiot."] > score["He said: what an idiot."] > score["You are not an idiot."]
    assert score["What an idiot."] > 0.5 and score["I will kill you."] > 0.5 > score["He said: what an idiot."]
    assert score["A nice day."] == score[""] == model.score(None) < 0.05
    assert all(0 <= s <= 1 for s in score.values())
    assert model.score("fine. " * 50_000 + "you idiot") > 0.5
    assert model.score("idiot " * 50_000) <= 1


def plain_score(model, text):
    """The grammar as flags that are set and cleared word by word, over every clause of the text."""
    text = (text or "").lower()
    weights = []
    for clause in re.split(r"[.!?;\n]", text):
        words = re.findall(r"[^\W\d_]+|[\"“”«»„,]", clause)
        aimed = any(w in toxicity.TARGETS for w in words)
        negated = reporting = quoted = intent = False
        object_, verb, total = False, False, 0.0
        for w in words:
            kept = (NOT if negated else 1) * (SAID if reporting or quoted else 1) * (1 if aimed else LOOSE)
            known = [s for s in (w + "$", *(w[:n] for n in range(8, 2, -1) if len(w) >= n)) if s in model.stems]
            if w in toxicity.QUOTES:
                if reporting or quoted:
                    reporting, quoted = False, reporting
                else:
                    quoted = True
            elif w in toxicity.CONTRASTS:
                negated = False
            elif w in toxicity.NEGATORS:
                negated = True
            elif w in toxicity.REPORTERS:
                reporting = reporting or not quoted
            elif w in toxicity.TARGETS:
                if verb:
                    total, intent, verb, object_ = total + kept, False, False, False
                elif intent:
                    object_ = True
            elif w in toxicity.INTENTS:
                intent = True
            elif known:
                total += model.stems[known[0]] * kept
            elif w in toxicity.THREATS:
                if object_:
                    total, intent, verb, object_ = total + kept, False, False, False
                elif intent:
                    verb = True
        weights.append(total)
    sums = (min(1.0, max(weights)), math.log1p(sum(weights)), math.log1p(100 * sum(weights) / (len(text) / 6 + 10)))
    return 1 / (1 + math.exp(-max(-12, min(12, model.bias + sum(a * b for a, b in zip(model.slopes, sums))))))


def test_scores_equal_a_plain_version():
    rng = random.Random(11)
    model = Model({**STEMS, "krim": 0.3, "krimpel": 0.9}, -3.0, (1.0, 2.0, 0.5))
    pool = ["idiot", "scum", "idiotic", "krimson", "krimpelig", "kill", "hurt", "tuer", "you", "they", "te", "will", "vais", "not", "nie",
            "said", "wrote", "but", ",", '"', "«", "»", ".", ";", "\n", "a", "house", "Idiot", "x9idiot", "", "é"]
    for size in [0, 1, 2, 5, 12, 40] * 120:
        text = rng.choice([" ", "", ", "]).join(rng.choice(pool) for _ in range(size))
        assert model.score(text) == pytest.approx(plain_score(model, text), abs=1e-12), text
    assert model.score(None) == pytest.approx(plain_score(model, None))


def test_logistic_slopes_are_never_negative():
    x = np.array([[0, 0, 0], [1, 1, 0], [1, 1, 1], [2, 2, 0], [0, 0, 1], [3, 3, 1]], float)
    bias, slopes = logistic(np.repeat(x, 20, axis=0), np.repeat([0, 1, 0, 1, 0, 1], 20).astype(float))
    assert bias < 0 and min(slopes) >= 0 and slopes[0] > 0 and slopes[2] == 0


def corpus(n=700, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    insults = ["zorglub", "krimpel", "vandoz"]
    rows, labels = [], []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                ws.insert(rng.randrange(len(ws)), rng.choice(insults) + rng.choice(["", "en", "ique"]))
        rows.append((i, " ".join(ws).capitalize() + ".", "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_fit_and_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = frame(spark, rows + [(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "x", "en", "s", 0)])
    marks = spark.createDataFrame(labels + [(9001, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit(docs, marks)
    assert {s[:4] for s in model.stems} == {"zorg", "krim", "vand"}
    truth = {i: t for i, _, t in labels}
    got = score_documents(docs, model).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    out = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) > 100 and sum(r.predicted == truth[r.doc_id] for r in out) >= 0.98 * len(out)
    clean = keep_clean(docs, model)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect() if r.doc_id is not None} >= {i for i, t in truth.items() if not t}


def test_training_rows_leave_the_held_out_fifth_alone(spark):
    rows, labels = corpus(200)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    used = {r.text for r in training_rows(docs, marks).collect()}
    for r in rows:
        assert (r[1] in used) == (zlib.crc32(str(r[0]).encode()) % 5 != 0)
    assert training_rows(docs, marks, fit_rows=7).count() == 14
    flags = {r[0]: r[1] for r in docs.select("doc_id", held_out(docs["doc_id"])).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in flags)


def test_without_labels_the_priors_stand(spark, rows, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit(docs, none)
    assert model.stems == {} and score_documents(docs, model).count() == len(rows)
    assert score_documents(no_docs, model).count() == 0
    assert fit(no_docs, none).stems == {}


def test_decision_list_prefers_what_is_not_yet_explained():
    rows = [(1, [0, 1]), (1, [0, 1]), (1, [0]), (1, [0, 2]), (1, [2]), (1, [2]), (1, [2]), (0, [3]), (0, [3]), (1, [3])]
    names = ["aaaa", "bbbb", "cccc", "dddd"]
    assert sorted(toxicity.decision_list(rows, 8, 200, names)) == [0, 2]


def test_decision_list_counts_a_word_once_however_many_of_its_starts_are_known():
    rows = [(1, [0, 1, 2])] * 30 + [(1, [3])] * 30
    names = ["zorg", "zorglub", "zorglub$", "moron$"]
    assert sorted(toxicity.decision_list(rows, 60, 600, names, depth=3)) == [2, 3]


def test_decision_list_prefers_whole_words():
    rows = [(1, [0, 1, 2])] * 30 + [(0, [0])]
    assert toxicity.decision_list(rows, 60, 600, ["path", "pathet", "pathetic$"]) == [2]
