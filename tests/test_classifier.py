"""The fitted text model, its held-out errors and the corrected rates."""

import random
import zlib

import pytest
from conftest import SF0001, SF001
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cxpulse.operators.classifier import Confusion, confusion, fit_text_model, held_out, labelled_texts
from cxpulse.operators.refine import label_sample, recovery_stats
from cxpulse.plans.catalog import QUERIES

WORDS = ["colis", "client", "service", "merci", "livraison", "date", "compte", "bonjour", "facture", "prix"]


def made(n, seed, share=0.3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = int(rng.random() < share)
        words = [rng.choice(WORDS) for _ in range(rng.randint(3, 25))]
        if label and rng.random() < 0.8:  # a fifth of the negative ones look like the others
            words.insert(rng.randrange(len(words)), rng.choice(["nul", "honteux", "arnaque"]))
        rows.append((i, " ".join(words), label, zlib.crc32(str(i).encode()) % 5 == 0))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.createDataFrame(made(1500, 1), "id long, clean string, label int, held_out boolean").cache()
    return fit_text_model(rows), rows


def test_model_scores_in_a_session_that_has_observed(spark):
    rows = spark.createDataFrame(made(300, 2), "id long, clean string, label int, held_out boolean")
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 300}
    model = fit_text_model(rows)
    held = rows.where("held_out")
    assert sum(vars(confusion(model, held)).values()) == held.count() == len(model.label(held).collect())


def test_document_queries_after_one_that_observes(spark):
    assert QUERIES["prepared_row_counts"](spark, SF0001).count() == 1
    assert QUERIES["document_recovery"](spark, SF001).count() == 1


def test_document_recovery_of_made_rows_after_an_observation(spark, tmp_path):
    rng = random.Random(5)
    docs, unsure, toxic = [], set(), {}
    for i in range(900):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 40))]
        toxic[i] = int(rng.random() < 0.4)
        if toxic[i]:
            words.insert(rng.randrange(len(words)), "honteux")
        if rng.random() < 0.5:  # one insult of 6 to 42 words: in the grey band
            words.insert(rng.randrange(len(words)), "stupid")
            unsure.add(i)
        docs.append((i, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "idiot idiot")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in toxic.items() if i % 3], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    out = QUERIES["document_recovery"](spark, str(tmp_path)).collect()
    stars = {r["doc_id"]: r["model_label"] for r in QUERIES["document_model_labels"](spark, str(tmp_path)).collect()}
    negative = {i for i in unsure if stars[i][0] in "12"}
    held = [i for i in unsure if i % 3 and zlib.crc32(str(i).encode()) % 5 == 0]
    caught, known = sum(toxic[i] for i in held if i in negative), sum(toxic[i] for i in held)
    passed, clean = sum(1 for i in held if not toxic[i] and i not in negative), len(held) - known
    assert len(stars) == len(docs) and known and clean and len(out) == 1
    assert (out[0]["n_ambiguous"], out[0]["n_recovered"], out[0]["recovery_rate"]) == (len(unsure), len(negative), len(negative) / len(unsure))
    assert (out[0]["sensitivity"], out[0]["specificity"]) == (caught / known, passed / clean)
    assert caught / known > 0.9 and passed / clean > 0.9
    assert abs(out[0]["corrected_rate"] - sum(toxic[i] for i in unsure) / len(unsure)) <= out[0]["error_bound"] < 0.25


def test_held_out_by_id(spark):
    ids = [0, 1, 7, 123456789, -5, None]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", held_out("i").alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}


def test_confusion_counts_equal_the_labels(spark, fitted):
    model, rows = fitted
    held = rows.where("held_out")
    stars = model.label(held).collect()
    want = {(a, b): sum(1 for r in stars if (r["label"] == 1, r["model_label"][0] in "12") == (a, b)) for a in (True, False) for b in (True, False)}
    c = confusion(model, held)
    assert (c.true_positive, c.false_negative, c.true_negative, c.false_positive) == (
        want[True, True], want[True, False], want[False, False], want[False, True])
    assert c.sensitivity > 0.6 and c.specificity > 0.95


@pytest.mark.parametrize("share", [0.05, 0.3, 0.7])
def test_corrected_rate_is_within_its_bound(spark, fitted, share):
    model, rows = fitted
    errors = confusion(model, rows.where("held_out"))
    fresh = made(2000, 99, share)
    df = spark.createDataFrame(fresh, "id long, clean string, label int, held_out boolean")
    positives = label_sample(df, model).where("model_negative").count()
    rate, bound = errors.corrected(positives, len(fresh))
    truth = sum(r[2] for r in fresh) / len(fresh)
    assert abs(rate - truth) <= bound < 0.25
    assert abs(positives / len(fresh) - truth) > abs(rate - truth) or share < 0.1


def test_corrections_that_say_nothing():
    assert Confusion(1, 1, 1, 1).corrected(3, 10) == (0.3, 1.0)
    assert Confusion(0, 0, 0, 0).corrected(3, 10) == (0.3, 1.0)
    assert Confusion(9, 1, 9, 1).corrected(0, 0) == (0.0, 0.0)
    rate, bound = Confusion(90, 10, 95, 5).corrected(0, 100)
    assert rate == 0.0 and 0 < bound < 0.2


def test_odd_texts_and_tables(spark, fitted):
    model, rows = fitted
    odd = spark.createDataFrame([("",), (" ",), ("x " * 50_000,), ("nul",), ("nul",)], "clean string")
    got = [r["model_label"] for r in model.label(odd).orderBy("clean").collect()]
    assert len(got) == 5 and all(g[0] in "12345" for g in got)
    assert model.label(odd.limit(0)).count() == 0
    assert fit_text_model(rows.where("label = 0")) is None and fit_text_model(rows.limit(0)) is None
    scored = odd.select(F.lit(None).cast("date").alias("date"), F.monotonically_increasing_id().cast("string").alias("conversation_id"),
                        "clean", F.lit(0.2).alias("neg_score"))
    assert recovery_stats(scored, model).first()["n_sampled"] == 5


def test_labels_of_the_documents_table(spark):
    from cxpulse.sources.inputs import table

    rows = labelled_texts(table(spark, SF001, "documents"), table(spark, SF001, "labels"))
    known = {r["doc_id"]: r["toxic"] for r in table(spark, SF001, "labels").collect() if r["toxic"] in (0, 1)}
    assert {r["id"]: r["label"] for r in rows.collect()} == known
    out = QUERIES["document_recovery"](spark, SF001).collect()
    assert len(out) == 1 and 0 <= out[0]["corrected_rate"] <= 1 and out[0]["error_bound"] > 0
    assert QUERIES["document_model_labels"](spark, SF001).count() == table(spark, SF001, "documents").count()
