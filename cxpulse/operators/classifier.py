"""A fitted text classifier for the model pass, and rates corrected by what it is known to get wrong.

The model is a logistic regression over hashed words, neighbouring words and
word stems of whole texts (Spark ML; ``2^BITS`` weights, the only thing the
driver holds).  It is fitted on at most ``FIT_ROWS`` labelled rows of each
label (the first in hash order); a fifth of the labelled rows, by the hash of
their id, never takes part in the fit and gives the confusion matrix.  A share
counted with the model's labels is corrected by it (Rogan and Gladen), with a
bound for both samples' errors.  Everything runs on the JVM side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, letter_runs
from ..session import drop_scratch, scratch_path
from .sampling import DEFAULT_SEED, exact_sample

BITS = 16
FIT_ROWS = 20_000
FOLDS = 5
STEM = 5  # letters of a word's stem
#: probability of the positive label from which a text has so many stars (1: most negative)
STARS = ((0.75, 1), (0.5, 2), (0.35, 3), (0.2, 4))


def held_out(doc_id) -> Column:
    """True for the fifth of all ids that no fit sees."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def with_ngrams(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the distinct words, pairs of neighbouring words and stems of a cleaned text, whole."""
    held = df.select("*", F.explode(F.array(F.array_remove(letter_runs(text), ""))).alias("_words"))
    n = F.greatest(F.size("_words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_words", F.lit(1), n), F.slice("_words", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    stems = F.transform("_words", lambda w: F.concat(F.substring(w, 1, STEM), F.lit("-")))
    return held.withColumn(out, F.concat("_words", pairs, stems)).drop("_words")


@dataclass(frozen=True)
class TextModel:
    """Labels texts like a scorer: a drop-in for the scorer factories of ``refine``."""

    pipeline: PipelineModel

    def probability(self, df: DataFrame, text: str = "clean", out: str = "probability") -> DataFrame:
        """Adds the probability of the positive (negative-sentiment) label; a text without words has the model's own prior."""
        scored = self.pipeline.transform(with_ngrams(df, text, "_grams"))
        return scored.withColumn(out, vector_to_array("_probability")[1]).drop("_grams", "_features", "_raw", "_probability", "_label")

    def label(self, df: DataFrame, text: str = "clean", out: str = "model_label") -> DataFrame:
        """Adds labels like "2 stars": one and two stars are probabilities of a half and more."""
        df = self.probability(df, text, "_p")
        stars = F.lit(5)
        for least, n in reversed(STARS):
            stars = F.when(F.col("_p") >= least, F.lit(n)).otherwise(stars)
        return df.withColumn(out, F.concat(stars.cast("string"), F.when(stars == 1, F.lit(" star")).otherwise(F.lit(" stars")))).drop("_p")


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic") -> DataFrame:
    """(id, clean, label, held_out) of the rows that have a label of 0 or 1; of several labels of an id the larger holds."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), clean_text(F.coalesce(F.col(text_col), F.lit(""))).alias("clean"))
    return rows.join(known, "id").select("id", "clean", "label", held_out("id").alias("held_out"))


def _without_summary(fitted: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The same model without its training summary, which saving leaves out.

    The summary refers to the session, and every scoring task carries the model: once anything in the session has
    used an ``Observation``, the session and so the model cannot be serialised.
    """
    path = scratch_path(spark, "text-model")
    fitted.write().save(path)
    loaded = PipelineModel.load(path)
    drop_scratch(spark, [path])
    return loaded


def fit_text_model(rows: DataFrame, fit_rows: int = FIT_ROWS, regularisation: float = 1e-4, seed: int = DEFAULT_SEED) -> TextModel | None:
    """Fit on rows (id, clean, label, held_out) that are not held out; None unless both labels occur among them."""
    train = exact_sample(rows.where(~F.col("held_out")).select("id", "clean", "label"), {0: fit_rows, 1: fit_rows}, ["id"],
                         segment_col="label", seed=seed).select("clean", "label")
    if train.select("label").distinct().count() < 2:
        return None
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=1 << BITS, binary=True)
    regression = LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw",
                                    predictionCol="_label", regParam=regularisation, maxIter=60, standardization=False)
    return TextModel(_without_summary(Pipeline(stages=[hashing, regression]).fit(with_ngrams(train, "clean", "_grams")), rows.sparkSession))


@dataclass(frozen=True)
class Confusion:
    """What the model's label was on labelled rows that it was not fitted on."""

    true_positive: int
    false_negative: int
    true_negative: int
    false_positive: int

    @property
    def sensitivity(self) -> float:
        return self.true_positive / max(self.true_positive + self.false_negative, 1)

    @property
    def specificity(self) -> float:
        return self.true_negative / max(self.true_negative + self.false_positive, 1)

    def corrected(self, positives: int, n: int) -> tuple[float, float]:
        """(share, bound): ``positives`` of ``n`` texts corrected, and 1.96 standard errors of it (at most 1).

        A model no better than chance says nothing: the share as counted, bound 1.  No texts: 0 and 0.
        """
        if not n:
            return 0.0, 0.0
        share, sens, spec = positives / n, self.sensitivity, self.specificity
        gain = sens + spec - 1
        if gain <= 0:
            return share, 1.0
        rate = min(max((share + spec - 1) / gain, 0.0), 1.0)
        error = lambda p, m: (p * (1 - p) + 0.25 / max(m, 1)) / max(m, 1)  # noqa: E731 - not 0 where all rows agree
        variance = error(share, n) + rate ** 2 * error(sens, self.true_positive + self.false_negative) + (
            1 - rate) ** 2 * error(spec, self.true_negative + self.false_positive)
        return rate, min(1.96 * math.sqrt(variance) / gain, 1.0)


def confusion(model: TextModel, rows: DataFrame) -> Confusion:
    """Of rows (clean, label), in one aggregation."""
    positive, label = F.col("p") >= 0.5, F.col("label") == 1
    r = model.probability(rows.select("clean", "label"), "clean", "p").agg(
        F.count_if(label & positive), F.count_if(label & ~positive), F.count_if(~label & ~positive), F.count_if(~label & positive)).first()
    return Confusion(*map(int, r))
