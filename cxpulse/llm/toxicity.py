"""Toxicity by a weighted finite-state pattern grammar.

Five small weighted transducers read the classes of a clause's words: insults,
threats, targets, negation and reported speech.  `compose` multiplies them into
one machine whose arcs carry the weight of what they complete: an insult counts
its stem's weight, a threat (intent, verb and target, in either order) counts
one, and an arc under negation or inside reported speech has almost all of that
multiplied away.  "You are not an idiot" and 'they wrote "idiot"' therefore
score next to nothing whatever the word.  A text is scored by its matched
clauses: the heaviest, their sum, and their sum against the text's length.

The function words and the factors of the grammar are fixed; what counts as an
insult is learned from labels: stems (word starts, or whole words of any length)
whose document frequencies differ by label are found by one aggregation, a
decision list keeps those that explain toxic documents the ones before it do
not, and a logistic model of the three clause sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_of

#: labelled rows of each class the grammar is fitted on at most (by hash order; all of them where there are fewer)
FIT_ROWS = 20_000
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)  # of word starts; whole words have any length
SPECIFIC = 0.95  # share of a stem's gain for which a longer one replaces it

# fixed word classes (en, fr, de, es)
TARGETS = frozenset("you your yours yourself ya u he she him her they them his their tu te toi vous votre ton il elle "
                    "ils elles du dich dir ihr euch dein sie er usted ustedes ti vosotros él ella ellos".split())
NEGATORS = frozenset("not never no nobody none neither nor without isn aren wasn weren don doesn didn hardly pas jamais aucun "
                     "personne sans nicht kein keine keinen nie niemals niemand ohne nunca jamás tampoco nadie ningún sin".split())
CONTRASTS = frozenset("but mais aber sondern pero sino".split()) | {","}
REPORTERS = frozenset("said says say saying told called calls quoted wrote writes reported claimed claims alleged "
                      "dit disait écrit appelé sagte sagt schrieb nannte dijo dice escribió llamó".split())
INTENTS = frozenset("will gonna ll shall must going vais va werde wird voy vamos".split())
THREATS = frozenset("kill hurt destroy murder beat stab shoot burn tuer frapper détruire töten umbringen schlagen "
                    "matar golpear destruir".split())
QUOTES = frozenset("\"“”«»„")
_BREAK = re.compile(r"[.!?;\n]")
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»„,]")

# what stays of a match under negation, inside reported speech, and without anyone it is aimed at
NEGATED, REPORTED_SPEECH, UNAIMED = 0.02, 0.05, 0.8
#: I insult, T threat verb, M intent, V target, N negator, B contrast, R reporting verb, Q quotation mark, O other
SYMBOLS = "ITMVNBRQO"


@dataclass(frozen=True)
class Transducer:
    """States 0..n-1 from 0.  ``step``: (state, symbol) -> (state, weight of the arc); missing arcs stay and weigh ``rest``."""

    states: int
    step: dict
    rest: tuple  # weight of an unnamed arc by state

    def __call__(self, state: int, symbol: str) -> tuple[int, float]:
        return self.step.get((state, symbol), (state, self.rest[state]))


INSULT = Transducer(1, {(0, "I"): (0, 1.0)}, (0.0,))
#: intent, then a verb and a target in either order; the arc that brings the second of them completes the threat
THREAT = Transducer(4, {(0, "M"): (1, 0.0), (1, "T"): (2, 0.0), (1, "V"): (3, 0.0), (2, "V"): (0, 1.0), (3, "T"): (0, 1.0)}, (0.0,) * 4)
NEGATION = Transducer(2, {(0, "N"): (1, 1.0), (1, "B"): (0, 1.0)}, (1.0, NEGATED))
REPORTED = Transducer(3, {(0, "R"): (1, 1.0), (0, "Q"): (2, 1.0), (1, "Q"): (2, REPORTED_SPEECH), (2, "Q"): (0, 1.0)},
                      (1.0, REPORTED_SPEECH, REPORTED_SPEECH))
#: started in state 1 where a target follows anywhere in the clause
TARGET = Transducer(2, {(0, "V"): (1, 1.0)}, (UNAIMED, 1.0))


def compose() -> tuple[dict, dict]:
    """The product machine: its start by whether the clause has a target, and (state, symbol) -> (state, insult, threat)."""
    number: dict[tuple, int] = {}
    arcs: dict[tuple[int, str], tuple[int, float, float]] = {}
    todo = [(0, 0, 0, 0, 0), (0, 0, 0, 0, 1)]
    for state in todo:
        number[state] = len(number)
    for state in todo:
        for symbol in SYMBOLS:
            (i, insult), (t, threat), *scopes = (m(q, symbol) for m, q in zip(
                (INSULT, THREAT, NEGATION, REPORTED, TARGET), state))
            to = (i, t, *(q for q, _ in scopes))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            kept = math.prod(w for _, w in scopes)
            arcs[number[state], symbol] = (number[to], insult * kept, threat * kept)
    return {False: 0, True: 1}, arcs


START, ARCS = compose()


def _symbol(word: str) -> str:
    return ("Q" if word in QUOTES else "B" if word in CONTRASTS else "N" if word in NEGATORS else "R" if word in REPORTERS
            else "V" if word in TARGETS else "M" if word in INTENTS else "T" if word in THREATS else "O")


def matches(clause: str, stems) -> list[tuple[str, float]]:
    """(stem, or "" for a threat; what the grammar leaves of it) of every match in one lower-case clause.

    A target that follows counts like one that precedes ("idiot, you"): the clause is looked through for one first.
    """
    words = _TOKEN.findall(clause)
    state = START[any(w in TARGETS for w in words)]
    found = []
    for word in words:
        symbol = _symbol(word)
        stem = stem_of(word, stems) if symbol in "OT" else None
        state, insult, threat = ARCS[state, "I" if stem is not None else symbol]
        if insult:
            found.append((stem, insult))
        if threat:
            found.append(("", threat))
    return found


def stem_of(word: str, stems) -> str | None:
    if word + "$" in stems:
        return word + "$"
    for n in reversed(STEM_LENGTHS):
        if len(word) >= n and word[:n] in stems:
            return word[:n]
    return None


@lru_cache(maxsize=4)
def _scanner(stems: tuple[str, ...]):
    """lower-case text -> the clauses that hold a stem or a threat verb (whole text scanned once by one automaton)."""
    automaton = ahocorasick.Automaton()
    for s in {*(x.rstrip("$") for x in stems), *THREATS}:
        automaton.add_word(s, len(s))
    automaton.make_automaton()

    def clauses(text: str) -> Iterator[str]:
        done = 0
        for end, n in automaton.iter(text):
            at = end - n + 1
            if at < done or at and text[at - 1].isalpha():
                continue
            start = max(done, *(text.rfind(c, done, at) + 1 for c in ".!?;\n"))
            stop = _BREAK.search(text, at)
            done = stop.end() if stop else len(text)
            yield text[start:done]

    return clauses


@dataclass
class Model:
    """stems: weight of each stem (0 to 1); bias and slopes: of the logistic model of `clause_sums`."""

    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    slopes: tuple = (4.0, 1.0, 1.0)

    def clause_sums(self, text: str | None) -> tuple[float, float, float]:
        """Weight of the heaviest clause (at most 1), log of all clauses' weight, log of that by 100 words' length."""
        lower = (text or "").lower()
        best = total = 0.0
        for clause in _scanner(tuple(self.stems))(lower):
            weight = sum(kept * (self.stems[stem] if stem else 1.0) for stem, kept in matches(clause, self.stems))
            best, total = max(best, weight), total + weight
        return min(1.0, best), math.log1p(total), math.log1p(100 * total / (len(lower) / 6 + 10))

    def score(self, text: str | None) -> float:
        logit = self.bias + sum(a * b for a, b in zip(self.slopes, self.clause_sums(text)))
        return 1.0 / (1.0 + math.exp(-max(-12.0, min(12.0, logit))))


def _features(text: str) -> set[str]:
    """Whole words ("w$") and the starts that two different words of the text share."""
    words = [w for w in set(_TOKEN.findall(text.lower())) if _symbol(w) in "OT"]
    starts = Counter(w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n)
    return {w + "$" for w in words} | {s for s, n in starts.items() if n > 1}


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    small = (b.slice(at, 100) for b in batches for at in range(0, b.num_rows, 100))  # bounds the counters
    for batch in small:
        by_label = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_label[toxic].update(_features(text))
        stems = list(by_label[0].keys() | by_label[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(stems, pa.string()), *(pa.array([c[s] for s in stems], pa.int64()) for c in reversed(by_label))],
            names=["stem", "pos", "neg"])


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most ``fit_rows`` labelled documents of each label outside the held-out fifth.

    A document with contradicting labels counts as toxic; null labels are ignored.
    """
    ids = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id")
           .agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id"))))
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = ids.where("toxic = 1").orderBy(*order).limit(fit_rows).unionByName(
        ids.where("toxic = 0").orderBy(*order).limit(fit_rows))
    texts = docs.select(F.col("doc_id"), text_of("text").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("text", "toxic")  # at most 2 * fit_rows ids


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The grammar's weights from a bounded number of labelled rows (one label missing: the fixed grammar alone).

    A stem has to gain more than it costs to name one among all that were seen (the logarithm of their number).
    """
    train = training_rows(docs, labels, fit_rows).withColumn("key", F.sha2("text", 256)).dropDuplicates(["key", "toxic"])
    train = checkpointed(train.drop("key"))  # bounded, read four times; copies of a text say no more than one
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Model()
    counts = checkpointed(train.mapInArrow(_count_features, "stem string, pos long, neg long").groupBy("stem").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    cost = math.log(max(counts.count(), 2))
    share = n_pos / (n_pos + n_neg)
    both = F.col("pos") + F.col("neg")
    gain = F.col("pos") * F.log(F.col("pos") / both / share) + F.when(
        F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / both / (1 - share))).otherwise(0.0)
    able = counts.where((F.col("pos") >= 3) & (F.col("pos") * n_neg > RATIO * F.col("neg") * n_pos))
    able = able.withColumn("gain", gain).where(F.col("gain") >= cost).orderBy("stem")
    candidates = without_covered([tuple(r) for r in able.collect()])  # bounded by the fit rows
    names = [c[0] for c in candidates]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {s: i for i, s in enumerate(names)}
        for batch in batches:
            found = [sorted(number[s] for s in _features(t) & number.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "found"])

    rows = [(r["toxic"], r["found"]) for r in train.mapInArrow(find, "toxic int, found array<int>").where(
        "size(found) > 0").collect()]  # bounded by the fit rows
    chosen = decision_list(rows, n_pos, n_neg, names, cost, DEPTH)
    odds = {names[i]: math.log((candidates[i][1] + 0.5) / (n_pos + 1)) - math.log((candidates[i][2] + 0.5) / (n_neg + 1))
            for i in chosen}
    top = max(odds.values(), default=1.0)
    model = Model({s: w / top for s, w in odds.items()})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([model.clause_sums(t) for t in batch.column(0).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, i]) for i in range(3))], names=["toxic", "a", "b", "c"])

    found = np.array([tuple(r) for r in train.mapInArrow(sums, "toxic int, a double, b double, c double").collect()], float)
    found = found[np.lexsort(found.T)]  # the same sums whatever order the tasks end in
    model.bias, model.slopes = logistic(found[:, 1:], found[:, 0])
    return model


#: how much more often toxic documents hold a stem than others do, at least
RATIO = 4
#: a toxic document asks for further stems until this many of those chosen are in it
DEPTH = 3


def without_covered(candidates: list[tuple]) -> list[tuple]:
    """(stem, pos, neg, gain) rows without those whose own start is a candidate that clearly gains more."""
    gains = {c[0]: c[3] for c in candidates}

    def covered(stem: str, gain: float) -> bool:
        word = stem.rstrip("$")
        return any(SPECIFIC * gains.get(word[:n], 0.0) > gain for n in STEM_LENGTHS if len(word) >= n and word[:n] != stem)

    return [c for c in candidates if not covered(c[0], c[3])]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, tuple]:
    """Bias and slopes by Newton steps with a ridge on the slopes; none is negative, so more matches never score less."""
    use = list(range(x.shape[1]))
    while True:
        a = np.hstack([np.ones((len(x), 1)), x[:, use]])
        pull = np.diag([1e-6] + [ridge] * len(use))
        w = np.zeros(a.shape[1])
        loss = lambda v: np.logaddexp(0.0, -(2 * y - 1) * (a @ v)).sum() + 0.5 * v @ pull @ v  # noqa: E731,B023
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, a.T @ (y - p) - pull @ w)
            size = 1.0
            while size > 1e-6 and loss(w + size * step) > loss(w):
                size /= 2
            w = w + size * step
            if np.abs(size * step).max() < 1e-9:
                break
        bad = [u for u, v in zip(use, w[1:]) if v < 0]
        if not bad:
            out = np.zeros(x.shape[1])
            out[use] = w[1:]
            return float(w[0]), tuple(out.tolist())
        use = [u for u in use if u not in bad]


def decision_list(rows: list[tuple[int, list[int]]], n_pos: int, n_neg: int, names: list[str], least: float = 6.0,
                  depth: int = 1) -> list[int]:
    """Stems in order of what they add: each time the one with the largest gain (``least`` or more) over documents not yet
    explained.

    A document is explained by ``depth`` of them, of which no two may be starts of one another.  If a longer stem or a
    whole word below it explains nearly as much, that one is taken: "pathetic", not "path".
    """
    n = len(names)
    share = n_pos / (n_pos + n_neg)
    holds: list[set[int]] = [set() for _ in range(n)]
    words = [x.rstrip("$") for x in names]
    pos, neg = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, (toxic, found) in enumerate(rows):
        (pos if toxic else neg)[found] += 1
        if toxic:
            for i in found:
                holds[i].add(k)
    open_, chosen = [depth * t for t, _ in rows], []
    while n:
        both = np.maximum(pos + neg, 1)
        gain = np.where(pos > 0, pos * np.log(np.maximum(pos, 1) / both / share), 0.0)
        gain += np.where(neg > 0, neg * np.log(np.maximum(neg, 1) / both / (1 - share)), 0.0)
        gain[pos * n_neg <= RATIO * neg * n_pos] = 0.0
        i = int(np.argmax(gain))
        if gain[i] < least or pos[i] < 2:
            break
        i = max((j for j in np.flatnonzero(gain >= SPECIFIC * gain[i]).tolist() if words[j].startswith(words[i])),
                key=lambda j: (len(names[j]), gain[j]))
        chosen.append(i)
        pos[i], told, holds[i] = 0, holds[i], set()
        for j in range(n):
            if holds[j] and (words[j].startswith(words[i]) or words[i].startswith(words[j])):
                pos[j] -= sum(open_[k] > 0 for k in holds[j] & told)
                holds[j] -= told
        for k in told:
            open_[k] -= 1
            if open_[k] == 0:
                for j in rows[k][1]:
                    if k in holds[j]:
                        pos[j] -= 1
    return chosen


def score_udf(model: Model):
    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())

    return scores


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input rows with ``score`` (double, 0 to 1) and ``predicted`` (1 where the score is 0.5 or more).

    Null and empty texts hold no clause and get the score of texts without a match.  Existing columns of these two
    names are replaced.
    """
    scored = docs.withColumn("score", score_udf(model)(text_of(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input rows whose score is under 0.5."""
    return docs.where(score_udf(model)(text_of(text_col)) < 0.5)
