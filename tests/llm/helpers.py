"""Brute-force versions and small fixtures."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names the operators use themselves
CLASH = "row string, fp string, digest string, score double, spans string, __id string, gram string, source_size int"


def corpus(n=60, seed=1):
    """Texts with exact and near copies, shared passages, empty, null and long ones, repeated rows and null ids."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(70)
    rows = []
    for i in range(n):
        t = text(rng.randint(1, 160))
        if i % 5 == 0:
            t = text(20) + "\n" + passage + "\n" + text(30)
        if i % 7 == 0 and rows:
            t = rng.choice(rows)[1] or ""
        if i % 11 == 0 and rows:
            t = " " + (rng.choice(rows)[1] or "").replace(" ", "  ") + "\t"
        rows.append((i, t, "en", f"src{i % 4}", len(t)))
    rows += [(n, "", "en", "src0", 0), (n + 1, None, None, None, None), (n + 2, " \t\n", "en", None, 3),
             (None, "null id text one two three", None, "src1", 26), (None, None, None, None, None),
             (n + 3, text(30_000), "en", "src2", 0), (n + 4, "x" * 50_000, "en", "src2", 0)]
    return rows + rows[3:6] + rows[-1:]  # whole rows again


def frame(spark, rows, partitions=5):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def with_clashes(spark, df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in CLASH.split(", "))])


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    from cxpulse.llm.common import setup

    setup(spark)
    return with_clashes(spark, frame(spark, rows)).cache()


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.limit(0)
