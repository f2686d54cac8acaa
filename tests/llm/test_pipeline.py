"""Queries against SQL, the pipeline against its stages' brute force, and the guard of the entry module."""

import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import ROOT, SF0001
from helpers import Groups, frame

import corpus_pipeline
from cxpulse.llm.queries import ORACLES, QUERIES
from cxpulse.llm.simhash import fingerprint
from cxpulse.llm.toxicity import fit


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF0001)
    cols = sorted(got.columns)
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    want = Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert Counter(tuple(norm(r[c]) for c in cols) for r in got.collect()) == want


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").limit(200)
    labels = spark.read.parquet(f"{SF0001}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mix sources", "pack"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    extra = [(10 ** 6 + i, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(docs.limit(9).collect())]
    docs = docs.unionByName(frame(spark, extra + [(2 * 10 ** 6, None, None, None, None)])).cache()

    clean = stages[0](spark, docs, SF0001)
    model = fit(docs, labels)
    before = docs.collect()
    assert Counter(clean.collect()) == Counter(r for r in before if model.score(r.text) < 0.5)

    unique = stages[1](spark, clean, SF0001)
    groups = defaultdict(list)
    for r in clean.collect():
        groups["".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r")].append(r)
    assert Counter(unique.collect()) == Counter(min(g, key=lambda r: (-len(r.text or ""), r.doc_id)) for g in groups.values())

    near = stages[2](spark, unique, SF0001)
    rows = unique.collect()
    fps = [fingerprint((r.text or "").encode()) for r in rows]
    g = Groups()
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                g.join(a, b)
    first = {}
    for r, f in sorted(zip(rows, fps), key=lambda x: x[0].doc_id):
        first.setdefault(g.find(f), r)
    assert Counter(near.collect()) == Counter(first.values())

    mixed = stages[3](spark, near, SF0001)
    assert mixed.columns == docs.columns
    copies = Counter(mixed.collect())
    assert set(copies) <= set(near.collect()) and max(copies.values()) <= 3
    packed = stages[4](spark, mixed, SF0001)
    tokens = {r.doc_id: r.doc_tokens for r in packed.collect()}
    assert set(tokens) == {r.doc_id for r in copies}
    assert sum(r.length for r in packed.collect()) == sum(n * tokens[r.doc_id] for r, n in copies.items())


def test_pipeline_runs_on_a_folder(spark):
    out = corpus_pipeline.run(spark, SF0001)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_entry_works_without_the_subpackage():
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("cxpulse.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert "daily_spikes" in q and not [n for n in q if n.startswith("op") or n == "pipeline"], sorted(q)
assert set(e.oracle_sql()) <= set(q)
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=120)


def test_held_out_is_the_crc_rule(spark):
    got = QUERIES["op2_toxicity_grammar"](spark, SF0001).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
