"""Cuckoo-filter exact dedup and line chunks against brute force."""

import random
import tempfile
from collections import Counter

import pytest
from helpers import by, docs, frame, no_docs, rows, rows_of, sha  # noqa: F401
from pyspark.sql import functions as F

from cxpulse.llm import linechunks
from cxpulse.llm.cuckoo import CuckooFilter, CuckooIndex, Shard, digest_udf, drop_copies, exact_dedup


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def expected(rows):
    groups = by(rows, lambda r: plain(r[1]))
    best = {k: min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0] for k, g in groups.items()}
    return Counter((r[0], sha(plain(r[1]).encode()), best[plain(r[1])], len(groups[plain(r[1])]), r[0] == best[plain(r[1])])
                   for r in rows)


def test_exact_dedup(spark, rows, docs, no_docs):
    got = exact_dedup(docs).select("doc_id", F.lower(F.hex("digest")), "keep_id", "group_size", "kept")
    assert rows_of(got) == expected(rows)
    assert exact_dedup(no_docs).count() == 0
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(plain(r.text) for r in kept.collect()) == Counter({plain(r[1]) for r in rows})
    best = {k[2] for k in expected(rows)}
    assert {r.doc_id for r in kept.collect()} == best


def test_whole_rows_that_repeat(spark):
    df = frame(spark, [(1, "a b", "en", "s", 3)] * 4 + [(2, "ab", "en", "s", 2), (1, "c", "en", "s", 1)])
    assert sorted((r.doc_id, r.text) for r in drop_copies(df).collect()) == [(1, "a b"), (1, "c")]
    assert {(r.keep_id, r.group_size) for r in exact_dedup(df).where("doc_id = 2").collect()} == {(1, 5)}


def test_hot_group(spark):
    rows = [(i, "the same text" + " " * (i % 5), "en", "s", 0) for i in range(3000)] + [(i, f"t{i}", "en", "s", 0) for i in range(3000, 4000)]
    assert rows_of(exact_dedup(frame(spark, rows, 17)).select("doc_id", F.lower(F.hex("digest")), "keep_id", "group_size", "kept")) == expected(rows)


def test_cuckoo_filter_resizes_from_stored_keys():
    rng = random.Random(5)
    keys = [rng.randbytes(32) for _ in range(5000)]
    shard = Shard()
    assert all(shard.insert(k) for k in keys) and not any(shard.insert(k) for k in keys[:100])
    assert shard.filter.log2 > 8 and all(shard.filter.contains(k) for k in keys)
    assert all(shard.delete(k) for k in keys[:2000]) and not shard.delete(keys[0])
    assert not any(shard.hit(k) for k in keys[:2000]) and all(shard.hit(k) for k in keys[2000:])
    assert all(shard.insert(k) for k in keys[:2000])
    full = CuckooFilter(0)
    assert [full.insert(rng.randbytes(32)) for _ in range(6)].count(False) >= 2


def test_false_hits_are_verified():
    a = bytes(32)
    b = a[:31] + b"\x01"  # the same tag and buckets
    shard = Shard()
    assert shard.insert(a) and shard.filter.contains(b) and not shard.hit(b) and shard.insert(b)


def test_index_insert_contains_delete(spark):
    texts = spark.createDataFrame([(f"text {i}",) for i in range(300)], "text string")
    digests = texts.select(digest_udf("text").alias("digest"))
    index = CuckooIndex(spark, "file://" + tempfile.mkdtemp(prefix="cxpulse-cuckoo-"), n_shards=4)
    assert index.contains(digests).count() == 0
    first = digests.limit(200)
    assert index.insert(first.unionByName(first)).count() == 200 and index.insert(first).count() == 0
    assert index.contains(digests).count() == 200
    assert index.delete(first.limit(50)).count() == 50 and index.delete(first.limit(50)).count() == 0
    assert index.contains(digests).count() == 150
    assert index.insert(digests).count() == 150 and index.contains(digests).count() == 300
    assert index.insert(digests.limit(0)).count() == 0


def line_expected(rows):
    cut = [[(f, n, "\n".join((r[1] or "").split("\n")[f:f + n])) for f, n in linechunks.chunks(r[1] or "")] for r in rows]
    places = by([((r[0] is None, r[0] or 0, f), c) for r, x in zip(rows, cut) for f, n, c in x if n > 1], lambda p: p[1])
    out = Counter()
    for r, x in zip(rows, cut):
        gone = tuple((f, n) for f, n, c in x if n > 1 and len(places[c]) > 1
                     and (r[0] is None, r[0] or 0, f) != min(p for p, _ in places[c]))
        out[(r[0], (r[1] or "").count("\n") + 1, len(x), gone)] += 1
    return out


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    shared = [rng.choice(pool) for _ in range(12)]
    rows = []
    for i in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 15))]
        if i % 3 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = shared
        rows.append((i, "\n".join(lines), "en", "s", 0))
    return rows + [(200, None, None, None, None), (201, "", "en", "s", 0), (None, rows[0][1], "en", "s", 0),
                   (202, "line\n" * 20_000, "en", "s", 0)] + rows[:2]


def test_line_chunks(spark, lined, no_docs):
    df = frame(spark, lined)
    got = Counter((r.doc_id, r.n_lines, r.n_chunks, tuple((x.line, x.lines) for x in r.removed))
                  for r in linechunks.line_dedup(df).collect())
    want = line_expected(lined)
    assert got == want and sum(len(k[3]) for k in want) > 20
    assert linechunks.line_dedup(no_docs).count() == 0


def test_chunks_fall_back_into_step(lined):
    rng = random.Random(2)
    lines = [f"line {rng.random()}" for _ in range(400)]
    ends = lambda ls: {ls[f + n - 1] for f, n in linechunks.chunks("\n".join(ls))}
    moved = lines[:50] + ["new"] + lines[50:]
    assert len(ends(lines) ^ ends(moved)) <= 4


def test_texts_without_removed_chunks(spark, lined):
    df = frame(spark, lined)
    plan = {(r.doc_id, r.n_lines): r.removed for r in linechunks.line_dedup(df).collect()}
    out = linechunks.drop_repeated_chunks(df)
    assert out.columns == df.columns and out.count() == len(lined)
    for r in out.where("doc_id between 0 and 119").collect():
        lines = lined[r.doc_id][1].split("\n")
        for x in reversed(plan[(r.doc_id, len(lines))]):
            del lines[x.line:x.line + x.lines]
        assert r.text == "\n".join(lines)
