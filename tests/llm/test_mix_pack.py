"""Source mixing and packing: contract properties, the packed ids against the tokenizer."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import by, docs, frame, no_docs, rows, rows_of  # noqa: F401
from pyspark.sql import functions as F

from cxpulse.llm import mixing, packing


# ---------------------------------------------------------------- mixing
def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > cap * sizes[s]]
        if not over:
            return {**fixed, **{s: w[s] * level for s in free}}
        for s in over:
            fixed[s] = cap * sizes[s]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 0}, {"é": 10, "z": 20, "Z": 30, "": 40},
    {f"s{i}": (i * 37) % 91 for i in range(40)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)


def test_newton_finds_the_tilt(spark):
    cases = [(1000, 3000.0), (10 ** 9, 1.0), (7, 7.0), (5, 1e-3), (10 ** 12, 2.5e12), (10, 0.0), (0, 0.0)]
    df = spark.createDataFrame(cases, "s long, t double").select("s", "t", mixing.tilt(F.col("s"), F.col("t")).alias("x"))
    for r in df.collect():
        if r.s and r.t:
            assert r.x == pytest.approx(math.log(r.t / r.s), abs=1e-9)
        else:
            assert r.x is None


def check_mix(rows, got):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    targets = plain_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], words(r[1])) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    ids = {(r[0], words(r[1])): r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        source = ids[(r.doc_id, r.size)]
        taken[source] += r.taken
        assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source], abs=1e-6)
    return targets, taken


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(int(rng.expovariate(1 / 200)) + 1)), "en", f"src{min(i % 9, 5)}", 0) for i in range(4000)]
    rows += [(9000 + i, "a b c", "en", None, 0) for i in range(300)] + [(9999, "w " * 20_000, "en", "src1", 0)]
    got = mixing.mixed_sizes(frame(spark, rows)).collect()
    targets, taken = check_mix(rows, got)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(5, 0.002 * t), (s, t, taken[s])
    again = mixing.mixed_sizes(frame(spark, rows, 3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    docs = mixing.mixed_documents(frame(spark, rows))
    copies = Counter({(r.doc_id, r.size): r.taken // r.size for r in got})
    assert Counter((r.doc_id, words(r.text)) for r in docs.collect()) == +copies


def test_mix_on_the_odd_corpus(spark, rows, docs, no_docs):
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.mixed_sizes(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_sizes(docs.where("text is null")).count() == 2


def whole_mix(spark, rows):
    """words missed by source, after checking that no document not taken fits into them"""
    got = mixing.mix(frame(spark, rows)).collect()
    missed = {}
    for source, units in by(got, lambda r: r.source).items():
        size, target = units[0].source_size, units[0].target
        whole = math.floor(target / size + 1e-9) if size else 0
        gap = max(0, math.floor(target - whole * size + 0.5)) - sum((r.copies - whole) * r.size * r.repeats for r in units)
        assert gap >= 0 and not any(0 < r.size * r.repeats <= gap for r in units if r.copies == whole)
        missed[source] = gap
    return missed


def test_mix_fills_what_a_long_document_leaves(spark):
    # source b at rate 0.5: wherever the long text's hash lies, it is the one that no longer fits
    rows = [(i, "a " * 1000, "en", "a", 0) for i in range(60)] + [(100, "b " * 40_000, "en", "b", 0)]
    rows += [(1000 + i, "b " * 10, "en", "b", 0) for i in range(4000)]
    assert whole_mix(spark, rows)["b"] < 10


def test_mix_repeats_the_cut_over_what_fits(spark):
    rng = random.Random(3)
    rows = [(i, "w " * int(1.6 ** rng.uniform(4, 22)), "en", "abc"[i % 3], 0) for i in range(700)]
    rows += [(1000 + i, "w " * 3, "en", None, 0) for i in range(40)] * 2
    whole_mix(spark, rows)


# ---------------------------------------------------------------- packing
@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("text", [
    "", " ", "  a  b ", "it's we'll I'M 'd've", "naïve café — “quotes” …", "x²½Ⅷ٣", "tab\tnew\n\n line \r\n ", "<|endoftext|> and <|x|>",
    "日本語 текст", "a" * 5000, "\x00\x01\x1c\x85\xa0z", "1234567890 12 3.5e-7", "×÷ßÿÀ", "\n" * 50 + "x"])
def test_memoised_ids_equal_the_tokenizer(tokenizer, text):
    assert packing.encoder()(text) == tokenizer.encode(text, add_special_tokens=False) and False or \
        packing.encoder()(text) == ids_of(tokenizer, text)[:-1].tobytes()


def check_pieces(rows, pieces, tokenizer, window):
    """Every id of every document in one piece, sequences gapless and within the window; returns padded tokens."""
    want = Counter()
    cache = {}
    for r in rows:
        key = (r[0], r[1] or "")
        cache.setdefault(key, ids_of(tokenizer, r[1]))
        want[(r[0], cache[key].tobytes())] += 1
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc_id, group in by_doc.items():
        texts = [np.frombuffer(b, "<u4") for (i, b), n in want.items() if i == doc_id for _ in range(n)]
        assert sum(p.length for p in group) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for p in sorted(group, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(texts[0])
                assert p.ids_crc32 == zlib.crc32(texts[0][at:at + p.length].tobytes())
                at += p.length
    assert {r[0] for r in rows} == set(by_doc)
    fills = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fills[p.sequence_id]
        fills[p.sequence_id] += p.length
    assert max(fills.values()) <= window and sorted(fills) == list(range(len(fills)))
    return sum(window - f for f in fills.values() if f & (f - 1))


def test_packing(spark, rows, docs, no_docs, tokenizer):
    pieces = packing.pack(docs).collect()
    assert check_pieces(rows, pieces, tokenizer, 1024) == 0
    assert packing.pack(no_docs).count() == 0
    one = packing.pack(docs.where("text is null")).collect()
    assert [(p.start, p.length, p.doc_tokens) for p in one] == [(0, 1, 1)] * 2


def test_packing_with_a_small_window(spark, tokenizer):
    rng = random.Random(1)
    rows = [(i, " ".join("ab" for _ in range(rng.randint(0, 70))), "en", "s", 0) for i in range(500)]
    rows += [(1000 + i, "same text of one length", "en", "s", 0) for i in range(400)]
    pieces = packing.pack(frame(spark, rows, 7), window=32).collect()
    assert check_pieces(rows, pieces, tokenizer, 32) == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_remainder(seed):
    rng, window = np.random.default_rng(seed), 64
    hist = np.bincount(rng.integers(1, window, rng.integers(0, 3000)), minlength=window) if seed else np.zeros(window, int)
    hist[37] += 500 * (seed % 2)
    slots, residuals, sequences, tail = packing.plan_remainders(hist, window)
    used = np.zeros(window, int)
    fill = Counter()
    for rem, lo, hi, sequence, offset in slots:
        assert lo == used[rem]
        used[rem] = hi + 1
        for k in range(hi - lo + 1):
            fill[sequence + k] += rem
    assert (used <= hist).all() and all(f == window for f in fill.values()) and len(fill) == sequences
    left = sum((hist[r] - used[r]) * r for r in range(window))
    assert left == tail["position"] + tail["fill"]
    assert sum((int(hist[r]) - first) << j for r, first, j, _, _ in residuals) == left
    if seed in (2, 4):
        assert used.sum() >= 0.8 * hist.sum()  # most documents stay whole


def test_window_must_be_a_power_of_two(docs):
    with pytest.raises(ValueError):
        packing.pack(docs, window=1000)


def test_the_cut_by_size_is_limited_on_the_map_side(spark):
    from cxpulse.llm.mixing import _largest_first

    # Spark's own default threshold: nothing but the plan itself may bring the limit
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    try:
        units = spark.createDataFrame([(1, "a", 5, 3, 3, 7)], "doc_id long, source string, priority long, size long, mass long, want long")
        assert "WindowGroupLimit" in _largest_first(units)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
