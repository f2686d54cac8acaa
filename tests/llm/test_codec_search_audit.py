"""BPE codec, ranked search and filter audit against brute force and the tokenizers library."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cxpulse.llm.bpe import PairTree, codec, encode_documents, tokenizer_path
from cxpulse.llm.interaction import interaction_audit
from cxpulse.llm.search import search

from helpers import corpus, docs, frame, no_docs, rows, rows_of, with_clashes  # noqa: F401

ODD = ["I've DON'T 'tis 'LL we'd", "ÀÉÎß œuvre Ÿ ž", "étude café Å",
       "ΟΔΟΣ ΣΑΣ", "İstanbul ı", "日本語 テスト 한국어",
       "\U0001f642\U0001f469‍\U0001f469‍\U0001f467 ok", "a b c\x85d\x1ce\x0b\x0c", "x\x00y\x01\x7f", "tab\tnew\nline\r\n",
       "12 345 ½ Ⅷ ٣", "<|endoftext|>", "a<|endoftext|>b", "<|startoftext|>Hi<|endoftext|> <|endoftext|>",
       "<|endoftext", "×÷ ¼ ª º µ", "...!!! --- ??", "", " ", "ǅ ﬁ ſ", "﻿bom",
       "http://a.b/c?d=e&f", "l'été d'où", "''''s's", "ẞtraße", "नमस्ते", "مرحبا"]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k"))
    t.no_truncation()
    t.no_padding()
    return t


def test_codec_equals_the_library_on_odd_texts():
    t, c = library(), codec()
    rng = random.Random(5)
    alphabet = "".join(ODD) + "abcdefghij 'stdm"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        ids = t.encode(text, add_special_tokens=False).ids
        got = c.encode(text)
        assert got.tolist() == ids, text
        assert c.decode(got) == t.decode(ids, skip_special_tokens=False), text


def test_codec_long_words_are_n_log_n():
    rng = random.Random(2)
    t, c = library(), codec()
    for text in ("x" * 50_000, "".join(rng.choice("etaoinshr") for _ in range(50_000)), "=-" * 20_000):
        assert c.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_pair_tree_is_the_leftmost_lowest_merge():
    rng = random.Random(3)
    merges, products = {}, []
    for _ in range(30):  # symbols 0..5, merged ones 6..35
        pair = (rng.randrange(6 + len(products)), rng.randrange(6 + len(products)))
        if pair not in merges:
            merges[pair] = len(products)
            products.append(6 + len(products))
    for _ in range(300):
        word = [rng.randrange(6) for _ in range(rng.randint(2, 40))]
        want = list(word)
        while True:
            found = [(merges[p], i) for i, p in enumerate(zip(want, want[1:])) if p in merges]
            if not found:
                break
            rank, i = min(found)
            want[i:i + 2] = [products[rank]]
        assert PairTree(list(word), merges, products).run() == want


def test_documents_equal_the_library(docs, rows, no_docs):
    t = library()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[doc_id, tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in encode_documents(docs).collect())
    assert got == want
    assert encode_documents(no_docs).count() == 0


# ranked search

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_search(rows, items, top):
    docs = [(d, Counter(SPLIT.findall((t or "").translate(LOWER)))) for d, t, *_ in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    if not docs:
        return Counter()
    n_docs, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(SPLIT.findall((text or "").translate(LOWER)))
    out = Counter()
    for item, terms in wanted.items():
        scored = []
        for d, c, n in docs:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out[item, rank, d, -s] += 1
    return out


def items_of(rows):
    rng = random.Random(9)
    texts = [t for _, t, *_ in rows if t and len(t) > 60]
    items = [(i, " ".join(rng.choice(texts).upper().split()[:rng.randint(1, 30)])) for i in range(12)]
    return items + [(12, None), (13, ""), (14, "zzzzunknown"), (None, texts[0][:80]), items[0], (0, texts[1][:40])]


@pytest.mark.parametrize("top,shard", [(50, 3_000_000), (3, 500), (1, 3_000_000)])
def test_search_equals_brute_force(spark, docs, rows, top, shard):
    items = items_of(rows)
    table = with_clashes(spark, spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(search(docs, table, top=top, shard=shard)) == brute_search(rows, items, top)


def test_search_ties_and_hot_copies(spark):
    rows = [(i, "same words here again", None, None, None) for i in range(300)] + [(i + 300, "same other", None, None, None) for i in range(40)]
    items = [(1, "same words"), (2, "other here")]
    got = search(frame(spark, rows, 7), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == brute_search(rows, items, 50)


def test_search_blocks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr("cxpulse.llm.search.BLOCK", 40)
    items = items_of(rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(search(docs, table, top=5)) == brute_search(rows, items, 5)


def test_search_stops_early_and_stays_exact():
    import numpy as np

    from cxpulse.llm.search import ImpactLists

    rng = np.random.default_rng(4)
    n, n_terms = 4000, 6
    docs = np.concatenate([np.sort(rng.choice(n, rng.integers(500, n), replace=False)) for _ in range(n_terms)])
    sizes_of = [len(x) for x in np.split(docs, np.flatnonzero(np.diff(docs) < 0) + 1)]
    terms = np.repeat(np.arange(n_terms), sizes_of)
    counts = rng.zipf(1.6, len(docs)).clip(1, 10_000)
    sizes = rng.integers(1, 3000, n)
    lists = ImpactLists(np.arange(n), np.ones(n, bool), sizes, docs, terms, counts, n_terms, n, int(sizes.sum()))
    m = 50 + (50 * sizes * n) // int(sizes.sum())
    weights = [3, 50, 700, 1, 0, 90]
    whole = np.zeros(n, np.int64)
    for d, t, c in zip(docs, terms, counts):
        whole[d] += weights[t] * ((10 ** 9 * int(c)) // (1000 * int(c) + 20 * int(m[d])))
    order = np.lexsort((np.arange(n), -whole))[:10]
    looked = []
    look_up = lists.look_up
    lists.look_up = lambda term, d: (looked.append(len(d)), look_up(term, d))[1]
    got, scores = lists.best(list(range(n_terms)), weights, 10)
    assert got.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
    assert sum(looked) < 5 * n * 0.7  # five lists of weight above 0


def test_search_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert search(no_docs, items).count() == 0
    assert search(docs, items.limit(0)).count() == 0


# filter audit

def brute_audit(rows, labels):
    known = {}
    for d, quality, toxic in labels:
        if d is None:
            continue
        g, t = known.get(d, (0, 0))
        known[d] = (max(g, int(quality == 1)), max(t, int(toxic == 1)))
    first = {}
    for d, text, *_ in rows:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    parts = defaultdict(list)
    for d, text, _, source, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]}
        parts[source or ""].append((fails, *known.get(d, (0, 0))))
    out = Counter()
    for part, docs in parts.items():
        rows_here, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            for step in range(1, 6):
                f, before = order[step - 1], order[:step - 1]
                alive = [x for x in docs if not any(x[0][b] for b in before)]
                gone = [x for x in alive if x[0][f]]
                shapley[f] += len(gone)
                rows_here.append((part, "".join(order), step, len(alive) - len(gone), len(gone),
                                  sum(x[0][f] for x in docs) - len(gone),
                                  sum(x[0][f] and sum(x[0].values()) == 1 for x in docs),
                                  sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        for *r, f in rows_here:
            out[(*r, shapley[f])] += 1
    return out


def audit_rows():
    rng = random.Random(8)
    rows = corpus(40)
    for i in range(60):
        words = [rng.choice(["one", "Two", "THREE", "four#", "five", "six", "a|b"]) if rng.random() < 0.4 else f"w{rng.randrange(300)}"
                 for _ in range(rng.choice([5, 49, 50, 51, 80]))]
        rows.append((200 + i, " ".join(words), "en", rng.choice(["src0", "hot", "", None]), 0))
    text = rows[-1][1]
    return rows + [(400 + i, text, "en", "hot", 0) for i in range(150)] + [(400, text, "en", "src1", 0), (None, text, "en", "hot", 0)]


def test_audit_equals_brute_force(spark):
    rows = audit_rows()
    rng = random.Random(1)
    ids = [r[0] for r in rows if r[0] is not None]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in rng.sample(sorted(set(ids)), 120)]
    labels += labels[:5] + [(labels[0][0], 1, 1), (None, 1, 1), (99_999, 1, 1)]
    table = with_clashes(spark, frame(spark, rows)).withColumn("mask", F.lit(1)).withColumn("part", F.lit("x")).withColumn("n", F.lit(2))
    got = rows_of(interaction_audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute_audit(rows, labels)


def test_audit_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction_audit(no_docs, none).count() == 0
    got = interaction_audit(docs, none)
    assert got.where("good_lost > 0 or toxic_lost > 0").count() == 0 and got.count() == 600 * 5
