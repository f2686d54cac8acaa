"""Licence, secret and substring scans against plain versions."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from helpers import docs, frame, no_docs, rows, rows_of, sha  # noqa: F401

from cxpulse.llm import licences, secrets, suffix


# ---------------------------------------------------------------- licences
def dice(a, b):
    grams = lambda t: Counter(zip(w := re.findall(r"[^\W_]+", t.lower()), w[1:]))
    x, y = grams(a), grams(b)
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 0.0


def test_licence_lines(spark, docs, no_docs):
    lines = ["Licensed under CC BY-NC 4.0.", "licensed UNDER the apache license version 2.0", "All rights reserved",
             "all rights", "nothing to see", "", "Released under the MIT License. Really.", "All rights reserved. All rights reserved.",
             licences.TEMPLATES["mit"][2] + " Extra words here.", licences.TEMPLATES["mit"][2][:60]]
    rows = [(i, "\n".join(lines[i:] + lines[:i]), "en", "s", 0) for i in range(len(lines))]
    rows += [(90, None, "en", "s", 0), (91, "", "en", "s", 0), (None, lines[0], "en", "s", 0), (92, lines[0], "en", "s", 0),
             (92, lines[0], "en", "s", 0), (93, "word " * 60_000, "en", "s", 0)]
    want = Counter()
    for doc_id, text, *_ in rows:
        for n, line in enumerate((text or "").split("\n")):
            if len(line) > 1000:
                continue
            scored = sorted((-dice(line, t), name) for name, ts in licences.TEMPLATES.items() for t in ts)
            if -scored[0][0] >= licences.DICE:
                want[(doc_id, n, scored[0][1], round(-scored[0][0], 9))] += 1
    got = Counter((r.doc_id, r.line, r.licence, round(r.dice, 9)) for r in licences.licence_lines(frame(spark, rows)).collect())
    assert got == want and len(want) > 30
    assert licences.licence_lines(no_docs).count() == 0 and licences.licence_lines(docs).count() == 0


@pytest.mark.parametrize("size", [2, 5, 11, 40])
def test_size_bounds_lose_nothing(size):
    lo, hi = licences.size_bounds(size, 0.8)
    for a in range(1, 100):
        possible = 2 * min(a, size) / (a + size) >= 0.8
        assert possible == (lo <= a <= hi)


# ---------------------------------------------------------------- secrets
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(t):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_base_spans_equal_their_definition():
    rng = random.Random(4)
    bits = ["password", "PassWD", "secret", "toKen", "token", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "AKIA",
            "ABCDEF0123456789", "abcdef0123456789", "x", "é", "\n", "short", "longer.value-12345", "AKIA" * 6, "deadbeef" * 3]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert sorted(secrets.base_spans(t)) == sorted(plain_base(t)), t


@pytest.mark.parametrize("text, kind, value", [
    ('db_pwd = "Tr0ub4dor&3xZ"', "literal", "Tr0ub4dor&3xZ"),
    ("const clientSecretValue: 'q8#Lp0$zWm2!'", "literal", "q8#Lp0$zWm2!"),
    ('raw = "Zk93!kdLq0PpX"\nuser_password = raw', "constant", "Zk93!kdLq0PpX"),
    ('a = "Zk93!kd"\nb = a + "Lq0PpX#1"\nauthToken := b', "constant", "Lq0PpX#1"),
    ('{"private_key": "MIIEvQIBADANBgkqhkiG9w0"}', "literal", "MIIEvQIBADANBgkqhkiG9w0"),
])
def test_lexer_finds_sensitive_literals(text, kind, value):
    found = [(k, text[a:b]) for k, a, b, _, _ in secrets.scan(text)]
    assert (kind, value) in found


@pytest.mark.parametrize("text", [
    'title = "The quick brown fox jumps"', 'password_file = "/etc/app/settings"', 'token = "<your token>"', 'pwd = "changeme"',
    "http://example.org/path", 'secret_name = "production"', "a = b = c", 'pass = "short"', "key: value"])
def test_lexer_leaves_the_rest_alone(text):
    assert [x for x in secrets.scan(text) if x[0] in ("literal", "constant")] == []


LONG = "".join(random.Random(5).choices("ABCDEFabcdefghXYZ0189+/", k=6000))


@pytest.mark.parametrize("text, found", [
    (f'private_key = "{LONG}"', [LONG]), (f"signing_key: {LONG}", [LONG]),
    ("auth = " + " + ".join(f'"Zk{i}!kdLq0"' for i in range(40)), [f"Zk{i}!kdLq0" for i in range(40)]),
    ("private_key" + " " * 40 + "=" + " " * 40 + '"MIIEvQIBADANBgkqhkiG9w0"', ["MIIEvQIBADANBgkqhkiG9w0"]),
    ("x" * 300 + '_passphrase = "Zk93!kdLq0PpX"', ["Zk93!kdLq0PpX"]),
    (f'raw = "Zk93!kdLq0PpX"\nraw = "{LONG}"\nuser_pwd = raw', [LONG]),
    ('raw = "Zk93!kdLq0PpX"\nraw = (1)\nuser_pwd = raw', []),
    ('raw = "Zk93!kdL"\n' + "raw = raw + raw\n" * 3000 + "user_pwd = raw", ["Zk93!kdL"])])
def test_lexer_has_no_caps(text, found):
    assert [text[a:b] for _, a, b, _, _ in secrets.lexed_spans(text)] == found


@pytest.mark.parametrize("text", ["a=" * 50_000, "pwd=" * 20_000, 'x = "' * 20_000, "a " * 50_000 + "=" + " " * 90_000, "-$." * 40_000 + "="])
def test_lexer_is_linear(text):
    start = time.process_time()
    secrets.lexed_spans(text)
    assert time.process_time() - start < 20


def naive_lexed(text):
    """Literals of sensitive values by writing every value out."""
    names, found = {}, {}
    run = (0, 0)
    for m in secrets._PAIR.finditer(text):
        at, spans, constant = m.end(), [], False
        while True:
            if x := secrets._STRING.match(text, at):
                spans.append(x.span(x.lastindex))
            elif (x := secrets._REFERENCE.match(text, at)) and x[0] in names:
                spans += names[x[0]]
                constant = True
            elif not spans and run[0] <= at < run[1]:
                spans.append((at, run[1]))
                break
            elif not spans and (x := secrets._BARE.match(text, at)):
                run = x.span()
                spans.append(run)
                break
            else:
                break
            plus = secrets._PLUS.match(text, x.end())
            if not plus:
                break
            at = plus.end()
        if not spans:
            names.pop(m[2], None)
            continue
        names[m[2]] = spans
        if secrets.name_score(m[2]) < 3:
            continue
        score = secrets.name_score(m[2]) + secrets.literal_score("".join(text[a:b] for a, b in spans))
        if score >= secrets.THRESHOLD:
            for s in spans:
                if s[1] > s[0] and (s not in found or found[s][2] < score):
                    found[s] = ("constant" if constant else "literal", m[2], score)
    return {(k, *s, n, round(v, 6)) for s, (k, n, v) in found.items()}


def test_lexed_spans_equal_written_out_values():
    rng = random.Random(12)
    names = ["password", "api_key", "a", "b", "secretToken", "path", "x.y"]
    literals = ["'Zk93!kdL'", '"xxxxxxxxxxxxxxxxxxxx"', "'<hidden value here ok>'", "`multi\nline Q8s`", "q7Wm2xR9tLpk", "changeme", "'your-own-secret-value-9A'",
                "''", "'aB3$'", "k=v=W93kdkLq28dk", "'${SOME_LONG_VARIABLE_1}'"]
    for _ in range(1500):
        lines = []
        for _ in range(rng.randint(1, 12)):
            parts = [rng.choice(names if rng.random() < 0.5 else literals) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
            lines.append(f"{rng.choice(names)}{rng.choice([' = ', ': ', '=', ' := '])}{' + '.join(parts)}")
        text = rng.choice(["\n", "; "]).join(lines)
        got = {(k, a, b, n, round(v, 6)) for k, a, b, n, v in secrets.lexed_spans(text)}
        assert got == naive_lexed(text), text
        assert all(any(x[0] <= a and b <= x[1] for x in [(x[1], x[2]) for x in secrets.base_spans(text)]) != ((k, a, b) in {
            y[:3] for y in secrets.scan(text)}) for k, a, b, *_ in secrets.lexed_spans(text))


@pytest.mark.parametrize("line", ["password = abcdefghijkl1\n", "password = password + 'Zk93!kdL'\n", "a = a + 'x'; password = a\n",
                                  "password = a\na = password + 'Zk93!kdL'\n", "b = a\na = b\nsecret = b\n"])
def test_many_assignments_are_linear(line):
    text = "a = 'Zk93!kdLq2'\npassword = a\n" + line * (1_000_000 // len(line))
    start = time.time()
    secrets.scan(text)
    assert time.time() - start < 10


def test_added_spans_are_whole_literals_and_base_ones_stay(spark, rows, docs, no_docs):
    long = 'x = "' + "a" * 200_000 + "\n" + 'y = "' * 20_000 + " password = 'abcdefghijkl1'"
    own = [(1, "é token = 'abcdefabcdefabcdef'", "en", "s", 0), (2, None, None, None, None), (3, long, "en", "s", 0)]
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(frame(spark, own)).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1]] == [("assign", 2, 29), ("hex", 11, 29)] and got[2] == []
    assert [(s.kind, s.start, s.end) for s in got[3] if s.kind in ("assign", "access", "hex")] == plain_base(long)
    assert secrets.scan_secrets(no_docs).count() == 0
    assert secrets.scan_secrets(docs).count() == len(rows)


# ---------------------------------------------------------------- substrings
def plain_repeats(texts, length):
    seen = Counter(t[j:j + length] for t in texts for j in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, np.int64)
        for j in range(len(t) - length + 1):
            if seen[t[j:j + length]] > 1:
                covered[j] += 1
                covered[j + length] -= 1
        keep = np.cumsum(covered[:-1]) == 0
        runs = int((np.diff(np.r_[0, ~keep]) == 1).sum())
        out.append((len(t), int((~keep).sum()), runs, sha(bytes(np.frombuffer(t, np.uint8)[keep]) if t else b"")))
    return out


def random_texts(seed):
    rng = random.Random(seed)
    alphabet = rng.choice(["ab", "abcdefgh ", "aé€ bc"])
    base = ["".join(rng.choices(alphabet, k=rng.randint(0, 900))) for _ in range(25)]
    shared = "".join(rng.choices(alphabet, k=330))
    out = list(base)
    for t in base:
        kind = rng.randint(0, 5)
        if kind == 0:
            out.append(t)
        elif kind == 1 and t:
            i = rng.randrange(len(t))
            out.append(t[:i] + "#" + t[i + 1:])
        elif kind == 2:
            i = rng.randint(0, 130)
            out.append("".join(rng.choices(alphabet, k=40)) + shared[i:i + 200] + "".join(rng.choices(alphabet, k=40)))
        elif kind == 3:
            out.append(t[100:400] * 2)
    return out + ["z" * 1000, "xyz" * 300, "", "short", shared]


@pytest.mark.parametrize("seed, bucket", [(1, 256), (2, 256), (3, 2), (4, 1), (5, 3)])
def test_removed_bytes_equal_brute_force(spark, seed, bucket):
    texts = random_texts(seed)
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_bytes, sum(x.stop - x.start for x in r.removed), len(r.removed), sha(bytes(r.kept)))
           for r in suffix.remove_repeats(df, bucket=bucket).collect()}
    for i, want in enumerate(plain_repeats([t.encode() for t in texts], suffix.LENGTH)):
        assert got[i] == want, (i, got[i], want)


def test_substring_dedup_on_the_odd_corpus(spark, rows, docs, no_docs):
    short = [r for r in rows if len(r[1] or "") < 60_000]
    want = Counter((r[0], *x) for r, x in zip(short, plain_repeats([(r[1] or "").encode() for r in short], suffix.LENGTH)))
    got = suffix.remove_repeats(frame(spark, short))
    assert Counter((r.doc_id, r.n_bytes, sum(x.stop - x.start for x in r.removed), len(r.removed), sha(bytes(r.kept)))
                   for r in got.collect()) == want
    assert suffix.remove_repeats(docs).count() == len(rows)
    assert suffix.remove_repeats(no_docs).count() == 0


def test_a_passage_in_a_third_of_all_documents(spark):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefghij ", k=420))
    texts = ["".join(rng.choices("klmnop qrst", k=150)) + (passage if i % 3 == 0 else "") + "".join(rng.choices("uvwxyz", k=150))
             for i in range(900)]
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)], 13)
    got = {r.doc_id: sum(x.stop - x.start for x in r.removed) for r in suffix.remove_repeats(df, bucket=32).collect()}
    for i, (_, removed, _, _) in enumerate(plain_repeats([t.encode() for t in texts], suffix.LENGTH)):
        assert got[i] == removed


def test_interval_tree():
    words = sorted([b"banana", b"banana", b"band", b"bee", b"ban", b"car", b"cart"])
    tree = suffix.intervals([suffix.common(a, b) for a, b in zip(words, words[1:])])
    found = {(tuple(words[a:b + 1]), n) for a, b, n in tree}
    want = set()
    for n in range(0, 7):
        for prefix in {w[:n] for w in words if len(w) >= n}:
            group = tuple(w for w in words if w.startswith(prefix))
            if len(group) > 1 and len({w[n:n + 1] for w in group}) + (min(map(len, group)) == n) > 1 or \
                    len(group) > 1 and all(len(w) == n for w in group):
                want.add((group, n))
    assert found == want


def test_long_text_is_cut_into_overlapping_pieces(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices("abc de", k=60_000)).encode()
    whole = suffix.anchors([text])
    monkeypatch.setattr(suffix, "PIECE", 4096)
    cut = suffix.anchors([text])
    rows = lambda a: sorted(zip(*(x.tolist() for x in a)))
    assert rows(whole) == rows(cut)


def test_repeat_groups_are_equal_strings(spark):
    texts = random_texts(6)
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    groups = {}
    for r in suffix.repeat_groups(df, bucket=64).collect():
        groups.setdefault(r.repeat, []).append((r.doc_id, r.start, r.length))
    assert len(groups) > 5
    for found in groups.values():
        strings = {texts[i].encode()[a:a + n] for i, a, n in found}
        assert len(strings) == 1 and len(found) > 1 and len(strings.pop()) >= suffix.LENGTH


def plain_groups(texts, length):
    """(length, occurrences) of all maximal repeats: every common-prefix interval of all sorted suffixes that differs before"""
    places = sorted(((i, a) for i, t in enumerate(texts) for a in range(len(t) - length + 1)), key=lambda x: texts[x[0]][x[1]:])
    prefix = [suffix.common(texts[i][a:], texts[j][b:]) for (i, a), (j, b) in zip(places, places[1:])]
    out = {}
    for k, n in enumerate(prefix):
        if n < length or k and prefix[k - 1] == n:
            continue
        lo, hi = k, k + 1
        while lo and prefix[lo - 1] >= n:
            lo -= 1
        while hi < len(prefix) and prefix[hi] >= n:
            hi += 1
        before = [texts[i][a - 1] if a else None for i, a in places[lo:hi + 1]]
        if None in before or len(set(before)) > 1:
            out[(n, tuple(sorted(places[lo:hi + 1])))] = 1
    return Counter(out)


def found_groups(spark, texts):
    groups = {}
    for r in suffix.repeat_groups(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect():
        groups.setdefault((r.repeat, r.length), []).append((r.doc_id, r.start))
    return Counter((n, tuple(sorted(places))) for (_, n), places in groups.items())


@pytest.mark.parametrize("seed", [1, 3])
def test_repeat_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    passage, long = letters(250), letters(5000)
    texts = [letters(80) + passage + letters(80) for _ in range(40)]  # more than a bucket of different surroundings
    texts += [letters(30) + long + letters(50), long, letters(60) + long[:3000] + passage, long[2000:] + letters(9)]
    texts += [t for t in random_texts(seed) if len(set(t)) > 3] + ["z" * 260, "xyz" * 90, texts[0], ""]
    got, want = found_groups(spark, texts), plain_groups([t.encode() for t in texts], suffix.LENGTH)
    assert got == want and (5000, ((40, 30), (41, 0))) in got and any(n == 250 and len(p) == 42 for n, p in got)


def test_repeat_groups_of_repeated_rows(spark):
    text = "".join(random.Random(2).choices("abcdefgh ", k=700))
    rows = [(7, text, "en", "s", 0)] * 2 + [(None, "q" + text[:300], "en", "s", 0), (8, None, "en", "s", 0)]
    got = suffix.repeat_groups(frame(spark, rows)).collect()
    assert Counter((r.length, r.doc_id, r.start) for r in got) == {(700, 7, 0): 2, (300, 7, 0): 2, (300, None, 1): 1}
