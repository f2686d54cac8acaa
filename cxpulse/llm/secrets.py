"""Secret scan by assignment-aware lexing.

Three base patterns (key words with a value, access key ids, long hex runs) are
matched first and always reported.  A small lexer then reads source and
configuration syntax (``name = "literal"``, ``"name": 'literal'``, ``name :=
literal``, ``name => literal``, literals and names joined by ``+``) into
name-literal pairs, propagates constants (``a = "x"; password = a``) within the
document, and scores the literals by how sensitive the name they end up in is
and how random they look.  All offsets are code points.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# base patterns (fixed)
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # maximal runs: the same as AKIA[A-Z0-9]+ of 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "literal", "constant")

# words of a name and what they say about its value
NAME_WORDS = {"password": 5, "passwd": 5, "passphrase": 5, "pwd": 4, "pass": 3, "secret": 5, "token": 4, "apikey": 5,
              "credential": 5, "credentials": 5, "cred": 3, "creds": 4, "auth": 3, "authorization": 3, "bearer": 4,
              "privatekey": 6, "accesskey": 5, "signingkey": 5, "encryptionkey": 5, "key": 2, "private": 2, "api": 1,
              "access": 1, "signing": 2, "encryption": 2, "client": 1, "salt": 2, "dsn": 2, "connectionstring": 3,
              "public": -4, "example": -3, "sample": -3, "test": -1, "length": -4, "count": -4, "name": -3, "id": -2,
              "url": -2, "path": -4, "file": -3, "dir": -4, "type": -4, "expiry": -4, "ttl": -4, "field": -3, "label": -4}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|changeme|todo|none|null|true|false|undefined|your[-_ ].*|<.*>|\$\{.*\}|%.*%|\{\{.*\}\})$")
_YOUR = re.compile(r"(?i)your[-_ ]")
_BRACKETS = (("<", ">"), ("${", "}"), ("%", "%"), ("{{", "}}"))
EDGE = 16  # characters kept of a value's ends
THRESHOLD = 5.0
MIN_LITERAL = 8

# possessive throughout: every literal, blank and name of any length is read once
_PAIR = re.compile(r"""(?<![\w$.-])(["']?)([A-Za-z_$][\w$.-]*+)\1[ \t]*+(?::=|=>|[:=])(?![=:])[ \t]*+""")
_STRING = re.compile(r""""([^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'([^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|`([^`\n]*+)`""")
_REFERENCE = re.compile(r"[A-Za-z_$][\w$.]*+(?![=+/-])")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]++")
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping per kind."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def name_score(name: str) -> float:
    """How sensitive a name's value is: the words it is made of (snake, kebab, dotted or camel case), and their pairs."""
    words = [w.lower() for w in _NAME_PART.findall(name)]
    joined = [a + b for a, b in zip(words, words[1:])]
    return float(sum(NAME_WORDS.get(w, 0) for w in words + [j for j in joined if j in NAME_WORDS]))


def literal_score(value: str) -> float:
    """How random a literal looks: entropy per character, character classes, length; prose and placeholders score low."""
    return _score(len(value), value[:EDGE], value[-EDGE:], Counter(value))


def _score(size: int, head: str, tail: str, chars: Counter) -> float:
    """The same from a value's length, its first and last characters and its characters' counts."""
    if size <= EDGE:
        placeholder = PLACEHOLDER.match(head)
    else:  # too long for the words; the other placeholders show in their ends
        placeholder = not set(chars) - {"x", "X"} or not set(chars) - {"*"} or "\n" not in chars and (
            _YOUR.match(head) or any(head.startswith(a) and tail.endswith(b) for a, b in _BRACKETS))
    return -10.0 if placeholder else randomness(chars)


def randomness(chars: Counter) -> float:
    n = sum(chars.values())
    if n < MIN_LITERAL:
        return -10.0
    entropy = -sum(c / n * math.log2(c / n) for c in chars.values() if c / n)
    classes = sum(any(t(c) for c in chars) for t in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in chars)
    return entropy - 2.0 + 0.5 * classes + (0.5 if n >= 16 else 0.0) - 2.0 * (chars[" "] > 1) - 1.5 * all(c.isalpha() for c in chars)


class _Values:
    """The values read in a text: each a list of parts, which are spans of literals or the numbers of earlier values.

    Of a concatenation the characters' counts are kept while a name holds it, so that adding to it costs no more than
    what is added; a literal's own are counted when needed.
    """

    def __init__(self, text: str):
        self.text, self.parts, self.edges = text, [], []
        self.root: list[int] = []  # the value itself, or the one it is another name for
        self.chars: dict[int, Counter] = {}
        self.holders: Counter = Counter()
        self.run = (0, 0)  # the unquoted run read last: pairs inside it end with it
        self.rest = (0, 0, Counter())  # characters of what is left of such a run

    def read(self, at: int, names: dict[str, int]) -> tuple[int, bool] | None:
        """The value at ``at``: its number, whether a constant was propagated."""
        text, parts, constant = self.text, [], False
        while True:
            if m := _STRING.match(text, at):
                parts.append(m.span(m.lastindex))
            elif (m := _REFERENCE.match(text, at)) and m[0] in names:
                parts.append(names[m[0]])
                constant = True
            elif not parts and self.run[0] <= at < self.run[1]:
                parts.append((at, self.run[1]))
                break
            elif not parts and (m := _BARE.match(text, at)):
                self.run = m.span()
                parts.append(self.run)
                break
            else:
                break
            plus = _PLUS.match(text, m.end())
            if not plus:
                break
            at = plus.end()
        if not parts:
            return None
        number = len(self.parts)
        self.parts.append(parts)
        self.root.append(number if len(parts) > 1 or isinstance(parts[0], tuple) else self.root[parts[0]])
        size, head, tail = 0, "", ""
        for p in parts:
            n, first, last = (p[1] - p[0], text[p[0]:min(p[1], p[0] + EDGE)], text[max(p[0], p[1] - EDGE):p[1]]) \
                if isinstance(p, tuple) else self.edges[p]
            size, head, tail = size + n, (head + first)[:EDGE] if size < EDGE else head, (tail + last)[-EDGE:]
        self.edges.append((size, head, tail))
        if len(parts) > 1:
            total = Counter(self._part(parts[0]))
            for p in parts[1:]:
                total.update(self._part(p))
            self.chars[number] = total
        return number, constant

    def hold(self, value: int, by: int = 1) -> None:
        """A name holds the value, or (``by`` -1) no longer does."""
        value = self.root[value]
        self.holders[value] += by
        if not self.holders[value]:
            del self.holders[value]
            self.chars.pop(value, None)

    def _part(self, part) -> Counter:
        return Counter(self.text[part[0]:part[1]]) if isinstance(part, tuple) else self.count(part)

    def count(self, value: int) -> Counter:
        """The characters of a value that a name holds."""
        value = self.root[value]
        if value in self.chars:
            return self.chars[value]
        start, stop = self.parts[value][0]
        if stop != self.run[1]:
            self.chars[value] = Counter(self.text[start:stop])
            return self.chars[value]
        first, last, chars = self.rest
        if last == stop and first <= start:  # further into the same run
            chars.subtract(self.text[first:start])
            chars = +chars
        else:
            chars = Counter(self.text[start:stop])
        self.rest = (start, stop, chars)
        return Counter(chars)

    def score(self, value: int) -> float:
        size, head, tail = self.edges[value]
        return _score(size, head, tail, self.count(value))


def lexed_spans(text: str) -> list[tuple[str, int, int, str, float]]:
    """(kind, start, end, name, score) of literals that end up in sensitive names, directly or through constants.

    A literal has the best score of all sensitive values it is part of (the first of equal ones); the scores are passed
    down from later values to the earlier ones they are made of, each once.
    """
    if "=" not in text and ":" not in text:
        return []
    values, names, best = _Values(text), {}, {}
    sensitive: dict[str, float] = {}
    for m in _PAIR.finditer(text):
        name = m[2]
        read = values.read(m.end(), names)
        old = names.pop(name, None)  # no longer the constant it was
        if read is not None:
            value, constant = read
            names[name] = value
            values.hold(value)
            if name not in sensitive:
                sensitive[name] = name_score(name)
            if sensitive[name] >= 3:
                score = sensitive[name] + values.score(value)
                if score >= THRESHOLD:
                    best[value] = (score, -value, constant, name)
        if old is not None:
            values.hold(old, -1)
    found: dict[tuple[int, int], tuple] = {}
    for value in range(len(values.parts) - 1, -1, -1):
        if (hit := best.get(value)) is None:
            continue
        for part in values.parts[value]:
            held = found if isinstance(part, tuple) else best
            if part not in held or held[part][:2] < hit[:2]:
                held[part] = hit
    return [("constant" if constant else "literal", a, b, name, score)
            for (a, b), (score, _, constant, name) in found.items() if b > a]


def scan(text: str) -> list[tuple[str, int, int, str | None, float | None]]:
    """All spans of a text by start, then kind: the base ones, and lexed ones that no base span covers."""
    base = base_spans(text)
    starts, reach = [], []  # by start: how far the base spans up to there reach
    for _, a, b in sorted(base, key=lambda x: x[1]):
        starts.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    more = [x for x in lexed_spans(text) if not (at := bisect_right(starts, x[1])) or reach[at - 1] < x[2]]
    return sorted([(k, a, b, None, None) for k, a, b in base] + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("name", pa.string()), ("score", pa.float64())]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ("kind", "start", "end", "name", "score")
    for batch in batches:
        found = [[dict(zip(keys, x)) for x in scan(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW_SPANS)], names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end in code points, target name and score of lexed ones).

    Null texts count as empty and have no spans; repeated rows and ids stay; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_scan_batches, f"doc_id long, spans {_SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def is_base(span: Column) -> Column:
    return span["kind"].isin("assign", "access", "hex")
