"""Lists written as Python literals, read by a finite-state machine.

The reader walks over the text's tokens once, with an explicit stack of open
brackets instead of recursion.  It knows what a literal can hold: strings with
any prefix, quote and escape (``\\xNN``, ``\\uNNNN``, ``\\N{...}``, octal),
neighbouring strings that concatenate, numbers with signs, ``None`` and the
other constants, nested lists, tuples, sets and dictionaries, comments and line
continuations.  No expression is evaluated, and a text of any length takes time
in proportion to it.

`parse_list_literal` runs it in Arrow batches: a literal list, else a JSON
list, else the pieces between quote-comma-quote, so that no text is lost.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

MAX_DEPTH = 200  # open brackets; Python's own limit


class NotALiteral(ValueError):
    """The text is not one Python literal."""


_DIGITS = r"[0-9](?:_?[0-9])*+"
_TOKEN = re.compile(rf"""
    (?P<blank>(?:[ \t\f\n]|\\\n|\#[^\n]*+)++)
  | (?P<prefix>(?i:br|rb|[bru])?)(?:
        '''(?P<t1>[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+)'''
      | \"\"\"(?P<t2>[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+)\"\"\"
      | '(?!'')(?P<s1>[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+)'
      | "(?!"")(?P<s2>[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+)")
  | (?P<number>(?:
        (?P<imaginary>(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?[jJ])
      | (?P<float>(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|{_DIGITS}[eE][+-]?{_DIGITS})
      | 0[xX](?:_?[0-9a-fA-F])++|0[oO](?:_?[0-7])++|0[bB](?:_?[01])++|0(?:_?0)*+|[1-9](?:_?[0-9])*+)(?![\w.]))
  | (?P<name>True|False|None|set[ \t\f\n]*+\([ \t\f\n]*+\)|\.\.\.)(?![\w])
  | (?P<mark>[\[\](){{}},:+-])
""", re.X | re.A)
_ESCAPE = re.compile(r"\\(?:([0-7]{1,3})|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|N\{([^}]*)\}|([\s\S]))")
_BYTE_ESCAPE = re.compile(r"\\(?:([0-7]{1,3})|x([0-9a-fA-F]{2})|()()()([\s\S]))")
_PLAIN_ESCAPES = {"\n": "", "\\": "\\", "'": "'", '"': '"', "a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_CONSTANTS = {"True": True, "False": False, "None": None, "...": ...}
_CLOSES = {"]": "[", ")": "(", "}": "{"}


def _character(m: re.Match, wrong: str = "xuUN") -> str:
    octal, x, u, wide, name, other = m.groups()
    if octal:
        return chr(int(octal, 8))
    if x or u or wide:
        code = int(x or u or wide, 16)
        if code > 0x10FFFF:
            raise NotALiteral("no such character")
        return chr(code)
    if name is not None and other is None:
        try:
            found = unicodedata.lookup(name)
        except KeyError:
            found = ""
        if len(found) != 1:
            raise NotALiteral("no such character name")
        return found
    if other in wrong:
        raise NotALiteral("incomplete escape")
    return _PLAIN_ESCAPES.get(other, "\\" + other)


def _string(m: re.Match) -> str | bytes:
    prefix, body = m["prefix"].lower(), next(m[g] for g in ("s1", "s2", "t1", "t2") if m[g] is not None)
    if "b" not in prefix:
        return body if "r" in prefix or "\\" not in body else _ESCAPE.sub(_character, body)
    if not body.isascii():
        raise NotALiteral("bytes hold ASCII characters only")
    if "r" not in prefix:
        body = _BYTE_ESCAPE.sub(lambda e: chr(ord(c) & 255) if len(c := _character(e, "x")) == 1 else c, body)
    return body.encode("latin-1")


def _number(m: re.Match):
    digits = m["number"].replace("_", "")
    if m["imaginary"]:
        return complex(0.0, float(digits[:-1]))
    return float(digits) if m["float"] else int(digits, 0)  # too many digits: a ValueError, as in Python


class _Frame:
    """An open bracket: what it holds so far, the key that waits for its value, and the sum or sign that waits for it."""

    __slots__ = ("bracket", "items", "comma", "key", "is_dict", "sign", "base")

    def __init__(self, bracket: str, sign: str, base):
        self.bracket, self.items, self.comma, self.key, self.is_dict = bracket, [], False, _NOTHING, False
        self.sign, self.base = sign, base


_NOTHING = object()


def _signed(sign: str, base, new, kind: str):
    """(value, kind) of an unsigned number after a sign, or after a real number and a sign."""
    if base is not _NOTHING:
        if kind != "imaginary":
            raise NotALiteral("a sum")
        return (base + new if sign == "+" else base - new), "other"
    if kind not in ("number", "imaginary"):
        raise NotALiteral("a sign without a number")
    return (-new if sign == "-" else +new), "signed" if kind == "number" else "other"


def read_literal(text: str):
    """The value of a text that is one Python literal; `NotALiteral` (or another ValueError) if it is not.

    States between tokens: a value is expected (``value`` is nothing), or one is there and its ``kind`` says what may
    follow it: a string takes another string, a real number (unsigned or signed) takes a sign and an imaginary one.
    """
    if "\0" in text:
        raise NotALiteral("null character")
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    stack: list[_Frame] = []
    value, kind, sign, base = _NOTHING, "", "", _NOTHING
    at, end, match = 0, len(text), _TOKEN.match
    while at < end:
        m = match(text, at)
        if m is None:
            raise NotALiteral(f"at {at}")
        at = m.end()
        what = m.lastgroup
        if what == "blank":
            continue
        if what in ("s1", "s2", "t1", "t2"):
            new = _string(m)
            if sign:
                raise NotALiteral("a sign before a string")
            if value is _NOTHING:
                value, kind = [new], "string"
            elif kind == "string" and type(value[0]) is type(new):
                value.append(new)
            else:
                raise NotALiteral("a string after a value")
            continue
        if kind == "string":  # complete now: any other token ends it
            value, kind = value[0][:0].join(value), "other"
        if m["number"] is not None:
            if value is not _NOTHING:
                raise NotALiteral("a number after a value")
            value = _number(m)
            kind = "imaginary" if isinstance(value, complex) else "number"
            if sign:
                value, kind = _signed(sign, base, value, kind)
                sign, base = "", _NOTHING
            continue
        if what == "name":
            if value is not _NOTHING or sign:
                raise NotALiteral("a name after a value")
            value, kind = set() if m[0].startswith("set") else _CONSTANTS[m[0]], "other"
            continue
        mark = m[0]
        if mark in "+-":
            if sign or (value is not _NOTHING and kind not in ("number", "signed")):
                raise NotALiteral("an expression")
            sign, base, value, kind = mark, value, _NOTHING, ""
        elif mark in "[({":
            if value is not _NOTHING or len(stack) >= MAX_DEPTH:
                raise NotALiteral("a bracket after a value, or too many")
            stack.append(_Frame(mark, sign, base))
            sign, base = "", _NOTHING
        elif sign:
            raise NotALiteral("a sign without a number")
        elif not stack:
            raise NotALiteral("more than one value")
        elif mark == ":":
            top = stack[-1]
            if top.bracket != "{" or value is _NOTHING or top.key is not _NOTHING or (top.items and not top.is_dict):
                raise NotALiteral("a colon")
            top.key, top.is_dict, value, kind = value, True, _NOTHING, ""
        else:
            top = stack[-1]
            if value is not _NOTHING:
                if top.is_dict and top.key is _NOTHING:
                    raise NotALiteral("a key without a value")
                top.items.append((top.key, value) if top.is_dict else value)
                top.key = _NOTHING
            elif mark == "," or top.key is not _NOTHING:
                raise NotALiteral("a comma or the end without a value")
            if mark == ",":
                top.comma, value, kind = True, _NOTHING, ""
                continue
            if _CLOSES[mark] != top.bracket:
                raise NotALiteral("brackets do not match")
            stack.pop()
            try:
                if mark == "]":
                    value, kind = top.items, "other"
                elif mark == ")":
                    if len(top.items) == 1 and not top.comma:  # a value in parentheses is that value
                        value = top.items[0]
                    else:
                        value, kind = tuple(top.items), "other"
                else:
                    value, kind = dict(top.items) if top.is_dict or not top.items else set(top.items), "other"
            except TypeError as e:  # a list as a key
                raise NotALiteral(str(e)) from e
            if top.sign:
                value, kind = _signed(top.sign, top.base, value, kind)
    if kind == "string":
        value = value[0][:0].join(value)
    if stack or sign or value is _NOTHING:
        raise NotALiteral("the text ends early")
    return value


_SURROGATE = re.compile("[\ud800-\udfff]")
_BETWEEN = re.compile(r"""['"],\s*['"]""")


def _storable(s: str) -> str:
    """Pairs of surrogate escapes are one character; a lone one, which no stored text can hold, is U+FFFD."""
    return s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if _SURROGATE.search(s) else s


def read_list(text: str | None) -> list[str]:
    """The messages of a list text: see `parse_list_literal`."""
    if text is None:
        return []
    text = text.strip()
    if not (text.startswith("[") and text.endswith("]")):
        return [text]
    for read in (read_literal, json.loads):
        try:
            found = read(text)
        except (ValueError, RecursionError):
            continue
        if isinstance(found, list):
            return [_storable(str(v)) for v in found]
    pieces = [p.strip().strip("'\"") for p in _BETWEEN.split(text[1:-1])]
    return [p for p in pieces if p]


def parse_list_literal(c) -> Column:
    """Parse a list rendered by Python (or as JSON) into its messages, values other than strings as Python prints them.

    A text in brackets that is one Python literal list is read as such, else as a JSON list; any other loses its
    brackets and is cut at quote-comma-quote.  A text without brackets is one message, null is no message.
    """
    ship_package(SparkSession.active())

    @F.pandas_udf("array<string>")
    def messages(texts: pd.Series) -> pd.Series:
        return texts.map(read_list)

    return messages(F.col(c) if isinstance(c, str) else c)
