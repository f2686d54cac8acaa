"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token starts as its byte symbols, the last one marked as a word's end.
The leaves of a segment tree are the ranks of adjacent symbols' merges, each
with its position below it, so the root always holds the leftmost merge of
lowest rank.  Applying it changes three leaves at most (the pair itself, the
one before and the one that is swallowed), each in logarithmic time; when the
root holds no merge, the symbols are the tokens.  A pre-token of any length
costs n log n.

The vocabulary, merges, special strings and the word-end mark come from a
`tokenizers` file; normalisation and pre-tokenisation are that file's own
(through the installed library where a text leaves the plain characters for
which one regular expression is the same).  Documents are independent, so one
Arrow pass without a shuffle does it; a worker remembers a bounded number of
short pre-tokens.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

TOKENIZER = "word_bpe_49k"
MEMO = 250_000  # pre-tokens in each of the two generations a worker remembers
MEMO_LENGTH = 32  # longer pre-tokens are not remembered
NO_MERGE = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    out = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


class PairTree:
    """Segment tree over the ranks of the pairs of neighbouring symbols of one pre-token.

    A node is the smallest of ``rank * leaves + position`` below it, so the root is the leftmost pair of lowest rank.
    """

    def __init__(self, symbols: list[int], ranks: dict[tuple[int, int], int], products: list[int]):
        self.symbols, self.rank_of, self.products = symbols, ranks.get, products
        n = len(symbols)
        self.following = list(range(1, n + 1))  # position of the next symbol, n after the last
        self.previous = list(range(-1, n - 1))
        leaves = self.leaves = 1 << max(n - 1, 0).bit_length()
        keys = []
        for i, pair in enumerate(zip(symbols, symbols[1:])):
            rank = self.rank_of(pair)
            keys.append(NO_MERGE if rank is None else rank * leaves + i)
        node = self.node = [NO_MERGE] * leaves + keys + [NO_MERGE] * (leaves - len(keys))
        for k in range(leaves - 1, 0, -1):
            x, y = node[2 * k], node[2 * k + 1]
            node[k] = x if x < y else y

    def _put(self, i: int, key: int) -> None:
        """Set the leaf of position ``i`` and what changes above it."""
        node, k = self.node, self.leaves + i
        node[k] = key
        while k > 1:
            beside = node[k ^ 1]
            if beside < key:
                key = beside
            k >>= 1
            if node[k] == key:
                return
            node[k] = key

    def _pair(self, i: int, j: int) -> None:
        """The pair at position ``i`` is now its symbol and the one at ``j``."""
        rank = self.rank_of((self.symbols[i], self.symbols[j])) if j < len(self.symbols) else None
        self._put(i, NO_MERGE if rank is None else rank * self.leaves + i)

    def run(self) -> list[int]:
        """Apply the root's merge until it holds none; the symbols that are left."""
        symbols, following, previous, node, leaves = self.symbols, self.following, self.previous, self.node, self.leaves
        n = len(symbols)
        while (best := node[1]) != NO_MERGE:
            rank, i = divmod(best, leaves)
            gone = following[i]
            after = following[i] = following[gone]
            symbols[i] = self.products[rank]
            if after < n:
                previous[after] = i
                self._put(gone, NO_MERGE)
            self._pair(i, after)
            if (before := previous[i]) >= 0:
                self._pair(before, i)
        out, i = [], 0
        while i < n:
            out.append(symbols[i])
            i = following[i]
        return out


class Codec:
    """Encoder and decoder of one `tokenizers` BPE file (byte-level, with a word-end mark, no decoder of its own)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        vocab, self.mark = model["vocab"], model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or config["decoder"] or config["post_processor"] or model.get("byte_fallback") \
                or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError(f"not a plain BPE file: {path}")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.products = [vocab[a + b] for a, b in pairs]
        self.vocab = vocab
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.symbols = byte_symbols()
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))).split
        self.find_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))).findall
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the memo that filled up before this one
        self._plain()

    def _plain(self) -> None:
        """The file's own rules on plain texts: where its classes are the same in every engine and lower case is one to one."""
        letters = "a-zß-öø-ÿ"  # the plain set below in lower case
        self.odd = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]").search
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        sample = "I've  A'LL\tÀÉß x2 42 --'s 'tis don't\n...élan ÿ!?"
        mine = re.compile(pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"\p{L}", letters)
                          .replace(r"[\p{N}]", "[0-9]").replace(r"\p{N}", "0-9")).findall
        same = [self._bytes(w) for w in mine(sample.lower())] == [w for w, _ in self._library(sample)]
        self.pre_tokens = mine if same else None  # another file: everything through the library

    def _bytes(self, word: str) -> str:
        return "".join([self.symbols[b] for b in word.encode("utf-8")])

    def _library(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-token (byte symbols)."""
        symbols = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.mark]]
        return PairTree(symbols, self.ranks, self.products).run() if len(symbols) > 1 else symbols

    def _remembered(self, word: str, shown: bool) -> bytes:
        key = word if shown else " " + word  # no pre-token holds a blank
        found = self.memo.get(key) or self.older.get(key)
        if found is None:
            found = array("i", self.encode_word(word if shown else self._bytes(word))).tobytes()
        if len(key) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[key] = found
        return found

    def _segment(self, text: str) -> bytes:
        if self.pre_tokens is None or self.odd(text):
            return b"".join([self._remembered(w, True) for w, _ in self._library(text)])
        return b"".join([self.memo.get(" " + w) or self._remembered(w, False) for w in self.pre_tokens(text.lower())])

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text; the strings of special tokens become those tokens."""
        if not any(s in text for s in self.special):
            return np.frombuffer(self._segment(text), np.int32)
        pieces, marks = self.split_special(text), self.find_special(text)
        out = [self._segment(pieces[0])]
        for mark, piece in zip(marks, pieces[1:]):
            out += [np.int32(self.special[mark]).tobytes(), self._segment(piece)]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by one blank (what a file without a decoder defines), special ones included."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


@lru_cache(maxsize=2)
def codec(name: str = TOKENIZER) -> Codec:
    return Codec(tokenizer_path(name))


def _code(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name)
        for batch in batches:
            ids = [c.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                 pa.array([c.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return work


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per input row: doc_id, ids (array of int), decoded (the text its ids decode to).

    ``tokenizer`` names a file of the installed `public_tokenizers`.  Null texts count as empty and have no ids;
    repeated rows and null ids stay rows of their own; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_code(tokenizer), "doc_id long, ids array<int>, decoded string")
