"""Problem 8: exact byte-pair encoding of whole texts with a public vocabulary.

Each pre-token is encoded by backtracking: take the longest vocabulary entry at the current
position (found on the trie of an Aho-Corasick automaton of all entries; as the search starts anew at each place, no failure links are needed), keep it if it may follow the entry before it,
else try its next shorter prefix, else step back. Whether two entries may stand side by side is
decided from the merge order alone and remembered in a compatibility table, so the result equals
that of applying the merges one by one, in linear time.
"""

from __future__ import annotations

import json
import os

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_FOLDER = "/opt/tokenizers"
#: Fixed value: the pre-token pattern of this family of vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered by each Python worker; when full the memory is emptied, results do not change.
CACHE_ENTRIES = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        # Byte strings are held as Latin-1 text, one character a byte.
        raw = {k: "".join(chr(letters[c]) for c in k) for k in model["vocab"] if all(c in letters for c in k)}
        ids = {raw[k]: i for k, i in model["vocab"].items() if k in raw}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        special = {raw[k] for k in raw if len(raw[k]) > 1} - {raw[a] + raw[b] for a, b in merges}
        self.ids = {s: i for s, i in ids.items() if s not in special}
        # Ranks: bytes first, then the merged entries in the order of the merges.
        order = [s for s in self.ids if len(s) == 1]
        self.rank = {s: r for r, s in enumerate(order)}
        self.pair: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        text = list(order)
        for a, b in merges:
            x, y = self.rank[raw[a]], self.rank[raw[b]]
            r = self.rank.setdefault(raw[a] + raw[b], len(text))
            if r == len(text):
                text.append(raw[a] + raw[b])
                self.left.append(x)
                self.right.append(y)
                self.pair[x, y] = r
        self.size = [len(s) for s in text]
        self.widest = max(self.size)
        self.out = [self.ids[s] for s in text]
        self.trie = ahocorasick.Automaton()
        for s, r in self.rank.items():
            self.trie.add_word(s, r)
        self.shorter = [self._longest(s[:-1]) if len(s) > 1 else -1 for s in text]
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def _longest(self, s: str) -> int:
        """Rank of the longest entry that starts s."""
        n = self.trie.longest_prefix(s)
        while n and s[:n] not in self.rank:
            n -= 1
        return self.rank[s[:n]] if n else -1

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging would leave the entries a and b side by side: walk back through the merges at the seam, latest first."""
        key = (a, b)
        known = self.fits.get(key)
        if known is not None:
            return known
        limit, ok = 1 << 60, True
        while True:
            joined = self.pair.get((a, b))
            if joined is not None and joined < limit:
                ok = False
                break
            unsplit_a, unsplit_b = self.left[a] == a, self.left[b] == b
            if unsplit_a and unsplit_b:
                break
            # The later merge of the two is undone first; on a tie the right one.
            if not unsplit_a and (unsplit_b or a > b):
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]
        if len(self.fits) > 4 * CACHE_ENTRIES:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def _word(self, s: str) -> list[int]:
        whole = self.rank.get(s)
        if whole is not None:
            return [self.out[whole]]
        n, pos, done, dead = len(s), 0, [], bytearray(len(s) + 1)
        token = self._longest(s)
        while True:
            last = done[-1] if done else -1
            while token >= 0:
                end = pos + self.size[token]
                if not dead[end] and (last < 0 or self._compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                done.append(token)
                pos += self.size[token]
                if pos == n:
                    return [self.out[t] for t in done]
                token = self._longest(s[pos : pos + self.widest])
            else:
                dead[pos] = 1
                token = done.pop()
                pos -= self.size[token]
                token = self.shorter[token]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, out = self.words, []
        for w in self.split(text):
            got = words.get(w)
            if got is None:
                got = self._word(w.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(words) >= CACHE_ENTRIES:
                    words.clear()
                if len(w) <= 64:
                    words[w] = got
            out.extend(got)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("SEGLOOM_TOKENIZERS", DEFAULT_FOLDER), f"{name}.json")


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Adds the token ids of ``text``. Null and empty texts give an empty list; no special tokens are added, and their strings in a text are ordinary text.

    One narrow pass: no shuffle, memory a batch of rows and a bounded memory of pre-tokens.
    """
    where = path or vocabulary_path()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(col: pd.Series) -> pd.Series:
        e = encoder(where)
        return pd.Series([np.asarray(e.encode(t), dtype=np.int32) for t in col])

    return df.withColumn(out, run(F.col(text)))


class Decoder:
    """Ids to text by an offset table: all entries in one byte string, entry i between offsets i and i + 1."""

    def __init__(self, path: str):
        e = encoder(path)
        top = max(e.ids.values()) + 1
        parts = [b""] * top
        for s, i in e.ids.items():
            parts[i] = s.encode("latin-1")
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.bytes = b"".join(parts)

    def decode(self, ids) -> str:
        o, b = self.offsets, self.bytes
        return b"".join(b[o[i] : o[i + 1]] for i in ids).decode("utf-8", "surrogatepass")


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """Adds the text of a list of ids; null lists give null, empty lists an empty text."""
    where = path or vocabulary_path()

    @F.pandas_udf(T.StringType())
    def run(col: pd.Series) -> pd.Series:
        d = _DECODERS.setdefault(where, None) or Decoder(where)
        _DECODERS[where] = d
        return pd.Series([None if x is None else d.decode(x) for x in col])

    return df.withColumn(out, run(F.col(ids)))


_DECODERS: dict[str, Decoder | None] = {}
