"""Problem 9: passages of held-out test items inside a training corpus.

The normalised items form one generalised suffix automaton (of the reversed items), each state
of long enough strings with the items they occur in. Texts stream through it: windows of the minimum run
length are read from their end, and a mismatch lets the scan jump behind it, so most characters
are never read. A text with one full window is then streamed whole, tracking the longest match
at every position, which gives the leaked items and the spans to remove.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_RUN = 60
#: Items are matched in blocks of so many normalised characters, which bounds the automaton and what is broadcast; each block sees all texts.
BLOCK_CHARS = 2_000_000

_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _OTHER.sub("", text.lower()) if text else ""


class SuffixAutomaton:
    def __init__(self, items: list[tuple[int, str]], run: int = 1):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        # Items of the states that hold strings of ``run`` characters; most have one item, and equal sets are one object.
        self.items: dict[int, frozenset] = {}
        one: dict[frozenset, frozenset] = {}
        for key, text in items:
            last = 0
            for ch in reversed(text):
                last = self._extend(last, ch)
                if self.length[last] >= run:
                    both = self.items.get(last, frozenset()) | {key}
                    self.items[last] = one.setdefault(both, both)
        for v in sorted((v for v in range(1, len(self.length)) if self.length[v] >= run), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if self.length[up] >= run and v in self.items:
                both = self.items.get(up, frozenset()) | self.items[v]
                self.items[up] = one.setdefault(both, both)

    def _state(self, length: int, link: int, nxt: dict[str, int]) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, ch: str) -> int:
        """The state of the string of p followed by ch, made on its own where it isn't yet."""
        q = self.next[p][ch]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(ch) == q:
            self.next[p][ch] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, ch: str) -> int:
        if ch in self.next[last]:
            return self._split(last, ch)
        cur, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and ch not in self.next[p]:
            self.next[p][ch] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, ch)
        return cur

    def touches(self, text: str, run: int) -> bool:
        """Whether text holds a run of that length of any item."""
        nxt, p, n = self.next, 0, len(text)
        while p + run <= n:
            v, i = 0, p + run - 1
            while i >= p:
                v = nxt[v].get(text[i], -1)
                if v < 0:
                    break
                i -= 1
            if i < p:
                return True
            p = i + 1
        return False

    def matches(self, text: str, run: int) -> dict[int, list[tuple[int, int]]]:
        """Of each item, the merged spans of text (normalised offsets) in runs of that length or longer."""
        found: dict[int, list[tuple[int, int]]] = {}
        v = size = 0
        for i in range(len(text) - 1, -1, -1):
            ch = text[i]
            while v and ch not in self.next[v]:
                v = self.link[v]
                size = self.length[v]
            if ch in self.next[v]:
                v = self.next[v][ch]
                size += 1
            if size >= run:
                # The shortest string of at least ``run`` characters that starts here: every item that holds it leaks.
                s = v
                while self.length[self.link[s]] >= run:
                    s = self.link[s]
                for key in self.items[s]:
                    spans = found.setdefault(key, [])
                    if spans and spans[-1][0] <= i + run:
                        spans[-1] = (i, spans[-1][1])
                    else:
                        spans.append((i, i + run))
        return found


_AUTOMATA: dict[str, SuffixAutomaton] = {}


def _automaton(name: str, block: list[tuple[int, str]], run: int) -> SuffixAutomaton:
    """The automaton of a block; a worker keeps the last two."""
    if name not in _AUTOMATA:
        while len(_AUTOMATA) > 1:
            del _AUTOMATA[next(iter(_AUTOMATA))]
        _AUTOMATA[name] = SuffixAutomaton(block, run)
    return _AUTOMATA[name]


def _blocks(items: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for item in items:
        if block and size + len(item[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item[1])
    if block:
        yield block


def _known(items: DataFrame, item_key: str, text: str, min_run: int) -> Iterator[list[tuple[int, str]]]:
    """The normalised items long enough to leak, in blocks."""
    rows = items.where(F.length(text) >= min_run).select(item_key, text).distinct().toLocalIterator()
    return _blocks(sorted(((r[0], t) for r in rows if len(t := normalise(r[1])) >= min_run), key=str))


def leaked_passages(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """One row per document and item that share a run of at least ``min_run`` letters and digits, compared in lower case.

    Columns: both keys, ``longest_run``, ``matched_chars`` and ``doc_chars`` (normalised), ``coverage`` of
    the document. Null, empty and short texts match nothing; repeated items count once. The items are the
    stated query set: they are read to the driver in blocks, and every block is held against all texts.
    """
    spark = documents.sparkSession
    key_type = documents.schema[doc_key].dataType.simpleString()
    item_type = items.schema[item_key].dataType.simpleString()
    schema = f"`{doc_key}` {key_type}, `{item_key}` {item_type}, longest_run int, matched_chars int, doc_chars int, coverage double"
    source = documents.select(doc_key, text).where(F.length(text) >= min_run)
    out = None
    for block in _known(items, item_key, text, min_run):
        shared = spark.sparkContext.broadcast(block)
        part = source.mapInPandas(_scan(shared, f"{uuid.uuid4()}", min_run, schema), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _scan(shared, name: str, min_run: int, schema: str):
    columns = [c.strip("` ").split(" ")[0].strip("`") for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(name, shared.value, min_run)
        for batch in batches:
            out = []
            for doc, raw in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                t = normalise(raw)
                if automaton.touches(t, min_run):
                    for item, spans in automaton.matches(t, min_run).items():
                        covered = sum(b - a for a, b in spans)
                        out.append((doc, item, max(b - a for a, b in spans), covered, len(t), covered / len(t)))
            yield pd.DataFrame(out, columns=columns)

    return run


def clean_documents(documents: DataFrame, leaks: DataFrame, doc_key: str = "doc_id", max_run: int = MIN_RUN, max_coverage: float = 0.0) -> DataFrame:
    """Documents without those that leak an item beyond the limits on run length and coverage."""
    bad = leaks.where((F.col("longest_run") >= max_run) & (F.col("coverage") > max_coverage)).select(doc_key).distinct()
    return documents.join(bad, doc_key, "left_anti")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which are given in its letters and digits; a blank stands for each, and for what lies between two that touch."""
    place = [i for i, ch in enumerate(text) for c in ch.lower() if c.isalnum()]
    out, at, end = [], 0, -1
    for a, b in sorted(spans):
        if a <= end:
            at, end = max(at, place[b - 1] + 1), max(end, b)
            continue
        out += [text[at : place[a]], " "]
        at, end = place[b - 1] + 1, b
    return "".join([*out, text[at:]])


def cut_passages(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", min_run: int = MIN_RUN, max_coverage: float = 0.5) -> DataFrame:
    """``doc_key, text, removed_chars``: all documents without the passages they share with an item, in runs of at least ``min_run`` letters and digits.

    Documents of which the passages cover more than ``max_coverage`` are left out. Null and empty texts stay as they
    are. The blocks of items follow each other in one pass over the documents.
    """
    schema = f"`{doc_key}` {documents.schema[doc_key].dataType.simpleString()}, `{text}` string, removed_chars int"
    out = documents.select(doc_key, text, F.lit(0).alias("removed_chars"))
    for block in _known(items, item_key, text, min_run):
        shared, name = documents.sparkSession.sparkContext.broadcast(block), f"{uuid.uuid4()}"

        def run(batches: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:
            automaton = _automaton(name, shared.value, min_run)
            for batch in batches:
                keep = []
                for doc, raw, removed in batch.itertuples(index=False):
                    t = normalise(raw)
                    if automaton.touches(t, min_run):
                        spans = [s for found in automaton.matches(t, min_run).values() for s in found]
                        clean = cut_spans(raw, spans)
                        removed += len(t) - len(normalise(clean))
                        if len(t) - len(normalise(clean)) > max_coverage * len(t):
                            continue
                        raw = clean
                    keep.append((doc, raw, removed))
                yield pd.DataFrame(keep, columns=batch.columns)

        out = out.mapInPandas(run, schema)
    return out
