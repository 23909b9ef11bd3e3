"""Problem 5: pairing the lines of bilingual texts that translate each other.

Sentence vectors share one space: a source word is spread over the target stems it is translated
by (association learned from all one-sentence entries), codes and numbers stand for themselves.
The sentences of an entry are matched by entropic optimal transport with a null mass on either
side, which takes up omissions; Sinkhorn scaling solves it, and the transport is turned into
links. Masses are one, so of sentences that are merged into one, or that one is split into, the
transport gives the strongest; the others join its group if they make it more similar as a whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: A stem is so many first letters of a word, which unites most of its endings.
STEM = 5
#: Word pairs seen less often, or with a smaller association, are no translations.
LEAST_SEEN, LEAST_DICE = 2, 0.08
#: Regularisation of the transport, and the similarity at which matching a sentence or leaving it out cost the same.
EPSILON, NULL_SIMILARITY = 0.04, 0.33
#: Rounds of scaling after which it is taken for an error that the transport has not settled.
MOST_ROUNDS = 80_000

_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+(?=\S)")
_CODE = re.compile(r"\w*\d\w*")


def stem(word: str) -> str:
    return word if _CODE.fullmatch(word) else word[:STEM]


def sentences(text: str) -> list[tuple[int, str]]:
    """Sentences with the number of their line; also parts that a semicolon joins. Parts without letters and digits are left out."""
    out = []
    for no, line in enumerate(text.split("\n")):
        parts = _SENTENCE.split(line)
        merged: list[str] = []
        for p in parts:
            # An abbreviation ends no sentence.
            if merged and re.search(r"\b\w{1,2}\.$", merged[-1]) and not merged[-1].endswith(";"):
                merged[-1] += " " + p
            else:
                merged.append(p)
        out += [(no, p) for p in merged if any(c.isalnum() for c in p)]
    return out


def association(entries: DataFrame, source: str, target: str) -> DataFrame:
    """``s, t, w``: for each source word all target stems associated well enough with it, by the Dice coefficient over all one-sentence entries."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)([\p{L}\p{N}]+)"), F.lit(1)))
    words = lambda c: F.filter(tokens(c), lambda x: ~x.rlike(r"\d"))
    one = ~F.contains(F.trim(source), F.lit("\n")) & (F.regexp_count(F.col(source), F.lit(r"[.!?;](\s|$)")) <= 1)
    units = entries.where(one).select(words(F.col(source)).alias("s"), F.array_distinct(F.transform(words(F.col(target)), lambda x: F.left(x, F.lit(STEM)))).alias("t"))
    units = materialize(units.where((F.size("s") > 0) & (F.size("t") > 0)))
    ns = units.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("ns"))
    nt = units.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("nt"))
    both = units.select(F.explode("s").alias("s"), "t").select("s", F.explode("t").alias("t")).groupBy("s", "t").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEN)
    dice = both.join(ns, "s").join(nt, "t").withColumn("w", 2 * F.col("n") / (F.col("ns") + F.col("nt")))
    return dice.where(F.col("w") >= LEAST_DICE).select("s", "t", "w")


def vectors(source: list[str], target: list[str], table: dict[str, list[tuple[str, float]]], weight: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of all source and target sentences of an entry."""
    index: dict[str, int] = {}

    def vector(text: str, spread: bool) -> dict[int, float]:
        v: dict[int, float] = {}
        for w in dict.fromkeys(_TOKEN.findall(text.lower())):
            if _CODE.fullmatch(w):
                items = [("#" + w, 1.5)]
            elif spread:
                items = [(t, x) for t, x in table.get(w, [])]
                norm = sum(x * x for _, x in items) ** 0.5
                items = [(t, weight.get(w, 1.0) * x / norm) for t, x in items]
            else:
                items = [(stem(w), weight.get("=" + stem(w), 1.0))]
            for t, x in items:
                i = index.setdefault(t, len(index))
                v[i] = max(v.get(i, 0.0), x)
        return v

    a, b = [vector(x, True) for x in source], [vector(x, False) for x in target]
    m, n = np.zeros((len(a), len(index))), np.zeros((len(b), len(index)))
    for rows, vs in ((m, a), (n, b)):
        for i, v in enumerate(vs):
            if v:
                rows[i, list(v)] = list(v.values())
    for rows in (m, n):
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return m, n


def transport(sim: np.ndarray, tolerance: float = 1e-3) -> np.ndarray:
    """Entropic transport between sentences of unit mass, with a null sentence on either side that takes what matches nothing.

    Sinkhorn scaling goes on until no sentence's mass is off by more than the tolerance.
    """
    n, m = sim.shape
    cost = np.full((n + 1, m + 1), 1 - NULL_SIMILARITY)
    cost[:n, :m] = 1 - sim
    k = np.exp((cost.min() - cost) / EPSILON)
    columns = np.ascontiguousarray(k.T)
    a, b = np.ones(n + 1), np.ones(m + 1)
    a[n], b[m] = m, n
    u, v = np.ones(n + 1), np.ones(m + 1)
    for _ in range(MOST_ROUNDS // 8):
        for _ in range(8):
            u = a / k.dot(v)
            v = b / columns.dot(u)
        if np.abs(u * k.dot(v) - a).max() <= tolerance:
            return u[:, None] * k * v[None, :]
    raise RuntimeError("the transport did not settle")


def links(sim: np.ndarray, alike_source: np.ndarray | None = None, alike_target: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Sentence pairs that exchange a good part of their mass; a pair that is the best of both sides needs less.

    Merges and splits follow. The other two arguments are the similarities within either side; without them, different sentences of a side have nothing in common.
    """
    if not sim.size:
        return []
    p = transport(sim)[:-1, :-1]
    out = set()
    for i, j in zip(*np.nonzero(p > 0.15)):
        best = p[i, j] >= p[i].max() - 1e-12 and p[i, j] >= p[:, j].max() - 1e-12
        if p[i, j] > 0.5 or best and sim[i, j] > NULL_SIMILARITY or p[i, j] > 0.25 and sim[i, j] > 0.5:
            out.add((int(i), int(j)))
    merged = _joining(sim, np.eye(len(sim)) if alike_source is None else alike_source, out)
    split = _joining(sim.T, np.eye(sim.shape[1]) if alike_target is None else alike_target, {(j, i) for i, j in out})
    return sorted(out | merged | {(i, j) for j, i in split})


def _joining(sim: np.ndarray, alike: np.ndarray, linked: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Links of rows without one to the column that they alone would give most of their mass to, if its group gets more similar to it by them."""
    groups: dict[int, list[int]] = {}
    for i, j in linked:
        groups.setdefault(j, []).append(i)
    free = set(range(len(sim))) - {i for i, _ in linked}
    best = sim.argmax(axis=1)
    share = 1 / (np.exp((sim - sim.max(axis=1, keepdims=True)) / EPSILON).sum(axis=1) + np.exp((NULL_SIMILARITY - sim.max(axis=1)) / EPSILON))
    whole = lambda rows, j: sim[rows, j].sum() / max(1e-9, alike[np.ix_(rows, rows)].sum()) ** 0.5
    out = set()
    for i in sorted(free, key=lambda i: (-sim[i, best[i]], i)):
        j = int(best[i])
        group = groups.setdefault(j, [])
        if share[i] > 0.5 and (not group or whole([*group, i], j) > whole(group, j) + 1e-9):
            group.append(i)
            out.add((i, j))
    return out


def _entries(entries: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """``key, src, tgt, lex`` of entries with more than one source line; ``lex`` has the translations of the entry's own words, those of a word in one string."""
    by_stem = association(entries, source, target).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("l"))
    known = by_stem.select("s", F.array_join(F.col("l")["t"], " ").alias("t"), F.col("l")["w"].alias("w"))
    multi = entries.where(F.contains(source, F.lit("\n")) & F.col(target).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("src"), F.col(target).alias("tgt"))
    words = multi.select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("src"), F.lit(r"(?U)([\p{L}\p{N}]+)"), F.lit(1)))).alias("s"))
    lex = words.join(known, "s").groupBy("key").agg(F.collect_list(F.struct("s", "t", "w")).alias("lex"))
    return multi.join(lex, "key", "left")


def _each(align, kind: str):
    @F.pandas_udf(kind)
    def run(src: pd.Series, tgt: pd.Series, lex: pd.Series) -> pd.Series:
        out = []
        for s, t, x in zip(src, tgt, lex):
            table = {r["s"]: list(zip(r["t"].split(" "), r["w"])) for r in (x if x is not None else ())}
            out.append(align(s, t, table))
        return pd.Series(out)

    return run("src", "tgt", "lex")


def aligned_lines(entries: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """``key, source_line, target_line, similarity`` of linked lines of all entries with more than one source line.

    Lines count from 0. Null, empty or blank sides have no links. The association is learned from all one-sentence
    entries; to each entry go only the translations of its own words, so nothing is held in memory that grows with
    the corpus.
    """
    kind = "array<struct<source_line: int, target_line: int, similarity: double>>"
    found = _entries(entries, key, source, target).withColumn("l", F.explode(_each(align_entry, kind)))
    return found.select("key", "l.source_line", "l.target_line", "l.similarity")


def aligned_groups(entries: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """``key, kind, source_lines, target_lines, similarity``: the lines that links connect, and those without a link.

    Kinds are 1-1, merge, split, n-m, omission (a source line without a target line) and addition (the reverse), which have no similarity.
    """
    kind = "array<struct<kind: string, source_lines: array<int>, target_lines: array<int>, similarity: double>>"
    found = _entries(entries, key, source, target).withColumn("l", F.explode(_each(align_groups, kind)))
    return found.select("key", "l.kind", "l.source_lines", "l.target_lines", "l.similarity")


def align_entry(src: str, tgt: str, table: dict[str, list[tuple[str, float]]]) -> list[dict]:
    a, b = sentences(src), sentences(tgt)
    if not a or not b:
        return []
    # Words in many sentences of the entry tell little apart.
    df: dict[str, int] = {}
    for _, x in a:
        for w in set(_TOKEN.findall(x.lower())):
            df[w] = df.get(w, 0) + 1
    for _, x in b:
        for w in {"=" + stem(w) for w in _TOKEN.findall(x.lower())}:
            df[w] = df.get(w, 0) + 1
    weight = {w: 1 / n**0.5 for w, n in df.items()}
    m, n = vectors([x for _, x in a], [x for _, x in b], table, weight)
    sim = m @ n.T
    best: dict[tuple[int, int], float] = {}
    for i, j in links(sim, m @ m.T, n @ n.T):
        k = (a[i][0], b[j][0])
        best[k] = max(best.get(k, 0.0), float(sim[i, j]))
    return [{"source_line": i, "target_line": j, "similarity": s} for (i, j), s in sorted(best.items())]


def align_groups(src: str, tgt: str, table: dict[str, list[tuple[str, float]]]) -> list[dict]:
    found = align_entry(src, tgt, table)
    of: dict[tuple[str, int], int] = {}
    groups: dict[int, tuple[set[int], set[int], list[float]]] = {}
    for no, r in enumerate(found):
        a, b, s = {r["source_line"]}, {r["target_line"]}, [r["similarity"]]
        for old in {of[x] for x in (("s", r["source_line"]), ("t", r["target_line"])) if x in of}:
            x, y, z = groups.pop(old)
            a, b, s = a | x, b | y, s + z
        groups[no] = a, b, s
        of |= {("s", i): no for i in a} | {("t", j): no for j in b}
    kind = lambda a, b: ("1-1" if b == 1 else "split") if a == 1 else "merge" if b == 1 else "n-m"
    out = [{"kind": kind(len(a), len(b)), "source_lines": sorted(a), "target_lines": sorted(b), "similarity": max(s)} for a, b, s in groups.values()]
    for side, text, name in (("s", src, "omission"), ("t", tgt, "addition")):
        for no in sorted({no for no, _ in sentences(text)}):
            if (side, no) not in of:
                out.append({"kind": name, "source_lines": [no] if side == "s" else [], "target_lines": [no] if side == "t" else [], "similarity": None})
    return out
