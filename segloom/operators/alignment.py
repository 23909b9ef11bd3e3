"""Aligning two versions of documents: informative tokens, weighted cosine, overlap, and monotone mappings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that tell no sections apart.
STOP = (
    "safran", "landing", "systems", "uk", "ltd", "код", "cage", "k0654", "руководство", "техническому", "обслуживанию", "компонентов", "стойка", "основного", "шасси", "mar", "2025", "18",
)
#: Parts that the keys of a token are dealt to.
PARTS = 16


def section_tokens(sections: DataFrame, key: str, text: str) -> DataFrame:
    """``key, token, tf``: tokens of letters and digits in lower case, without stop words and single letters."""
    t = F.filter(F.split(F.lower(text), "[^0-9A-Za-zЀ-ӿ]+"), lambda x: (F.length(x) > 1) | x.rlike("^[0-9]$"))
    e = sections.select(F.col(key).alias("key"), F.explode(t).alias("token")).where(~F.col("token").isin(*STOP))
    return e.groupBy("key", "token").agg(F.count("*").alias("tf"))


def counted_tokens(sections: DataFrame, key: str, text: str) -> DataFrame:
    """``key, token, tf``: tokens between signs that are neither letters nor digits, in lower case; single ones count only as digits."""
    t = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: (F.length(x) > 1) | x.rlike(r"^\p{Nd}$"))
    return sections.select(F.col(key).alias("key"), F.explode(t).alias("token")).groupBy("key", "token").agg(F.count("*").alias("tf"))


def weighted(left: DataFrame, right: DataFrame, total: Column | int) -> tuple[DataFrame, DataFrame]:
    """Both token tables with ``w`` = tf * boost * idf of informative tokens: rare ones, or not too frequent ones of two signs."""
    df = left.select("token").unionByName(right.select("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)) + 1
    keep = (F.col("df") <= 2) | ((F.col("df") <= 0.25 * total) & (F.length("token") >= 2))
    number = F.when(F.col("token").rlike("^[0-9]{1,9}$"), F.col("token").try_cast("int"))
    boost = F.when(F.col("token").startswith("рисунок") | F.col("token").startswith("лист"), 2.0).when(number.between(500, 999), 1.5).otherwise(1.0)
    w = df.where(keep).select("token", (idf * boost).alias("iw"))
    return tuple(x.join(w, "token").select("key", "token", (F.col("tf") * F.col("iw")).alias("w")) for x in (left, right))


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """The join on the token. The right side's keys are dealt to PARTS parts of each token, and the left side, the stated set of queries, goes to each, so a word that all texts hold is no task of its own."""
    a = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return a.join(right.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int")), ["token", "part"])


def cosine(left: DataFrame, right: DataFrame, least: float = 0.0) -> DataFrame:
    """``a, b, cosine`` of all pairs that share a token and reach the least similarity; others are 0 or below it.

    The left side is the stated set of queries, held against all of the right one: products are summed where a text's tokens
    are, before the shuffle, so what is shuffled is at most one row for each query and text that share a token.
    """
    def unit(x: DataFrame, k: str, v: str) -> DataFrame:
        one = x.groupBy("key").agg(F.collect_list(F.struct("token", "w")).alias("v"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"]))
        return one.withColumn("norm", norm).where("norm > 0").select(F.col("key").alias(k), "norm", F.explode("v").alias("e")).select(k, "e.token", (F.col("e.w") / F.col("norm")).alias(v))

    dot = _meet(unit(left, "a", "x"), unit(right, "b", "y")).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
    return dot.where(F.col("cosine") >= least - 1e-9) if least > 0 else dot


def overlap_f1(left: DataFrame, right: DataFrame, least: float = 0.0) -> DataFrame:
    """``a, b, f1``: harmonic mean of precision and recall of the shared token multiset, of all pairs that share a token and reach the least value.

    Of sizes n and m at most the smaller one is shared, so pairs of too different sizes are left out as they meet.
    """
    def sized(x: DataFrame, k: str, t: str, n: str) -> DataFrame:
        one = x.groupBy("key").agg(F.collect_list(F.struct("token", "tf")).alias("v"), F.sum("tf").alias(n))
        return one.select(F.col("key").alias(k), n, F.explode("v").alias("e")).select(k, "e.token", F.col("e.tf").alias(t), n)

    a, b = sized(left, "a", "ta", "na"), sized(right, "b", "tb", "nb")
    n = F.col("na") + F.col("nb")
    near = _meet(a, b).where(2.0 * F.least("na", "nb") >= least * n - 1e-9)
    s = near.groupBy("a", "b").agg(F.sum(F.least("ta", "tb")).alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    f1 = s.select("a", "b", (2.0 * F.col("s") / n).alias("f1"))
    return f1.where(F.col("f1") >= least) if least > 0 else f1


def monotone_map(sim: np.ndarray, drift: float = 0.0015, gap: float = 0.01) -> list[int]:
    """For each row a strictly later column than the one before; the sum of similarities less drift and gaps is largest, of equal ones the earliest.

    Columns count from 0; row i is expected near column ``(i + 1) * m / n - 1``. Needs as many columns as rows.
    """
    n, m = sim.shape
    if n > m:
        raise ValueError("more rows than columns")
    place = np.arange(m)
    best, back = np.full((n, m), -math.inf), np.zeros((n, m), dtype=int)
    for i in range(n):
        gain = sim[i] - drift * np.abs(place + 1 - (i + 1) * m / n)
        here = slice(i, m - (n - 1 - i))
        if i == 0:
            best[i, here] = gain[here]
            continue
        # The best column before, less the gap up to here: a running maximum of what does not depend on here.
        lead = best[i - 1] + gap * place
        at = np.maximum.accumulate(np.where(lead > np.concatenate([[-math.inf], np.maximum.accumulate(lead)[:-1]]), place, 0))
        back[i, 1:] = at[:-1]
        best[i, here] = (lead[back[i]] - gap * (place - 1) + gain)[here]
    out = [int(best[n - 1].argmax())]
    for i in range(n - 1, 0, -1):
        out.append(int(back[i, out[-1]]))
    return out[::-1]


def grouped_map(base: list[dict[str, int]], overlay: list[dict[str, int]], weight: float = 0.002) -> list[list[int]]:
    """For each overlay page its run of base sections: as many as make the overlap largest, less a little for being off the average length of those left.

    Each later page keeps one section; pages for which none is left have no sections, and the last one takes all that remain.
    """
    out, at = [], 0
    for i, page in enumerate(overlay):
        later, left = len(overlay) - i - 1, len(base) - at
        if left <= later or left <= 0:
            out.append([])
            continue
        average = left / (later + 1)
        if not later:
            take = left
        elif not page:
            take = max(1, min(left - later, round(average)))
        else:
            sizes = np.arange(1, left - later + 1)
            take = int(sizes[np.argmax(_running_f1(base[at : at + len(sizes)], page) - weight * np.abs(sizes - average))])
        out.append(list(range(at, at + take)))
        at += take
    if overlay and at < len(base):
        out[-1] += range(at, len(base))
    return out


greedy_map = grouped_map


def _running_f1(sections: list[dict[str, int]], page: dict[str, int]) -> np.ndarray:
    """The overlap of a page with the first section, the first two and so on."""
    seen: dict[str, int] = {}
    shared = total = 0
    size, out = sum(page.values()), []
    for s in sections:
        for w, n in s.items():
            k = seen.get(w, 0)
            shared += min(page.get(w, 0), k + n) - min(page.get(w, 0), k)
            seen[w] = k + n
            total += n
        out.append(2 * shared / (total + size) if shared else 0.0)
    return np.array(out)


def grouped(pairs: DataFrame) -> DataFrame:
    """``pair, row, columns``: the sections of each overlay page. ``pairs`` has ``pair, side`` (``base`` or ``overlay``), ``no, tokens`` (a map of counts); one pair is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = lambda x: [dict(t) for t in pdf[pdf["side"] == x].sort_values("no")["tokens"]]
        got = grouped_map(side("base"), side("overlay"))
        return pd.DataFrame({"pair": pdf["pair"].iloc[0], "row": range(len(got)), "columns": got})

    return pairs.groupBy("pair").applyInPandas(run, "pair string, row int, columns array<int>")


def page_mapping(mode: str):
    """The mapping of a mode: ``greedy_group`` or ``dp_one_to_one``; an error for any other."""
    modes = {"greedy_group": grouped_map, "dp_one_to_one": monotone_map}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}")
    return modes[mode]


def aligned(pairs: DataFrame, similarity: DataFrame) -> DataFrame:
    """``pair, row, column``: the monotone mapping of each pair of documents. ``pairs`` has ``pair, rows, columns``, ``similarity`` ``pair, row, column, s``; one pair is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m = int(pdf["rows"].iloc[0]), int(pdf["columns"].iloc[0])
        sim = np.zeros((n, m))
        k = pdf.dropna(subset=["row"])
        sim[k["row"].astype(int), k["column"].astype(int)] = k["s"]
        got = monotone_map(sim) if 0 < n <= m else []
        return pd.DataFrame({"pair": pdf["pair"].iloc[0], "row": range(len(got)), "column": got})

    return pairs.join(similarity, "pair", "left").groupBy("pair").applyInPandas(run, "pair string, row int, column int")
