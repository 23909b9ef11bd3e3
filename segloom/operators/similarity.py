"""Fuzzy lookup in the memory: the most similar entries of each query text.

The score is JACCARD_WEIGHT * Jaccard of the token sets + the rest * a sequence ratio. As the ratio is at
most 1, a score of ``least`` or more needs a Jaccard similarity of (least - rest) / JACCARD_WEIGHT, so
candidates come from a prefix-filtered equi-join on rare tokens, which loses none.

Equal token sets are joined once. Each set goes to its rare tokens with all its tokens, as numbers, rarest first,
so a pair is verified where it meets and leaves the join only if it is similar; the first shared token gives it out.
The scored lookup meets texts the same way, in arrays, by what bounds their score, and then scores what may be among the best.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize

JACCARD_WEIGHT = 0.65
#: A token at which more pairs than this meet is joined in parts of its entries; the queries go to each.
PART_PAIRS = 50_000_000
#: Words of 64 bits in a bitmap.
BITMAP = 2
#: Buckets of tokens whose loads order the tokens of the scored lookup; any order loses none.
BUCKETS = 1 << 20
#: Rows of a token, of either side, that are held at once in the scored lookup; more are dealt to parts.
PART_ROWS = 200_000
#: Pairs of a query text that are kept in one row.
RUN = 1_000


def _hash(c) -> F.Column:
    """128 bits of a value."""
    return F.unhex(F.left(F.sha2(c, 256), F.lit(32)))


def _sets(df: DataFrame, key: str, text: str, pattern: str | None = None) -> DataFrame:
    """``k, txt, t, i``: tokens in order, and the number of their set. Of a repeated key the smallest text with tokens counts."""
    one = df.select(F.col(key).alias("k"), F.col(text).alias("txt")).where(F.size(T.tokens("txt", pattern)) > 0).groupBy("k").agg(F.min("txt").alias("txt"))
    return one.withColumn("t", F.array_sort(F.array_distinct(T.tokens("txt", pattern)))).withColumn("i", _hash(F.to_json("t")))


def _classes(sets: DataFrame) -> DataFrame:
    """``i, t``: the different sets, their tokens as numbers."""
    return materialize(sets.groupBy("i").agg(F.first("t").alias("t")).select("i", F.transform("t", lambda x: F.xxhash64(x)).alias("t")))


def _bitmap(w) -> list[F.Column]:
    """Columns ``s0, s1, ..``: the parity of the numbers that fall on each bit."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))
    here = lambda x, k: F.shiftright(x, 6).bitwiseAND(F.lit(BITMAP - 1)) == k
    parity = lambda k: F.aggregate(w, F.lit(0).cast("bigint"), lambda acc, x: F.when(here(x, k), acc.bitwiseXOR(bit(x))).otherwise(acc))
    return [parity(k).alias(f"s{k}") for k in range(BITMAP)]


def _prefixes(classes: DataFrame, df: DataFrame, t: float) -> DataFrame:
    """Each set under its rarest tokens, as many as a partner of similarity t must share one of: ``i, n, w, s0, .., pos, x``.

    ``w`` has its tokens that entries know, rarest first. The others come before them and need no place, but count.
    """
    e = classes.select("i", F.size("t").alias("n"), F.explode("t").alias("x")).join(df, "x")
    w = e.groupBy("i").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("df", "x"))), lambda s: s["x"]).alias("w"))
    unknown = F.col("n") - F.size("w")
    first = (F.col("n") - F.ceil(F.col("n") * F.lit(t) - F.lit(1e-9)) + 1 - unknown).cast("int")
    w = materialize(w.select("i", "n", "w", first.alias("p"), *_bitmap("w")).where("p > 0"))
    at = F.posexplode(F.slice("w", F.lit(1), F.col("p"))).alias("at", "x")
    return w.select("*", at).withColumn("pos", F.col("at") + 1 + unknown).drop("at", "p")


def _similar_sets(q: DataFrame, e: DataFrame, t: float) -> DataFrame:
    """``qi, ei, jaccard`` of all pairs of different sets of queries and of entries with similarity t or more, each once."""
    cq, ce = _classes(q), _classes(e)
    df = ce.select(F.explode("t").alias("x")).groupBy("x").agg(F.count("*").alias("df"))
    maps = [f"s{k}" for k in range(BITMAP)]
    a, b = _prefixes(cq, df, t), _prefixes(ce, df, t)
    load = a.groupBy("x").agg(F.count("*").alias("ca")).join(b.groupBy("x").agg(F.count("*").alias("cb")), "x")
    # Few rows: so many pairs need at least 2 * sqrt(PART_PAIRS) rows of the token.
    meet = F.col("ca").cast("double") * F.col("cb")
    hot = F.broadcast(load.where(meet > PART_PAIRS).select("x", F.least(F.col("cb"), F.ceil(meet / PART_PAIRS)).cast("int").alias("parts")))
    b = b.join(hot, "x", "left").withColumn("part", F.pmod(F.xxhash64("i"), F.coalesce("parts", F.lit(1))).cast("int"))
    b = b.select("x", "part", F.col("i").alias("ei"), F.col("n").alias("m"), F.col("w").alias("we"), F.col("pos").alias("pos_e"), *(F.col(c).alias(f"e{c}") for c in maps))
    a = a.join(hot, "x", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    a = a.select("x", "part", F.col("i").alias("qi"), F.col("n"), F.col("w").alias("wq"), F.col("pos"), *(F.col(c).alias(f"q{c}") for c in maps))
    n, m = F.col("n"), F.col("m")
    least = F.ceil((n + m) * F.lit(t) / F.lit(1 + t) - F.lit(1e-9))
    rest = F.least(n - F.col("pos") + 1, m - F.col("pos_e") + 1)
    # Sets differ in at least as many known tokens as their bitmaps in bits.
    apart = sum((F.bit_count(F.col(f"q{c}").bitwiseXOR(F.col(f"e{c}"))) for c in maps[1:]), F.bit_count(F.col(f"q{maps[0]}").bitwiseXOR(F.col(f"e{maps[0]}"))))
    near = F.size("wq") + m - apart >= 2 * least
    close = (n >= m * F.lit(t) - 1e-9) & (m >= n * F.lit(t) - 1e-9) & (rest >= least) & near
    # Only what is close is intersected. As the similarity can't be null, no filter on it is pushed before that, and the condition stays short enough to be compiled.
    shared = F.array_intersect("wq", "we")
    s = F.size(shared)
    jaccard = s / (n + m - s)
    found = F.when(close, F.when((s >= least) & (jaccard >= t - 1e-12), shared[0] == F.col("x")))
    return b.join(a, ["x", "part"]).where(found).select("qi", "ei", F.coalesce(jaccard, F.lit(0.0)).alias("jaccard"))


def _checked(t: float) -> None:
    if not 0 < t <= 1:
        raise ValueError("a similarity above 0 is needed")


def jaccard_pairs(queries: DataFrame, entries: DataFrame, q_key: str, q_text: str, e_key: str, e_text: str, t: float, pattern: str | None = None) -> DataFrame:
    """``q, e, jaccard`` of all query and entry pairs of token-set similarity t or more. Texts without tokens match nothing."""
    _checked(t)
    q, e = _sets(queries, q_key, q_text, pattern), _sets(entries, e_key, e_text, pattern)
    pairs = _similar_sets(q, e, t)
    full = pairs.join(q.select(F.col("i").alias("qi"), F.col("k").alias("q")), "qi").join(e.select(F.col("i").alias("ei"), F.col("k").alias("e")), "ei")
    return full.select("q", "e", "jaccard")


def jaccard_top_k(queries: DataFrame, entries: DataFrame, q_key: str, q_text: str, e_key: str, e_text: str, t: float, k: int = 3, digits: int = 6, pattern: str | None = None) -> DataFrame:
    """``q, e, jaccard, hit_rank``: the k best of ``jaccard_pairs``, rounded before; ties fall to the smaller entry."""
    _checked(t)
    q, e = _sets(queries, q_key, q_text, pattern), _sets(entries, e_key, e_text, pattern)
    pairs = _similar_sets(q, e, t).withColumn("jaccard", F.round("jaccard", digits))
    best = top_k(pairs.join(_smallest(e, "i", k).withColumnRenamed("i", "ei"), "ei").withColumnRenamed("qi", "q"), "jaccard", k)
    return best.select(F.col("q").alias("i"), "e", "jaccard", "hit_rank").join(q.select("i", F.col("k").alias("q")), "i").select("q", "e", "jaccard", "hit_rank")


def _smallest(rows: DataFrame, by: str, k: int) -> DataFrame:
    """``by, e``: the k smallest keys of each value; as they score the same, no other can be among the k best."""
    w = Window.partitionBy(by).orderBy("k")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(by, F.col("k").alias("e"))


def top_k(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The k best entries of each query; ties fall to the smaller entry."""
    w = Window.partitionBy("q").orderBy(F.col(score).desc(), "e")
    return scored.withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= k)


def ratio(a: str, b: str) -> float:
    """That of the sequence matcher. Without its rule on very frequent elements, which begins at 200 letters, the longest match is found by searches of substrings."""
    if len(b) >= 200 or a == b:
        return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
    matched, parts = 0, [(a, b)]
    while parts:
        x, y = parts.pop()
        at = size = 0  # the longest match, the first in x of those, then the first in y
        for i in range(len(x)):
            if i + size >= len(x):
                break
            while i + size < len(x) and (j := y.find(x[i : i + size + 1])) >= 0:
                at, size = i, size + 1
                while i + size < len(x) and j + size < len(y) and x[i + size] == y[j + size]:
                    size += 1
        if size:
            matched += size
            j = y.find(x[at : at + size])
            if at and j:
                parts.append((x[:at], y[:j]))
            if at + size < len(x) and j + size < len(y):
                parts.append((x[at + size :], y[j + size :]))
    return 2.0 * matched / (len(a) + len(b)) if a or b else 1.0


def _ratios(k: int, least: float, weight: float):
    """``qi, qt, et, jaccard, ratio, score`` of the pairs that may be among the k best of their query text.

    Rows of a query text follow each other. Whatever can't reach the k best texts so far is passed by: the ratio is at most
    the share of letters that both texts have, however they are placed. Wherever the rows of a text are divided, each part keeps its best.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, letters, best = None, Counter(), []
        for b in batches:
            out = []
            for qi, qt, et, j, x, y in zip(b["qi"], b["qt"], b["et"], b["jaccard"], b["tq"], b["te"]):
                if qt != last:
                    last, letters, best = qt, Counter(x), []
                bar = max(least, best[-1] if len(best) == k else least) - 1e-9
                total = len(x) + len(y)
                if j * weight + 2.0 * min(len(x), len(y)) / total * (1 - weight) < bar:
                    continue
                if j * weight + 2.0 * sum((letters & Counter(y)).values()) / total * (1 - weight) < bar:
                    continue
                r = ratio(x, y)
                score = j * weight + r * (1 - weight)
                if score < bar:
                    continue
                best = sorted([*best, score], reverse=True)[:k]
                out.append((qi, qt, et, j, r, score))
            yield pd.DataFrame(out, columns=["qi", "qt", "et", "jaccard", "ratio", "score"])

    return run


def _texts(df: DataFrame, key: str, text: str, pattern: str | None) -> tuple[DataFrame, DataFrame]:
    """``k, h``: the text of each key. ``h, id, txt, t``: each text once, with a number and the numbers of its tokens."""
    one = df.select(F.col(key).alias("k"), F.col(text).alias("txt")).where(F.size(T.tokens("txt", pattern)) > 0).groupBy("k").agg(F.min("txt").alias("txt"))
    rows = materialize(one.select("k", _hash("txt").alias("h"), "txt"))
    each = rows.groupBy("h").agg(F.first("txt").alias("txt"))
    return rows.select("k", "h"), materialize(each.select("h", F.monotonically_increasing_id().alias("id"), "txt", F.array_distinct(F.transform(T.tokens("txt", pattern), lambda x: F.xxhash64(x))).alias("t")))


def _loads(texts: DataFrame) -> np.ndarray:
    """How many texts have tokens of each bucket."""
    bucket = F.explode("t").alias("x")
    found = texts.select(bucket).groupBy(F.col("x").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).agg(F.count("*").alias("c")).toArrow()
    loads = np.zeros(BUCKETS)
    loads[found["b"].to_numpy()] = found["c"].to_numpy()
    return loads


MET = "x long, part int, side int, id long, n int, pos int, len int, sig binary"


def _signed(side: int, loads: tuple[np.ndarray, np.ndarray], t: float, part_rows: int):
    """Each text under its rarest tokens, as many as a partner of similarity t must share one of; tokens that only one side has come before them.

    ``sig`` has the parity of the tokens that fall on each of 256 bits and the counts of the letters that fall on each of 32 places, up to 255.
    """
    both, parts = loads[0] * loads[1], [np.maximum(1, np.ceil(x / part_rows)).astype(np.int64) for x in loads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, arrays, txt = batch["id"].to_numpy(), batch["t"], batch["txt"].to_pylist()
            x, n = arrays.flatten().to_numpy(), arrays.value_lengths().to_numpy().astype(np.int64)
            own, u = np.repeat(np.arange(len(n)), n), x.view(np.uint64)
            bits = np.zeros(4 * len(n), np.uint64)
            np.bitwise_xor.at(bits, own * 4 + (u >> np.uint64(62)).astype(np.int64), np.uint64(1) << (u >> np.uint64(56) & np.uint64(63)))
            size = np.fromiter(map(len, txt), np.int64, len(txt))
            letters = np.frombuffer("".join(txt).encode("utf-32-le"), np.uint32) & 31
            counts = np.bincount(np.repeat(np.arange(len(n)) * 32, size) + letters, minlength=32 * len(n)).clip(0, 255).astype(np.uint8)
            sig = np.concatenate([bits.view(np.uint8).reshape(-1, 32), counts.reshape(-1, 32)], axis=1)
            rank = both[x & (BUCKETS - 1)]
            order = np.lexsort((x, rank, own))
            x, rank = x[order], rank[order]
            pos = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            keep = np.flatnonzero((rank > 0) & (pos < (n - np.ceil(n * t - 1e-9) + 1)[own]))
            mine, other = (parts[k][x[keep] & (BUCKETS - 1)] for k in (side, 1 - side))
            keep, here = np.repeat(keep, other), np.arange(other.sum()) - np.repeat(np.cumsum(other) - other, other)
            mine, other = np.repeat(mine, other), np.repeat(other, other)
            i, deal = own[keep], ids[own[keep]] % mine
            part = deal * other + here if side == 0 else here * mine + deal
            yield pa.record_batch([pa.array(c) for c in (x[keep], part.astype(np.int32), np.full(len(i), side, np.int32), ids[i], n[i].astype(np.int32), pos[keep].astype(np.int32), size[i].astype(np.int32))] + [pa.array(map(bytes, sig[i]), pa.binary())], names=[f.split()[0] for f in MET.split(", ")])

    return run


def _meet(t: float, least: float, weight: float, rows_at_once: int = 200_000):
    """``qi, ei, bound`` of the texts that meet at a token and may reach the least score: at most the tokens whose bits agree are shared, and at most the letters that both have match."""

    def near(a, b, i, k, pop):
        n, m, total = a["n"][i], b["n"][k], a["len"][i] + b["len"][k]
        s = np.minimum((n + m - pop) // 2, np.minimum(n, m))
        j = weight * s / (n + m - s)
        ok = np.flatnonzero(j + (1 - weight) * 2 * np.minimum(a["len"][i], b["len"][k]) / total >= least - 1e-9)
        i, k = i[ok], k[ok]
        apart = np.abs(a["letters"][i] - b["letters"][k]).sum(1, dtype=np.int32)
        bound = j[ok] + (1 - weight) * (1 - apart / total[ok])
        ok = np.flatnonzero(bound >= least - 1e-9)
        return a["id"][i[ok]], b["id"][k[ok]], bound[ok]

    def needed(n, m):
        return np.ceil((n + m) * (t / (1 + t)) - 1e-9)

    def few(a, b):
        n, m = a["n"][:, None], b["n"]
        i, k = np.nonzero((n >= m * t - 1e-9) & (m >= n * t - 1e-9) & (np.minimum(n - a["pos"][:, None], m - b["pos"]) >= needed(n, m)))
        pop = np.bitwise_count(a["bits"][i] ^ b["bits"][k]).sum(1, dtype=np.int64)
        ok = np.flatnonzero(a["n"][i] + m[k] - pop >= 2 * needed(a["n"][i], m[k]))
        yield near(a, b, i[ok], k[ok], pop[ok])

    def many(a, b, begins):
        for lo, hi in zip(begins, [*begins[1:], len(a["n"])]):  # of one size and place
            n, at = a["n"][lo], a["pos"][lo]
            first, last = np.searchsorted(b["n"], n * t - 1e-9), np.searchsorted(b["n"], n / t + 1e-9, "right")
            m = b["n"][first:last]
            least_shared = needed(n, m)
            own = np.flatnonzero(np.minimum(n - at, m - b["pos"][first:last]) >= least_shared)
            if not len(own):
                continue
            most = (n + m[own] - 2 * least_shared[own]).clip(0, 255).astype(np.uint8)
            own += first
            words = np.ascontiguousarray(b["bits"][own].T)
            step = max(1, 50_000 // len(own))
            for c in range(lo, hi, step):
                f = a["bits"][c : min(hi, c + step)]
                pop = np.bitwise_count(f[:, :1] ^ words[0])
                for w in (1, 2, 3):
                    pop += np.bitwise_count(f[:, w : w + 1] ^ words[w])  # 256 becomes 0, which loses none
                i, k = np.nonzero(pop <= most)
                if len(i):
                    yield near(a, b, i + c, own[k], pop[i, k].astype(np.int64))

    def columns(rows: pa.Table) -> dict[str, np.ndarray]:
        c = {k: rows[k].to_numpy().astype(np.int64) for k in ("x", "part", "side", "id", "n", "pos", "len")}
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(-1, 64)
        c |= {"bits": np.ascontiguousarray(sig[:, :32]).view(np.uint64), "letters": sig[:, 32:].astype(np.int16)}
        order = np.lexsort((c["pos"], c["n"], c["side"], c["part"], c["x"]))
        return {k: v[order] for k, v in c.items()}

    def met(c):
        new = np.flatnonzero(np.diff(c["x"], prepend=c["x"][:1] - 1) | np.diff(c["part"], prepend=-1))
        for lo, hi in zip(new, [*new[1:], len(c["x"])]):
            mid = lo + np.searchsorted(c["side"][lo:hi], 1)
            if lo == mid or mid == hi:
                continue
            a, b = ({k: v[s] for k, v in c.items()} for s in (slice(lo, mid), slice(mid, hi)))
            begins = np.flatnonzero(np.diff(a["n"], prepend=-1) | np.diff(a["pos"], prepend=-1))
            yield from few(a, b) if (mid - lo) * (hi - mid) <= 1000 * len(begins) else many(a, b, begins)

    def out(found):
        found = [f for f in found if len(f[0])]
        if found:
            qi, ei, bound = map(np.concatenate, zip(*found))
            order = np.lexsort((ei, qi))
            qi, ei, bound = qi[order], ei[order], bound[order]
            one = np.flatnonzero(np.append(True, (np.diff(qi) != 0) | (np.diff(ei) != 0)))
            yield pa.record_batch([pa.array(v[one]) for v in (qi, ei, bound)], names=["qi", "ei", "bound"])

    def gathered(c):
        """Pairs of many tokens, a pair once; no more are kept than a million and those of one step."""
        found, n = [], 0
        for f in met(c):
            found.append(f)
            n += len(f[0])
            if n > 1_000_000:
                yield from out(found)
                found, n = [], 0
        yield from out(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by token and part; the last token of what is there may go on."""
        held, n, enough = [], 0, rows_at_once
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= enough:
                rows = pa.Table.from_batches(held)
                x, part = rows["x"].to_numpy(), rows["part"].to_numpy()
                goes_on = np.flatnonzero((x != x[-1]) | (part != part[-1]))
                whole = goes_on[-1] + 1 if len(goes_on) else 0
                if whole:
                    yield from gathered(columns(rows.slice(0, whole)))
                held, n = rows.slice(whole).to_batches(), rows.num_rows - whole
                enough = max(rows_at_once, 2 * n)
        if n:
            yield from gathered(columns(pa.Table.from_batches(held)))

    return run


def hybrid_top_k(queries: DataFrame, entries: DataFrame, q_key: str, q_text: str, e_key: str, e_text: str, k: int = 3, least: float = 0.75, mode: str = "hybrid", pattern: str | None = None) -> DataFrame:
    """``q, e, jaccard, ratio, score, hit_rank``. The ratio takes the query first and keeps the matcher's rule on very frequent elements.

    Mode ``sequence`` scores by the ratio alone, over the pairs that share a token and whose lengths allow the least score; any other
    mode is ``hybrid``. ``pattern`` is that of the tokens (the default one if it is none). Equal texts are compared once.
    """
    alone = mode == "sequence"
    need = 0.0 if alone else (least - (1 - JACCARD_WEIGHT)) / JACCARD_WEIGHT
    weight = 0.0 if alone else JACCARD_WEIGHT
    _checked(t := max(need, 1e-6))
    (q, tq), (e, te) = _texts(queries, q_key, q_text, pattern), _texts(entries, e_key, e_text, pattern)
    loads = _loads(tq), _loads(te)
    a, b = (x.select("id", "t", "txt").mapInArrow(_signed(side, loads, t, PART_ROWS), MET) for side, x in enumerate((tq, te)))
    met = a.unionByName(b).repartition("x", "part").sortWithinPartitions("x", "part").mapInArrow(_meet(t, least, weight), "qi long, ei long, bound double")
    w = Window.partitionBy("qi").orderBy(F.col("bound").desc(), "ei")
    ranked = met.repartition("qi").groupBy("qi", "ei").agg(F.first("bound").alias("bound")).withColumn("r", F.row_number().over(w) - 1)
    # Kept as short arrays, which take a third of the room.
    packed = ranked.groupBy("qi", F.floor(F.col("r") / RUN).alias("c")).agg(F.array_sort(F.collect_list(F.struct("r", "ei", "bound"))).alias("s"))
    packed = materialize(packed.select("qi", "c", F.col("s.ei").alias("ei"), F.col("s.bound").alias("bound")))
    near = packed.select("qi", "c", F.posexplode(F.arrays_zip("ei", "bound")).alias("r", "s")).select("qi", "s.ei", "s.bound", (F.col("c") * RUN + F.col("r")).alias("r"))
    tq, te = (x.select(F.col("id").alias(i), F.col("h").alias(h), F.col("txt").alias(c)) for x, i, h, c in ((tq, "qi", "qt", "tq"), (te, "ei", "et", "te")))

    def scored(pairs: DataFrame) -> DataFrame:
        # Tokens are taken from the texts again, as they are larger than those.
        full = pairs.join(te, "ei").join(tq, "qi").withColumns({s: F.array_distinct(T.tokens(c, pattern)) for s, c in (("sq", "tq"), ("se", "te"))})
        full = full.withColumn("s", F.size(F.array_intersect("sq", "se"))).withColumn("jaccard", F.col("s") / (F.size("sq") + F.size("se") - F.col("s")))
        texts = full.sortWithinPartitions("qt", F.col("bound").desc()).select("qt", "et", "jaccard", "tq", "te", "qi")
        return texts.mapInPandas(_ratios(k, least, weight), "qi long, qt binary, et binary, jaccard double, ratio double, score double").where(F.col("score") >= least)

    # The k pairs of the highest bounds come first; of the others only those whose bound reaches the k-th score so far.
    top = materialize(scored(near.where(F.col("r") < k)))
    bar = top.groupBy("qi").agg(F.count("*").alias("c"), F.min("score").alias("bar")).where(F.col("c") >= k).drop("c")
    rest = scored(near.where(F.col("r") >= k).join(bar, "qi", "left").where(F.col("bound") >= F.coalesce("bar", F.lit(least)) - 1e-9).select("qi", "ei", "bound"))
    hits = top.unionByName(rest)
    best = top_k(hits.join(_smallest(e, "h", k).withColumnRenamed("h", "et"), "et").withColumnRenamed("qt", "q"), "score", k)
    full = best.withColumnRenamed("q", "h").join(q.select("h", F.col("k").alias("q")), "h")
    return full.select("q", "e", "jaccard", "ratio", "score", "hit_rank")
