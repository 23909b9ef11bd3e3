"""Problem 4: near-duplicate records by exact set similarity, without comparing all pairs.

Grouped prefix join. Words of a record are put in one global order, rarest first. Two records of
n and m words with a Jaccard similarity of t or more share at least t / (1 + t) * (n + m) words,
so they share one among the first few. Records with the same words form a class; classes with
the same prefix and size form a group; groups are joined on a shared prefix word, filtered by
size, by the words that can still follow and by bitmaps, expanded to classes and verified exactly.
A bitmap has the parity of the words that fall on each of its bits: two sets differ in at least as
many words as their bitmaps in bits, so a pair that can't be similar is dropped where it meets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WORD = r"[A-Za-zА-Яа-яЁё0-9]{2,}"
SIMILARITY = 0.8
MIN_WORDS = 40
#: A prefix word of more groups than this is joined in so many parts of its groups (see _joined).
PART_GROUPS = 2_000
#: Words of 64 bits in a bitmap.
BITMAP = 4


def words(text) -> F.Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _least_shared(n, m, t: float) -> F.Column:
    """Smallest overlap of sets of n and m with similarity t; exact for decimal fractions of four digits."""
    a = round(t * 10_000)
    total = (n + m) * F.lit(a)
    return F.ceil(total.cast("double") / F.lit(float(10_000 + a)) - F.lit(1e-9)).cast("int")


def record_classes(records: DataFrame, key: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``key, class_id, n`` of all records with enough words; a class is all records of the same words."""
    w = records.select(F.col(key).alias("key"), words(F.col(text)).alias("w")).where(F.size("w") >= min_words)
    h = F.array_sort(F.transform("w", lambda x: F.xxhash64(x)))
    return w.select("key", "w", F.size("w").alias("n"), F.sha2(F.array_join(F.transform(h, lambda x: x.cast("string")), ","), 256).alias("class_id"))


def _ordered(classes: DataFrame) -> DataFrame:
    """``class_id, n, w``: word hashes, rarest word first, equal counts by hash."""
    one = classes.groupBy("class_id").agg(F.first("w").alias("w"), F.first("n").alias("n"))
    exploded = one.select("class_id", "n", F.explode(F.transform("w", lambda x: F.xxhash64(x))).alias("x"))
    df = exploded.groupBy("x").agg(F.count("*").alias("df"))
    return exploded.join(df, "x").groupBy("class_id").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("df", "x"))), lambda s: s["x"]).alias("w"))


def _bitmap(w) -> list[F.Column]:
    """Columns ``s0, s1, ..`` of a list of word hashes."""
    one = F.lit(1).cast("bigint")
    bit = lambda x: F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))
    here = lambda x, k: F.shiftright(x, 6).bitwiseAND(F.lit(BITMAP - 1)) == k
    parity = lambda k: F.aggregate(w, F.lit(0).cast("bigint"), lambda acc, x: F.when(here(x, k), acc.bitwiseXOR(bit(x))).otherwise(acc))
    return [parity(k).alias(f"s{k}") for k in range(BITMAP)]


def _joined(entries: DataFrame, t: float) -> DataFrame:
    """Pairs of groups ``g1 < g2`` that may hold similar records: sizes and the words that can still be shared allow it.

    Rows are keyed by prefix word and size band; bands are 1 / t wide, so a partner is in the same or the next band.
    A key with very many groups is cut into parts of the right side, each joined in a task of its own. Bitmaps are null in
    groups of several classes, which they don't speak for.
    """
    maps = [f"s{k}" for k in range(BITMAP)]
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / t)) + F.lit(1e-9)).cast("int")
    e = entries.withColumn("band", band)
    load = e.groupBy("x", "band").agg(F.count("*").alias("c"))
    left = e.select("x", F.col("g").alias("g1"), F.col("n").alias("n1"), F.col("pos").alias("p1"), *(F.col(c).alias(f"a{c}") for c in maps), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    parts = load.select("x", "band", F.greatest(F.lit(1), F.ceil(F.col("c") / PART_GROUPS)).cast("int").alias("parts"))
    hot = parts.where("parts > 1")
    left = left.join(hot, ["x", "band"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    right = e.select("x", "band", F.col("g").alias("g2"), F.col("n").alias("n2"), F.col("pos").alias("p2"), *(F.col(c).alias(f"b{c}") for c in maps)).join(hot, ["x", "band"], "left")
    right = right.withColumn("part", F.pmod(F.xxhash64("g2"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    n1, n2, p1, p2 = (F.col(c) for c in ("n1", "n2", "p1", "p2"))
    rest = F.least(n1 - p1, n2 - p2)  # positions count from 0: the shared word and all behind it
    apart = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in maps[1:]), F.bit_count(F.col(f"a{maps[0]}").bitwiseXOR(F.col(f"b{maps[0]}"))))
    near = F.coalesce(n1 + n2 - apart >= 2 * _least_shared(n1, n2, t), F.lit(True))
    smaller_first = (n1 < n2) | ((n1 == n2) & (F.col("g1") <= F.col("g2")))
    return left.join(right, ["x", "band", "part"]).where(smaller_first & (n1 >= F.ceil(n2 * F.lit(t) - F.lit(1e-9))) & (rest >= _least_shared(n1, n2, t)) & near).select("g1", "g2").distinct()


def similar_classes(classes: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """Pairs ``c1, c2, similarity`` of different classes, ``c1 < c2``; exact, no link is lost."""
    o = materialize(_ordered(classes))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(t) - F.lit(1e-9)).cast("int") + 1
    o = o.withColumn("p", F.slice("w", 1, prefix)).withColumn("g", F.struct(F.xxhash64("p", "n"), F.xxhash64("n", "p")))
    o = o.select("class_id", "n", "w", "p", F.concat_ws("/", "g.col1", "g.col2").alias("g"))
    maps = [f"s{k}" for k in range(BITMAP)]
    groups = o.select("g", "n", "p", *_bitmap("w")).groupBy("g").agg(F.first("n").alias("n"), F.first("p").alias("p"), *(F.when(F.count("*") == 1, F.first(c)).alias(c) for c in maps))
    entries = groups.select("g", "n", *maps, F.posexplode("p").alias("pos", "x"))
    pairs = _joined(entries, t)
    member = o.select("g", "class_id", "n", "w")
    left = member.select(F.col("g").alias("g1"), F.col("class_id").alias("a"), F.col("w").alias("wa"), F.col("n").alias("na"))
    right = member.select(F.col("g").alias("g2"), F.col("class_id").alias("b"), F.col("w").alias("wb"), F.col("n").alias("nb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    checked = pairs.join(left, "g1").join(right, "g2").where((F.col("g1") != F.col("g2")) | (F.col("a") < F.col("b"))).withColumn("s", shared)
    sim = F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))
    return checked.where((F.col("a") != F.col("b")) & (F.col("s") >= _least_shared(F.col("na"), F.col("nb"), t))).select(
        F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2"), sim.alias("similarity")
    )


def similar_pairs(records: DataFrame, key: str, text: str, t: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """All pairs ``key_a < key_b, similarity`` of records of at least ``min_words`` distinct words.

    Null texts and texts of fewer words pair with nothing; repeated keys count once for each different text.
    """
    classes = materialize(record_classes(records, key, text, min_words))
    links = similar_classes(classes, t)
    m = classes.select("key", "class_id").distinct()
    apart = links.join(m.select(F.col("class_id").alias("c1"), F.col("key").alias("k1")), "c1").join(m.select(F.col("class_id").alias("c2"), F.col("key").alias("k2")), "c2")
    # Within a class: only classes of several records.
    many = m.join(m.groupBy("class_id").count().where("count > 1").select("class_id"), "class_id", "left_semi")
    same = many.select("class_id", F.col("key").alias("k1")).join(many.select("class_id", F.col("key").alias("k2")), "class_id").where("k1 < k2")
    both = apart.select("k1", "k2", "similarity").unionByName(same.select("k1", "k2", F.lit(1.0).alias("similarity")))
    return both.where("k1 != k2").select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"), "similarity").distinct()


def components(links: DataFrame, a: str = "c1", b: str = "c2", rounds: int = 40) -> DataFrame:
    """``node, component`` (the smallest node of each connected set) by alternating large and small stars.

    Each round is one aggregation of the edges, cut by a checkpoint; the edges stay on the executors.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct()
    edges = materialize(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = materialize(small.select("e.u", "e.v").where("u != v").distinct())
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            break
        edges = new
    else:
        raise RuntimeError("the components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))


def similar_groups(records: DataFrame, key: str, text: str, t: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per record of at least ``min_words`` words: ``key, class_id, group_id, links``.

    ``class_id`` is shared by records of the same words, ``group_id`` by records linked over any chain of similar
    classes, ``links`` counts the similar records of other classes.
    """
    classes = materialize(record_classes(records, key, text, min_words).select("key", "class_id", "w", "n"))
    links = materialize(similar_classes(classes, t))
    comp = components(links)
    size = classes.select("key", "class_id").distinct().groupBy("class_id").agg(F.count("*").alias("members"))
    both = links.select("c1", "c2").unionByName(links.select(F.col("c2").alias("c1"), F.col("c1").alias("c2")))
    count = both.join(size.withColumnRenamed("class_id", "c2"), "c2").groupBy("c1").agg(F.sum("members").alias("links"))
    m = classes.select("key", "class_id").distinct()
    return m.join(comp, m["class_id"] == comp["node"], "left").join(count, m["class_id"] == count["c1"], "left").select(
        "key", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")
    )
