"""Operators on ordered rows: neighbours, rings, budgets and greedy packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

OVERHEAD = 128
BLOCK = 2_000


def neighbours(rows: DataFrame, group: str, order: list[str], text: str, limit: int = 0, in_table: str | None = None) -> DataFrame:
    """The compacted text before and after each row with a Latin letter; null for other rows, at the ends and for blank texts.

    Texts take at most ``limit`` characters, 220 without one, in tables at most 100.
    """
    w = Window.partitionBy(group).orderBy(*order)
    most, gate = limit if limit > 0 else 220, T.has_latin(text)
    table = F.coalesce(F.col(in_table), F.lit(False)) if in_table else F.lit(False)

    def snippet(near):
        cut = F.when(table, T.compact(near, min(most, 100))).otherwise(T.compact(near, most))
        return F.when(gate & (F.length(cut) > 0), cut)

    r = rows.withColumn("_before", F.lag(text).over(w)).withColumn("_after", F.lead(text).over(w))
    return r.withColumn("prev_text", snippet(F.col("_before"))).withColumn("next_text", snippet(F.col("_after"))).drop("_before", "_after")


def recent(rows: DataFrame, group: str, order: list[str], value, size: int = 6) -> DataFrame:
    """The last ``size`` values before each row, oldest first."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-size, -1)
    return rows.withColumn("recent", F.collect_list(value).over(w))


def carry_forward(rows: DataFrame, group: str, order: list[str], value, name: str) -> DataFrame:
    """The last non-null value up to each row."""
    return rows.withColumn(name, F.last(value, True).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def within_budget(rows: DataFrame, group: str, order: list[str], cost, budget: int) -> DataFrame:
    """The rows of each group before the first that overflows the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).withColumn("_bad", F.max((F.col("running") > budget).cast("int")).over(w)).where("_bad = 0").drop("_bad")


def page_chunks(rows: DataFrame, group: str, page: str, seq: str, pages: int, fallback: int, least: float = 0.7) -> DataFrame:
    """Chunk labels: windows of ``pages`` distinct pages where enough rows have one (rows without are dropped), else windows of ``fallback`` rows.

    The page ranks are made on the distinct pages, and row places only where the fallback is taken.
    """
    stat = rows.groupBy(group).agg(F.count("*").alias("_n"), F.count(page).alias("_p"))
    stat = stat.withColumn("_by_page", F.col("_p") >= F.greatest(F.lit(1), (F.col("_n") * least).cast("int")))
    r = rows.join(stat.select(group, "_by_page"), group)
    distinct = rows.where(F.col(page).isNotNull()).select(group, page).distinct()
    rank = distinct.withColumn("_c", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(page)) - 1) / pages))
    label = rank.groupBy(group, "_c").agg(F.min(page).alias("_a"), F.max(page).alias("_b"))
    ranked = rank.join(label, [group, "_c"]).select(group, page, F.concat_ws("_", F.lit("pages"), "_a", "_b").alias("chunk_id"))
    paged = r.where("_by_page").join(ranked, [group, page])
    k = F.floor((F.row_number().over(Window.partitionBy(group).orderBy(seq)) - 1) / fallback)
    plain = r.where("not _by_page").withColumn("_k", k)
    size = plain.groupBy(group, "_k").agg(F.count("*").alias("_m"))
    plain = plain.join(size, [group, "_k"]).withColumn("chunk_id", F.concat_ws("_", F.lit("segments"), F.col("_k") * fallback + 1, F.col("_k") * fallback + F.col("_m"))).drop("_k", "_m")
    return paged.select(*rows.columns, "chunk_id").unionByName(plain.select(*rows.columns, "chunk_id"))


def next_starts(costs: list[int], most: int, limit: int, first: int) -> list[int]:
    """Starts of the greedy groups of a list from ``first`` on, the first start behind the list's end included as it falls."""
    out, i, n = [], first, len(costs)
    while i < n:
        out.append(i)
        load, j = 0, i
        while j < n and j - i < most and (j == i or load + costs[j] <= limit):
            load += costs[j]
            j += 1
        i = j
    return [*out, i]


def greedy_groups(rows: DataFrame, group: str, seq: str, text: str, most: int, limit: int, least: int = 0) -> DataFrame:
    """As greedy_groups_by, with one ``most`` and one ``limit`` for all groups."""
    return greedy_groups_by(rows.withColumn("most", F.lit(most)).withColumn("limit", F.lit(limit)), group, seq, text, least)


def greedy_groups_by(rows: DataFrame, group: str, seq: str, text: str, least: int = 0) -> DataFrame:
    """``group, seq, group_no``: a new group starts when the item count or the costs (length, at least ``least``, + OVERHEAD) would overflow; the first item always fits.

    The fold is sequential, but a group has at most ``most`` items, so within a block of BLOCK items there are at most
    ``most`` places where its first group can start. Each block is folded from all of these at once, with the first
    ``most`` items of the next block as look-ahead; the tables of the blocks are then composed in order. No task sees
    more of a group than one block, except for its few numbers a block. ``seq`` is a running number in the group.
    """
    cost = F.greatest(F.lit(least), F.coalesce(F.length(text), F.lit(0))) + OVERHEAD
    # ``most`` items and a load of ``limit``, columns that are the same within a group.
    place = rows.select(F.col(group).alias("g"), F.col(seq).alias("seq"), cost.alias("cost"), F.greatest(F.lit(1), F.col("most").cast("int")).alias("most"), F.col("limit").cast("int").alias("limit"))
    # Places without gaps: a count of each block of seq values, then the place within the block.
    place = place.withColumn("b0", F.floor(F.col("seq") / BLOCK))
    base = place.groupBy("g", "b0").agg(F.count("*").alias("n"))
    base = base.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("b0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("g", "b0").orderBy("seq")) - 1
    place = place.withColumn("_i", inner).join(base.drop("n"), ["g", "b0"]).withColumn("i", F.col("base") + F.col("_i")).select("g", "seq", "cost", "most", "limit", "i")
    own = place.withColumn("b", F.floor(F.col("i") / BLOCK))
    ahead = own.where((F.col("i") % BLOCK < F.col("most")) & (F.col("b") > 0)).withColumn("b", F.col("b") - 1)
    item = F.struct("i", "cost")
    blocks = own.groupBy("g", "b").agg(F.array_sort(F.collect_list(item)).alias("own"), F.max("most").alias("most"), F.max("limit").alias("limit")).join(ahead.groupBy("g", "b").agg(F.array_sort(F.collect_list(item)).alias("ahead")), ["g", "b"], "left")

    @F.pandas_udf("struct<exits: array<int>, counts: array<int>>")
    def fold(own_: pd.Series, ahead_: pd.Series, most_: pd.Series, limit_: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, most, limit in zip(own_, ahead_, most_, limit_):
            costs = [x["cost"] for x in a] + ([x["cost"] for x in b] if b is not None else [])
            n, exits, number = len(a), [], []
            for first in range(most):
                starts = next_starts(costs, most, limit, first) if first < n else [first]
                inside = [s for s in starts if s < n]
                exits.append(int(next((s for s in starts if s >= n), n)) - n)
                number.append(len(inside))
            out.append((exits, number))
        return pd.DataFrame(out, columns=["exits", "counts"])

    table = blocks.select("g", "b", fold("own", "ahead", "most", "limit").alias("t")).select("g", "b", "t.exits", "t.counts")
    # Compose: where the first group of each block starts, and how many groups there were before. One row a document, of a few numbers a block.
    chain = table.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("b", "exits", "counts"))).alias("c"))

    @F.pandas_udf("array<struct<b: bigint, at: int, no: int>>")
    def compose(c: pd.Series) -> pd.Series:
        out = []
        for blocks_ in c:
            at = no = 0
            got = []
            for x in blocks_:
                got.append({"b": x["b"], "at": at, "no": no})
                at, no = int(x["exits"][at]), no + int(x["counts"][at])
            out.append(got)
        return pd.Series(out)

    entry = chain.select("g", F.explode(compose("c")).alias("e")).select("g", "e.b", F.col("e.at").alias("at"), F.col("e.no").alias("no"))

    @F.pandas_udf("array<int>")
    def number(own_: pd.Series, ahead_: pd.Series, at: pd.Series, no: pd.Series, most_: pd.Series, limit_: pd.Series) -> pd.Series:
        out = []
        for a, b, first, before, most, limit in zip(own_, ahead_, at, no, most_, limit_):
            costs = [x["cost"] for x in a] + ([x["cost"] for x in b] if b is not None else [])
            n, starts = len(a), set(next_starts(costs, most, limit, int(first)))
            got, k = [], int(before) - 1
            for i in range(n):
                k += i in starts
                got.append(k)
            out.append(got)
        return pd.Series(out)

    done = blocks.join(entry, ["g", "b"]).withColumn("no", number("own", "ahead", "at", "no", "most", "limit"))
    flat = done.select("g", F.explode(F.arrays_zip(F.transform("own", lambda x: x["i"]).alias("i"), F.col("no"))).alias("z")).select("g", F.col("z.i").alias("i"), F.col("z.no").alias("group_no"))
    return place.join(flat, ["g", "i"]).select(F.col("g").alias(group), F.col("seq").alias(seq), "group_no")


def request_counts(rows: DataFrame, group: str, seq: str, text: str, most: int, limit: int) -> DataFrame:
    """``group, requests``: how many groups greedy_groups forms, each item costing at least one character."""
    return greedy_groups(rows, group, seq, text, max(1, most), max(1, limit), 1).groupBy(group).agg((F.max("group_no") + 1).alias("requests"))


def within_line_budget(rows: DataFrame, group: str, order: list, source: str, target: str, budget: int, limit: int = 180) -> DataFrame:
    """Rows of each group whose lines ``source => target`` of compacted texts fit the budget, up to the first that doesn't; a line costs its characters and one more.

    Rows with a blank side don't count. A budget of 0 sets no bound. ``line`` is the line.
    """
    side = lambda c: T.compact(T.strip_markers(F.coalesce(c, F.lit(""))), limit)
    r = rows.withColumn("_s", side(source)).withColumn("_t", side(target)).where("_s != '' and _t != ''").withColumn("line", F.concat("_s", F.lit(" => "), "_t")).drop("_s", "_t")
    return within_budget(r, group, order, F.length("line") + 1, budget) if budget > 0 else r


def _put(acc: Column, piece: Column, limit: int, joint: str) -> Column:
    """The lists of finished texts and the open one with a piece that goes on it if it fits, or closes it."""
    open_, all_ = acc["open"], acc["all"]
    joined = F.concat(open_, F.lit(joint), piece)
    fits = F.length(joined) <= limit
    return F.when(open_ == "", F.struct(all_.alias("all"), piece.alias("open"))).when(fits, F.struct(all_.alias("all"), joined.alias("open"))).otherwise(F.struct(F.concat(all_, F.array(open_)).alias("all"), piece.alias("open")))


def _folded(pieces: Column, limit: int, joint: str) -> Column:
    empty = F.struct(F.array().cast("array<string>").alias("all"), F.lit("").alias("open"))
    return F.aggregate(pieces, empty, lambda acc, x: _put(acc, x, limit, joint), lambda acc: F.when(acc["open"] == "", acc["all"]).otherwise(F.concat(acc["all"], F.array(acc["open"]))))


def split_chunks(text: Column | str, limit: int = 3800) -> Column:
    """Chunks of whole lines up to the limit; of a longer line each ``limit`` characters are a chunk, and its end goes on as a line does. Their concatenation is the text; none for empty and null texts."""
    lines = F.regexp_extract_all(F.coalesce(T.col(text), F.lit("")), F.lit(r"[^\n]*\n|[^\n]+$"), F.lit(0))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / limit).cast("int")), lambda i: F.substring(x, i * limit + 1, F.lit(limit)))
    return _folded(F.flatten(F.transform(F.filter(lines, lambda x: x != ""), cut)), limit, "")


def soft_wrap(text: Column | str, width: int = 34) -> Column:
    """Words in lines of at most ``width`` characters, longer words in lines of their own; texts of fewer than four words or with a line break stay."""
    t = T.col(text)
    words = F.filter(F.split(t, rf"{T.WS}+"), lambda x: x != "")
    return F.when((F.size(words) < 4) | t.contains("\n"), t).otherwise(F.array_join(_folded(words, width, " "), "\n"))


def distribute(text: Column | str, lengths: Column) -> Column:
    """The text cut in proportion to the lengths (those below 0 count 0), ends rounded half to even, the last piece taking the rest; one piece without lengths, and all in the first if none is above 0."""
    t, n = T.col(text), F.size(lengths)
    real = F.transform(lengths, lambda x: F.greatest(F.lit(0), x))
    total = F.aggregate(real, F.lit(0).cast("bigint"), lambda a, x: a + x)
    ends = F.transform(real, lambda _, i: F.when(i + 1 == n, F.length(t)).otherwise(F.bround(F.length(t) * F.aggregate(F.slice(real, 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x) / total).cast("int")))
    cuts = F.transform(ends, lambda e, i: F.substring(t, F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)) + 1, e - F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))))
    return F.when(n == 0, F.array(t)).when(total == 0, F.transform(lengths, lambda _, i: F.when(i == 0, t).otherwise(""))).otherwise(cuts)


def toc_pieces(text: Column | str) -> Column:
    """``text, core`` of a contents line, cut at dot leaders and tabs, which are pieces too; ``core`` is what is to be translated of it (with a Latin letter), white space around it stays in the piece."""
    pieces = F.regexp_extract_all(T.col(text), F.lit(r"(?:\.\s*){3,}|\t+|(?:(?!(?:\.\s*){3,}|\t).)+"), F.lit(0))
    delimiter = lambda x: x.rlike(r"^(?:(?:\.\s*){3,}|\t+)$")
    return F.transform(pieces, lambda x: F.struct(x.alias("text"), F.when(~delimiter(x) & x.rlike("[A-Za-z]"), T.strip(x)).alias("core")))


def first_rows(rows: DataFrame, group: str, seq: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group by ``seq``; a limit of the feature, as asked for."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(seq))).where(F.col("_r") <= limit).drop("_r")
