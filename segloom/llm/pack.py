"""Problem 2: filling fixed-capacity containers with items that may not be split.

Cost-balanced packing: an item of n characters costs n + n * n / QUADRATIC_AT (linear work plus
attention, equal at that length). Items go, largest first, to the open container of the lowest
cost that still has room; the number of containers starts at the lower bound and grows only when
none has room. Items longer than a container are cut, the rest of them fills up like any item.

Groups (documents) are packed in blocks of at most BLOCK_ITEMS, dealt by a hash of the item, so a
group that holds a third of all rows is spread over many tasks. What the blocks of a group leave
in their emptier containers is dealt again and packed together in a second round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import keep_latest

BLOCK_ITEMS = 4_000
QUADRATIC_AT = 4_000
#: Containers filled less than this after the first round are opened and packed again, if their group has several blocks.
REPACK_BELOW = 0.9


def item_cost(n):
    return n + n * n / QUADRATIC_AT


def pack_block(sizes, capacity: int, most: int) -> tuple[list[int], list[int], list[int]]:
    """The container of each item, and what each container holds in size and items; sizes come largest first and none exceeds the capacity."""
    n = len(sizes)
    used = max(1, -(-int(sum(sizes)) // capacity), -(-n // most))
    room, count, cost = np.full(used + n, capacity), np.zeros(used + n, dtype=np.int64), np.zeros(used + n)
    out = []
    for s in map(int, sizes):
        # A container without room for this item, or with all its items, costs more than any other for now.
        barred = (room[:used] < s) | (count[:used] >= most)
        at = int(np.where(barred, np.inf, cost[:used]).argmin())
        if barred[at]:
            at, used = used, used + 1
        room[at] -= s
        count[at] += 1
        cost[at] += item_cost(s)
        out.append(at)
    return out, (capacity - room).tolist(), count.tolist()


def _cuts(text: str, capacity: int) -> list[int]:
    """Lengths of the pieces of an over-long text, cut behind white space where there is some in the last fifth."""
    out, pos = [], 0
    while len(text) - pos > capacity:
        end = pos + capacity
        back = max(text.rfind(" ", pos + capacity * 4 // 5, end), text.rfind("\n", pos + capacity * 4 // 5, end)) + 1
        end = back or end
        out.append(end - pos)
        pos = end
    return [*out, len(text) - pos]


def _packed(items: DataFrame, round_no: int) -> DataFrame:
    """Items with their container and what it holds; one row of at most about BLOCK_ITEMS items goes to Python for each block."""

    @F.pandas_udf("struct<bin: array<int>, chars: array<int>, items: array<int>>")
    def run(minus: pd.Series, capacity: pd.Series, most: pd.Series) -> pd.DataFrame:
        got = [pack_block([-x for x in m], int(c), int(k)) for m, c, k in zip(minus, capacity, most)]
        return pd.DataFrame({"bin": [g[0] for g in got], "chars": [[g[1][b] for b in g[0]] for g in got], "items": [[g[2][b] for b in g[0]] for g in got]})

    blocks = items.groupBy("_g", "_block").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n_chars")).alias("minus"), "item_id", "piece", "n_pieces"))).alias("i"),
        *(F.max(c).alias(c) for c in ("capacity", "most", "_blocks")),
    )
    placed = blocks.withColumn("r", run("i.minus", "capacity", "most"))
    return placed.select("_g", "_block", "_blocks", "capacity", "most", F.explode(F.arrays_zip("i", "r.bin", "r.chars", "r.items")).alias("x")).select(
        "_g", "x.i.item_id", "x.i.piece", "x.i.n_pieces", (-F.col("x.i.minus")).alias("n_chars"), "capacity", "most", "_blocks",
        F.concat_ws("/", "_g", F.lit(round_no), "_block", "x.bin").alias("request_id"), F.col("x.chars").alias("request_chars"), F.col("x.items").alias("request_items"),
    )


def _dealt(items: DataFrame) -> DataFrame:
    """Items with a block number: as many blocks to a group as it needs, dealt by hash. The counts are made before the shuffle."""
    counts = items.groupBy("_g").agg(F.ceil(F.count("*") / BLOCK_ITEMS).alias("_blocks"))
    return items.join(counts, "_g").withColumn("_block", F.pmod(F.xxhash64("item_id", "piece"), F.col("_blocks")).cast("int"))


def pack_requests(segments: DataFrame, configs: DataFrame, default_chars: int = 2000, default_segments: int = 16) -> DataFrame:
    """Requests of each document: one row per piece of a segment.

    Columns: ``doc_id, segment_id, piece, n_pieces, n_chars, capacity, request_id, request_chars, request_items``.
    Repeated segment ids count once (the latest). Null and empty texts are items of no length. Rows with a null
    document form a group of their own; a document without a known config takes the defaults. A segment alone
    longer than its capacity has ``n_pieces`` above 1, and only such a segment is cut.
    """
    rows = keep_latest(
        segments.select("segment_id", "doc_id", "config_id", "extracted_at", "source_plain").withColumn("n_chars", F.coalesce(F.length("source_plain"), F.lit(0))).join(
            configs.select("config_id", F.col("batch_max_chars").alias("capacity"), F.col("batch_segments").alias("most")).dropDuplicates(["config_id"]), "config_id", "left"
        ).withColumn("capacity", F.greatest(F.lit(1), F.coalesce("capacity", F.lit(default_chars)))).withColumn("most", F.greatest(F.lit(1), F.coalesce("most", F.lit(default_segments))))
        # The text travels only where it must be cut.
        .withColumn("source_plain", F.when(F.col("n_chars") > F.col("capacity"), F.col("source_plain"))),
        ["segment_id"],
        [F.col("extracted_at").desc_nulls_last(), F.col("doc_id"), F.col("n_chars")],
    )

    @F.pandas_udf("array<int>")
    def cut(text: pd.Series, capacity: pd.Series) -> pd.Series:
        return pd.Series([_cuts(t, int(c)) for t, c in zip(text, capacity)])

    group = F.coalesce(F.concat(F.lit("d:"), "doc_id"), F.lit("null"))
    base = rows.withColumn("_g", group).withColumnRenamed("segment_id", "item_id")
    whole = base.where("n_chars <= capacity").select("_g", "item_id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), "n_chars", "capacity", "most")
    pieces = (
        base.where("n_chars > capacity")
        .withColumn("_cuts", cut("source_plain", "capacity"))
        .select("_g", "item_id", F.posexplode("_cuts").alias("piece", "_len"), F.size("_cuts").alias("n_pieces"), "capacity", "most")
        .select("_g", "item_id", "piece", "n_pieces", F.col("_len").alias("n_chars"), "capacity", "most")
    )
    first = materialize(_packed(_dealt(whole.unionByName(pieces)), 1))
    fill = F.greatest(F.col("request_chars") / F.col("capacity"), F.col("request_items") / F.col("most"))
    again = (F.col("_blocks") > 1) & (fill < REPACK_BELOW)
    second = _packed(_dealt(first.where(again).select("_g", "item_id", "piece", "n_pieces", "n_chars", "capacity", "most")), 2)
    return first.where(~again).unionByName(second).select(
        F.when(F.col("_g") != "null", F.substring("_g", 3, 1 << 30)).alias("doc_id"), F.col("item_id").alias("segment_id"),
        "piece", "n_pieces", "n_chars", "capacity", "request_id", "request_chars", "request_items",
    )
