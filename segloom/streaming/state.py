"""Streaming counterparts: running totals, resume state from the trace, progress snapshots and liveness."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE_SCHEMA = "line_no long, ts timestamp, event string, chunk_id string, edits_count int"


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The append-only trace as a stream of JSON files; lines that don't parse have null events and are left out."""
    return spark.readStream.schema(TRACE_SCHEMA).option("mode", "PERMISSIVE").json(folder).where(F.col("event").isNotNull())


def running_usage(usage: DataFrame) -> DataFrame:
    """Totals per phase; a streaming aggregation for the output mode ``complete`` or ``update``."""
    phase = F.coalesce(F.nullif(F.lower(F.trim("phase")), F.lit("")), F.lit("unknown"))
    return usage.groupBy(phase.alias("phase")).agg(F.count("*").alias("requests"), F.sum(F.greatest(F.lit(0), F.coalesce("total_tokens", F.lit(0)))).alias("total_tokens"))


def event_counters(trace: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per window of event time; rows later than the watermark are dropped."""
    return trace.withWatermark("ts", late).groupBy(F.window("ts", every), "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event", "n")


def root_of(chunk_id) -> F.Column:
    return F.substring_index(chunk_id, ".", 1)


def root_states(trace: DataFrame) -> DataFrame:
    """``root, complete`` as chunks end: a root is complete when it ended, or both halves of each split did.

    Custom state per root: the chunks that ended and those that were split, a few strings each.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, split = (set(json.loads(x)) for x in state.get) if state.exists else (set(), set())
        for b in batches:
            done |= set(b.loc[b["event"].isin(["response", "failed_chunk"]), "chunk_id"])
            split |= set(b.loc[b["event"] == "split", "chunk_id"])
        state.update((json.dumps(sorted(done)), json.dumps(sorted(split))))
        yield pd.DataFrame({"root": [key[0]], "complete": [is_complete(key[0], done, split)]})

    keyed = trace.where(F.col("chunk_id").isNotNull()).withColumn("root", root_of(F.col("chunk_id")))
    return keyed.groupBy("root").applyInPandasWithState(step, "root string, complete boolean", "done string, split string", "update", "NoTimeout")


def is_complete(chunk: str, done: set[str], split: set[str]) -> bool:
    """Whether a chunk ended, or all parts it was split into did; names grow with each split, so this ends."""
    open_ = [chunk]
    while open_:
        c = open_.pop()
        if c not in done:
            if c not in split:
                return False
            open_ += [f"{c}.a", f"{c}.b"]
    return True


def liveness(beats: DataFrame, limit_ms: int = 6_000) -> DataFrame:
    """``session, stale``: a session without a beat for so long (processing time) is reported as stale once."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "stale": [True]})
            return
        n = sum(len(b) for b in batches) + (state.get[0] if state.exists else 0)
        state.update((n,))
        state.setTimeoutDuration(limit_ms)
        yield pd.DataFrame({"session": [key[0]], "stale": [False]})

    return beats.groupBy("session").applyInPandasWithState(step, "session string, stale boolean", "beats long", "update", "ProcessingTimeTimeout")


def snapshot_sink(path: str, every: int = 1):
    """A ``foreachBatch`` sink that writes the (small, aggregated) batch as one JSON status file, every so many batches; replays write the same."""

    def write(batch: DataFrame, epoch: int) -> None:
        if epoch % every:
            return
        target = Path(path)
        part = target.with_suffix(".part")
        with part.open("w", encoding="utf-8") as f:  # row by row, so that nothing is held that grows with the batch
            f.write(json.dumps({"epoch": epoch})[:-1] + ', "rows": [')
            for i, r in enumerate(batch.toLocalIterator()):
                f.write((", " if i else "") + json.dumps(r.asDict(), default=str, ensure_ascii=False))
            f.write("]}")
        part.replace(target)

    return write
