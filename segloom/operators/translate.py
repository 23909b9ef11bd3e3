"""Calls of an outer text service as one pass over partitions, with a deterministic stand-in.

Distinct texts are translated once, known ones come from the memory, and failures become rows, not exceptions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recover import OUTPUT_LIMIT, TIMEOUT, check_ids, translations
from ..functions.shield import protect_markers, restore_markers, tagged_pieces


class TextService(Protocol):
    def translate(self, texts: list[str]) -> list[str]: ...


class EchoService:
    """Gives each text back; the same input always has the same output."""

    def translate(self, texts: list[str]) -> list[str]:
        return list(texts)


#: Services by name; others are registered by the caller, as none but the stand-in works without a network.
SERVICES: dict[str, Callable[[], "TextService"]] = {"mock": EchoService}


def service_of(provider: str) -> Callable[[], "TextService"]:
    """The factory of a provider's service; an error for one that is not registered."""
    name = provider.strip().lower()
    if name not in SERVICES:
        raise ValueError(f"unknown provider {provider!r}")
    return SERVICES[name]


def bisect(texts: list[str], service: TextService) -> list[tuple[str | None, str | None]]:
    """Target and error of each text; a batch that times out is halved down to single texts."""
    try:
        got = service.translate(texts)
        if len(got) != len(texts):
            raise ValueError("missing ids in the answer")
        return [(t, None) for t in got]
    except TimeoutError as e:
        if len(texts) == 1:
            return [(None, f"timed out: {e}")]
        half = len(texts) // 2
        return bisect(texts[:half], service) + bisect(texts[half:], service)
    except Exception as e:  # noqa: BLE001 - whatever an outer system raises
        if len(texts) == 1:
            return [(None, str(e))]
        return [bisect([t], service)[0] for t in texts]


def parse_batch(answer: str, expected: list[str]) -> dict[str, str]:
    """The translations of an answer by id; an error unless the ids are exactly those expected."""
    got = translations(answer)
    if got is None:
        raise ValueError("no json in the answer")
    check_ids(got, expected)
    return got


def translate(rows: DataFrame, key: str, text: str, memory: DataFrame | None = None, factory: Callable[[], TextService] = EchoService, batch: int = 32) -> DataFrame:
    """``key, target, origin, error``; origin ``tm`` or ``llm``. Markers are protected around the call. Null texts have a null target."""
    distinct = rows.select(F.col(text).alias("t")).where(F.col(text).isNotNull()).distinct()
    if memory is not None:
        known = memory.select(F.col("source_norm").alias("t"), F.col("target_text").alias("target")).dropDuplicates(["t"])
        hits = distinct.join(known, "t")
        distinct = distinct.join(known, "t", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for b in batches:
            for i in range(0, len(b), batch):
                texts = list(b["t"].iloc[i : i + batch])
                safe = [protect_markers(t) for t in texts]
                got = bisect([s for s, _ in safe], client)
                yield pd.DataFrame({"t": texts, "target": [None if g is None else restore_markers(g, k) for (g, _), (_, k) in zip(got, safe)], "error": [e for _, e in got]})

    done = distinct.mapInPandas(run, "t string, target string, error string").withColumn("origin", F.lit("llm"))
    if memory is not None:
        done = done.unionByName(hits.select("t", "target", F.lit(None).cast("string").alias("error"), F.lit("tm").alias("origin")))
    return rows.select(F.col(key).alias("key"), F.col(text).alias("t")).join(done, "t", "left").select("key", "target", "origin", "error")


def attempts(text: str, service: TextService, valid: Callable[[str], bool], repair: Callable[[str, str], str] | None = None, missing: Callable[[str], int] | None = None, most: int = 2) -> tuple[str | None, str]:
    """The first valid answer and how it came: ``ok`` of the text itself, ``repaired`` by asking for its markers, ``spans`` piece by piece, else the last answer as ``invalid``.

    Of valid answers that lack terms (``missing`` counts them) a later one is taken only if it lacks fewer.
    """
    answer = None
    for _ in range(most):
        answer = service.translate([text])[0]
        if valid(answer):
            if missing is None or not missing(answer):
                return answer, "ok"
            again = service.translate([text])[0]
            return (again if valid(again) and missing(again) < missing(answer) else answer), "ok"
    if repair is not None:
        fixed = service.translate([repair(text, answer or "")])[0]
        if valid(fixed):
            return fixed, "repaired"
    pieces = by_spans(text, service)
    return (pieces, "spans") if valid(pieces) else (answer, "invalid")


def by_spans(text: str, service: TextService) -> str:
    """A tagged text with each piece between markers put through the service on its own; blank pieces and the white space around pieces stay."""
    out, at = [], 0
    for kind, piece in tagged_pieces(text):
        start = text.index(piece, at)
        out.append(text[at:start])
        core = piece.strip()
        out.append(piece if kind == "marker" or not core else piece.replace(core, service.translate([core])[0], 1))
        at = start + len(piece)
    return "".join([*out, text[at:]])


def review(chunks: DataFrame, factory: Callable[[], Callable[[list[str]], str]], depth: int = 2, retries: int = 1, most_segments: int = 0) -> DataFrame:
    """``chunk_id, event, answer, error``: the trace of a review of chunks (``chunk_id, segments``, a list of texts).

    A time-out or an exceeded output splits a chunk into halves ``.a`` and ``.b``, down to ``depth`` splits; another error is
    tried again, then fails the chunk. With ``most_segments`` whole chunks are taken in order as long as they fit it.
    """
    c = chunks
    if most_segments > 0:
        w = Window.orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
        keep = chunks.select("chunk_id", F.sum(F.size("segments")).over(w).alias("_sent")).where(F.col("_sent") <= most_segments).select("chunk_id")
        c = chunks.join(keep, "chunk_id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for b in batches:
            rows: list[tuple] = []
            for key, texts in zip(b["chunk_id"], b["segments"]):
                _review(key, list(texts), ask, depth, retries, rows)
            yield pd.DataFrame(rows, columns=["chunk_id", "event", "answer", "error"])

    return c.select("chunk_id", "segments").mapInPandas(run, "chunk_id string, event string, answer string, error string")


def _review(key: str, texts: list[str], ask: Callable[[list[str]], str], depth: int, retries: int, rows: list[tuple]) -> None:
    for left in range(retries, -1, -1):
        rows.append((key, "request", None, None))
        try:
            rows.append((key, "response", ask(texts), None))
            return
        except Exception as e:  # noqa: BLE001 - whatever an outer system raises
            rows.append((key, "error", None, str(e)))
            message = str(e).lower()
            if depth > 0 and len(texts) > 1 and (isinstance(e, TimeoutError) or any(w in message for w in (*TIMEOUT, *OUTPUT_LIMIT))):
                rows.append((key, "split", None, None))
                half = (len(texts) + 1) // 2
                for name, part in (("a", texts[:half]), ("b", texts[half:])):
                    _review(f"{key}.{name}", part, ask, depth - 1, retries, rows)
                return
            if not left:
                rows.append((key, "failed_chunk", None, str(e)))


def new_memory(done: DataFrame, source_norm: str = "t") -> DataFrame:
    """``source_norm, target_text, origin`` of answers to write through to the memory: those of the service without an error."""
    return done.where("origin = 'llm' and error is null and target is not null").select(F.col(source_norm).alias("source_norm"), F.col("target").alias("target_text"), "origin").distinct()
