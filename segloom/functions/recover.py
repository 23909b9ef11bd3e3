"""Recovery of JSON from free text of outer systems."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def balanced_chunks(text: str, opening: str = "{", closing: str = "}") -> Iterator[str]:
    """Balanced chunks from left to right; brackets inside JSON strings don't count."""
    depth = start = 0
    quoted = escaped = False
    for i, c in enumerate(text):
        if depth and quoted:
            escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif depth and c == '"':
            quoted, escaped = True, False
        elif c == opening:
            if not depth:
                start = i
            depth += 1
        elif c == closing and depth:
            depth -= 1
            if not depth:
                yield text[start : i + 1]


def payload(text: str | None):
    """The first candidate that parses: the whole, a fenced block, the outermost braces, the outermost brackets, balanced chunks; None if none does."""
    if not text:
        return None
    candidates = [text.strip(), *(m.strip() for m in _FENCE.findall(text))]
    for a, b in ("{}", "[]"):
        i, j = text.find(a), text.rfind(b)
        if 0 <= i < j:
            candidates.append(text[i : j + 1])
    for c in [*candidates, *balanced_chunks(text), *balanced_chunks(text, "[", "]")]:
        try:
            got = json.loads(c)
        except ValueError:
            continue
        if isinstance(got, (dict, list)):
            return got
    return None


def translations(text: str | None) -> dict[str, str] | None:
    """``id -> text`` of an answer in any of three forms (list of objects, the same under a key, or one object); None if broken, an error if an id repeats."""
    got = payload(text)
    if isinstance(got, dict) and isinstance(got.get("translations"), (list, dict)):
        got = got["translations"]
    if isinstance(got, dict):
        return {str(k): v for k, v in got.items() if isinstance(v, str)}
    if not isinstance(got, list):
        return None
    out: dict[str, str] = {}
    for row in got:
        if isinstance(row, dict) and "id" in row and isinstance(row.get("text"), str):
            if str(row["id"]) in out:
                raise ValueError(f"id {row['id']} repeats")
            out[str(row["id"])] = row["text"]
    return out


def check_ids(got: dict[str, str], expected: list[str]) -> None:
    """An error unless an answer has exactly the expected ids."""
    missing, extra = sorted(set(expected) - set(got)), sorted(set(got) - set(expected))
    if missing or extra:
        raise ValueError(f"missing {missing}, extra {extra}")


def recover_json(c: Column) -> Column:
    """The recovered payload as canonical JSON text (keys sorted), or null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if (p := payload(t)) is None else json.dumps(p, sort_keys=True, ensure_ascii=False) for t in s])

    return run(c)


def repair_output(c: Column) -> Column:
    """What follows the last ``OUTPUT:``, else the text."""
    return F.when(c.rlike("(?is)OUTPUT:"), F.regexp_extract(c, r"(?is)^.*OUTPUT:\s*(.*)$", 1)).otherwise(c)


#: What messages of time-outs, of exceeded outputs and of broken answers hold.
TIMEOUT = ("timed out", "timeout", "time out", "deadline exceeded")
OUTPUT_LIMIT = ("finish_reason=length", "finish_reason = length", "max token", "max_tokens", "max completion tokens", "max_completion_tokens", "context length", "token limit", "too many tokens", "output too long", "max_output_tokens")
JSON_CONTRACT = ("json", "schema", "missing ids", "unexpected ids", "duplicate id")


def holds(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a message holds one of the words, case ignored; false for null."""
    m, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(False)
    for w in words:
        out = out | m.contains(w)
    return out


def error_kind(c: Column) -> Column:
    """``timeout``, ``output_limit``, ``json_contract`` or ``other`` of an error message, the first that holds; null for null."""
    return F.when(c.isNull(), None).when(holds(c, TIMEOUT), "timeout").when(holds(c, OUTPUT_LIMIT), "output_limit").when(holds(c, JSON_CONTRACT), "json_contract").otherwise("other")
