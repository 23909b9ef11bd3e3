"""Masking of patterns and terms behind numbered markers, and back. Numbering depends on the whole text, so these are pandas UDFs."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKER = re.compile("(⟦[^⟧]*⟧)")
RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("map", T.MapType(T.StringType(), T.StringType()))])


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    flags: str = ""

    def compiled(self) -> re.Pattern:
        try:
            return re.compile(self.pattern, sum({"I": re.I, "M": re.M, "S": re.S}[f] for f in self.flags))
        except re.error as e:
            raise ValueError(f"rule {self.name}: {e}") from e


#: The shipped rules, in the order in which they apply.
DEFAULT_RULES = (
    Rule("REF", r"\(\s*\d+\s*-\s*\d+\s*\)"),
    Rule("REF", r"\b(?:Fig(?:ure)?\.?\s*\d+[A-Z]?|Figure\s*\d+[A-Z]?)\b", "I"),
    Rule("REF", r"\b(?:Rev(?:ision)?\.?\s*[A-Z0-9]+|Revision\s*\d+)\b", "I"),
    Rule("REF", r"\bTable\s*\d+[A-Z]?\b", "I"),
    Rule("REF", r"\bSB\s+\d{2,5}(?:[-/]\d{1,4})+\b", "I"),
    Rule("REF", r"\bAD\s+\d{4}-\d{2}-\d{2}\b", "I"),
    Rule("REF", r"\bAMM\s+\d{2}-\d{2}-\d{2}\b", "I"),
    Rule("ATA", r"\b\d{2}-\d{2}-\d{2}\b"),
    Rule("THR", r"\bM\d+(?:x\d+(?:\.\d+)?)?\b", "I"),
    Rule("PN", r"\b\d{6,}\b"),
    Rule("PN", r"\b[A-Z0-9]{3,}[-/][A-Z0-9][A-Z0-9\-/]{2,}\b", "I"),
    Rule("DIM", r"\b\d+(?:[\.,]\d+)?(?:\s*±\s*\d+(?:[\.,]\d+)?)?(?:\s*(?:mm|cm|in|inch|ft|lbf|lb|N·m|N\.m|Nm|psi|bar|kPa|MPa|V|Ohm|Hz|kHz|MHz|GHz|°C|°F|degC|degF)\b|\s+(?:m|A)\b|\s*Ω\b)", "I"),
)


def split_markers(text: str) -> list[tuple[str, bool]]:
    """Pieces of a text with whether each is a marker; empty pieces are left out."""
    return [(p, i % 2 == 1) for i, p in enumerate(_MARKER.split(text)) if p]


def mask(text: str, rules: tuple[Rule, ...]) -> tuple[str, dict[str, str]]:
    """Each match outside markers becomes a marker numbered within its rule name, from the text's start on; within a piece between markers later rules see what earlier ones made."""
    found: dict[str, str] = {}
    used: dict[str, int] = {}

    def applied(piece: str) -> str:
        for rule in rules:

            def put(m: re.Match, name: str = rule.name) -> str:
                used[name] = used.get(name, 0) + 1
                key = f"⟦{name}_{used[name]}⟧"
                found[key] = m.group()
                return key

            piece = _compiled(rule).sub(put, piece)
        return piece

    return "".join(p if marked else applied(p) for p, marked in split_markers(text)), found


_COMPILED: dict[Rule, re.Pattern] = {}


def _compiled(rule: Rule) -> re.Pattern:
    if rule not in _COMPILED:
        _COMPILED[rule] = rule.compiled()
    return _COMPILED[rule]


def unmask(text: str, found: dict[str, str]) -> str:
    """Markers replaced by what they stand for; longer markers first."""
    for key in sorted(found, key=lambda k: (-len(k), k)):
        text = text.replace(key, found[key])
    return text


def mask_terms(text: str, terms: list[tuple[re.Pattern, str]], prefix: str = "GLS", bridge: bool = False) -> tuple[str, dict[str, str]]:
    """Each term becomes a marker numbered by the term; with ``bridge`` a term may reach over break markers."""
    if not re.fullmatch(r"[A-Z][A-Z0-9]*", prefix):
        raise ValueError(f"a marker prefix of capitals and digits is needed, not {prefix!r}")
    found: dict[str, str] = {}
    for number, (pattern, target) in enumerate(terms, 1):
        key = f"⟦{prefix}_{number}⟧"
        if bridge:
            pieces, n = re.subn(pattern, key, text) if not any(m for _, m in split_markers(text)) else _bridged(text, pattern, key)
        else:
            n, out = 0, []
            for p, marked in split_markers(text):
                q, k = (p, 0) if marked else pattern.subn(key, p)
                out.append(q)
                n += k
            pieces = "".join(out)
        if n:
            text, found[key] = pieces, target
    return text, found


def _bridged(text: str, pattern: re.Pattern, key: str) -> tuple[str, int]:
    """Replacement where the match holds no marker but those of breaks."""
    n = 0

    def put(m: re.Match) -> str:
        nonlocal n
        if any(marked and not p.startswith("⟦BR") for p, marked in split_markers(m.group())):
            return m.group()
        n += 1
        return key

    return pattern.sub(put, text), n


def shield(c: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """``struct<text, map>``; null for null texts."""

    @F.pandas_udf(RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        got = [mask(t, rules) if t is not None else (None, None) for t in s]
        return pd.DataFrame({"text": [g[0] for g in got], "map": [g[1] for g in got]})

    for r in rules:
        r.compiled()
    return run(c)


def unshield(text: Column, found: Column) -> Column:
    """In the JVM: one literal replacement for each marker, longer markers first."""
    entries = F.array_sort(F.map_entries(found), lambda a, b: F.coalesce(F.nullif(F.length(b["key"]) - F.length(a["key"]), F.lit(0)), F.when(a["key"] < b["key"], -1).otherwise(1)))
    return F.aggregate(entries, text, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def protect_markers(text: str) -> tuple[str, list[str]]:
    """Markers as plain words that survive an outer system, with the markers in order."""
    kept: list[str] = []

    def put(m: re.Match) -> str:
        kept.append(m.group())
        return f"__mk_{len(kept) - 1}__"

    return _MARKER.sub(put, text), kept


def restore_markers(text: str, kept: list[str]) -> str:
    return re.sub(r"__\s*mk\s*_\s*(\d+)\s*__", lambda m: kept[int(m.group(1))] if int(m.group(1)) < len(kept) else m.group(), text, flags=re.I)


def tagged_pieces(text: str) -> list[tuple[str, str]]:
    """``(kind, text)`` pieces of a tagged text: ``span:n`` for the text of a closed style marker, ``marker`` and ``plain``."""
    out, at = [], 0
    for m in re.finditer(r"⟦S_(\d+)(?:\|[^⟧]*)?⟧(.*?)⟦/S_\1⟧|⟦[^⟧]*⟧", text, re.S):
        if m.start() > at:
            out.append(("plain", text[at : m.start()]))
        out.append((f"span:{m.group(1)}", m.group(2)) if m.group(1) else ("marker", m.group()))
        at = m.end()
    if at < len(text):
        out.append(("plain", text[at:]))
    return out
