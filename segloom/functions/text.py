"""Column expressions over text. All accept nulls (a null text gives null, or false for predicates) and texts of any length."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as regular expressions write it in Java and RE2 alike.
WS = r"[\t\n\x0B\f\r \x{85}\p{Z}]"
LINE_WS = r"[\t\x0B\f\r \x{85}\p{Z}]"
#: The forms of tokens, markers and numbers.
FUZZY_TOKEN = r"[A-Za-zА-Яа-яЁё0-9]{2,}"
MARKER = "⟦[^⟧]*⟧"
STYLE_TOKEN = r"⟦/?S_[0-9]+(?:\|[^⟧|]+)*⟧"
PLACEHOLDER_TOKEN = r"⟦[A-Z][A-Z0-9]*_[0-9]+⟧"
#: Signed decimals with an optional tolerance, not part of a code in capitals.
NUMBER = r"(?<![A-Z0-9])[-+]?\d+(?:[.,]\d+)?(?:\s*±\s*[-+]?\d+(?:[.,]\d+)?)?(?![A-Z0-9])"
#: Bodies that standard codes start with.
STANDARDS = ("AMS", "ASTM", "MIL", "ISO", "SAE", "BS", "DIN", "EN", "QQ", "NAS")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(col(c), rf"^{WS}+", ""), rf"(?<!{WS}){WS}+$", "")


def normalize(c: Column | str) -> Column:
    """Unix line ends, runs of white space within a line as one blank, lines and text stripped."""
    t = F.regexp_replace(F.regexp_replace(col(c), r"\r\n?", "\n"), rf"{LINE_WS}+", " ")
    return strip(F.regexp_replace(t, r" ?\n ?", "\n"))


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def memory_key(norm: Column | str, profile: str, ruleset: str = "v1") -> Column:
    """Key of a normalised text under a rule set and a configuration profile."""
    return F.sha2(F.concat_ws("\n", F.lit(ruleset), F.lit(profile), col(norm)), 256)


def segment_id(location: Column | str, text: Column | str) -> Column:
    return F.substring(F.sha1(F.concat(col(location), F.lit("\n"), col(text))), 1, 16)


def strip_markers(c: Column | str) -> Column:
    return F.regexp_replace(col(c), MARKER, "")


def compact(c: Column | str, limit: int) -> Column:
    """White space collapsed; a text longer than ``limit`` is cut with an ellipsis of three dots."""
    t = strip(F.regexp_replace(col(c), rf"{WS}+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, max(0, limit - 3)), r" +$", ""), F.lit("...")))


def numbers(c: Column | str) -> Column:
    """Numbers in order: markers stripped, decimal commas as points, white space around a tolerance as one blank."""
    found = F.regexp_extract_all(strip_markers(c), F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, ",", "."), r"\s+", " "))


def tokens(c: Column | str, pattern: str | None = None) -> Column:
    """Tokens in lower case by the user's pattern; by the default one where that is none or no expression."""
    try:
        re.compile(pattern or "")
    except re.error:
        pattern = None
    return F.transform(F.regexp_extract_all(col(c), F.lit(pattern or FUZZY_TOKEN), F.lit(0)), F.lower)


def style_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(STYLE_TOKEN), F.lit(0))


def placeholders(c: Column | str) -> Column:
    return F.filter(F.regexp_extract_all(col(c), F.lit(PLACEHOLDER_TOKEN), F.lit(0)), lambda x: ~x.startswith("⟦S_"))


def needs_translation(c: Column | str) -> Column:
    """Whether a text still holds source language, by its shares of Latin and Cyrillic letters and words."""
    t = col(c)
    latin, cyrillic = F.regexp_count(t, F.lit("[A-Za-z]")), F.regexp_count(t, F.lit("[А-Яа-яЁё]"))
    latin_words, cyrillic_words = F.regexp_count(t, F.lit("[A-Za-z]+")), F.regexp_count(t, F.lit("[А-Яа-яЁё]{2,}"))
    done = (cyrillic >= 2 * latin) & (latin_words <= 14) | (cyrillic_words >= F.greatest(F.lit(3), 2 * latin_words))
    return F.when(t.isNull() | (latin == 0), False).when(cyrillic == 0, True).when(done, False).otherwise(~((cyrillic >= 3 * latin) & (latin <= 12)))


def sentence_like(c: Column | str) -> Column:
    return (F.regexp_count(col(c), F.lit("[A-Za-z]+")) >= 8) & col(c).rlike("[.!?;:]")


def is_toc(c: Column | str) -> Column:
    t = F.lower(col(c))
    return t.contains("table of contents") | t.rlike(r"\t[0-9]+\s*$") | t.rlike(r"\.{6,}\s*[0-9]+\s*$")


def hard_glossary_gate(c: Column | str, toc: Column, in_table: Column) -> Column:
    """Whether terms are locked: always in contents and tables and short texts, never in blank and in long ones, else in what is no sentence."""
    words = F.regexp_count(col(c), F.lit("[A-Za-z]+"))
    z = lambda x: F.coalesce(x, F.lit(False))
    return F.when(z(toc) | z(in_table), True).when(F.coalesce(strip(c), F.lit("")) == "", False).when(words <= 6, True).when(words >= 14, False).otherwise(~sentence_like(c))


def severity(c: Column | str) -> Column:
    t = F.lower(F.trim(col(c)))
    return F.when(t.isin("error", "warn", "info"), t).otherwise("warn")


def confidence(c: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(c).try_cast("double"), F.lit(0.0))))


def page_of(page: Column | str, location: Column | str) -> Column:
    """The page number, else the one in a location of the form pdf/p12/..."""
    from_location = F.regexp_extract(col(location), r"^pdf/p(\d+)(?:/|$)", 1).try_cast("int")
    return F.coalesce(col(page).try_cast("int"), from_location)


def key_normal(c: Column | str) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", "")


def margin_normal(c: Column | str) -> Column:
    """White space collapsed, lower case, without signs other than those of addresses and numbers."""
    return F.regexp_replace(F.lower(strip(F.regexp_replace(col(c), rf"{WS}+", " "))), r"[^0-9A-Za-zА-Яа-яЁё:/()., -]+", "")


def safe_stem(c: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", ""), F.lit("")), F.lit("file"))


def counts(tokens_: Column) -> Column:
    """Map of each distinct element to how often it occurs."""
    d = F.array_distinct(tokens_)
    return F.map_from_arrays(d, F.transform(d, lambda x: F.size(F.filter(tokens_, lambda y: y == x))))


def multiset_minus(a: Column, b: Column) -> Column:
    """Elements of a that b lacks, with multiplicity, sorted."""
    rest = F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(F.lit(0), F.size(F.filter(a, lambda y: y == x)) - F.size(F.filter(b, lambda y: y == x)))))
    return F.array_sort(F.flatten(rest))


def flat(c: Column | str) -> Column:
    """White space of any kind as single blanks, ends stripped; an empty text for null."""
    return strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), rf"{WS}+", " "))


def has_latin(c: Column | str) -> Column:
    """Whether a text gets the context of its neighbours: it holds a Latin letter."""
    return F.coalesce(col(c).rlike("[A-Za-z]"), F.lit(False))


def target_text(tagged: Column | str, fallback: Column | str) -> Column:
    """The tagged target, else the one of the context, else an empty text; blank ones don't count."""
    real = lambda c: F.when(F.length(strip(c)) > 0, col(c))
    return F.coalesce(real(tagged), real(fallback), F.lit(""))


def is_standard_code(c: Column | str) -> Column:
    """A term with a digit that starts with the name of a standards body."""
    return F.coalesce(col(c).rlike(rf"(?i)^\s*(?:{'|'.join(STANDARDS)})\b") & col(c).rlike(r"\d"), F.lit(False))


def structured_field(c: Column | str, name: str) -> Column:
    """A text field of a JSON answer; null if the answer is none or the field is no text."""
    v = F.try_parse_json(col(c))
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def batch_reasons(c: Column | str, toc: Column, skip_breaks: bool = True, most_styles: int = 16, most_placeholders: int = 12) -> Column:
    """Why a shielded text goes into no batch: contents, a line break, too many style openings (unless their limit is below 0), too many placeholders."""
    t = F.coalesce(col(c), F.lit(""))
    opened = F.regexp_count(t, F.lit(r"⟦S_[0-9]+(?:\|[^⟧]*)?⟧"))
    why = [F.when(F.coalesce(toc, F.lit(False)), "toc_entry"), F.when(F.lit(skip_breaks) & t.rlike("⟦BRLINE_[0-9]+⟧"), "contains_brline")]
    why += [F.when(F.lit(most_styles >= 0) & (opened > most_styles), "too_many_style_tokens"), F.when(F.size(placeholders(t)) > most_placeholders, "too_many_placeholders")]
    return F.filter(F.array(*why), lambda x: x.isNotNull())
