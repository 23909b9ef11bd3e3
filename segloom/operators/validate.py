"""Validators of source and target pairs: each rule gives at most one issue a pair, all in one pass without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Latin words that may stand in a translation.
ALLOWED = ("amm", "api", "ata", "cmm", "docx", "en", "ipc", "kg", "kpa", "mlg", "mm", "nlg", "nm", "oem", "pdf", "pn", "psi", "ru", "safran", "sb")
#: Control words of prompts; the last four need a separator behind them.
CONTROL = ("DOC_SECTION", "TABLE_CELL", "TOC_ENTRY", "MATCHED_GLOSSARY", "DOCUMENT_GLOSSARY", "TM_REFERENCES", "RECENT_TRANSLATIONS")
CONTROL_WITH_SEPARATOR = ("PART", "SECTION", "PREV", "NEXT")
_WORD = re.compile(r"[A-Za-zА-Яа-яЁё]+")
ORDER = ("placeholders_mismatch", "style_tags_mismatch", "numbers_mismatch", "empty_translation", "length_ratio_high", "short_translation", "untranslated_fragments", "repeated_words", "context_leakage", "repair_payload_leak")


def placeholder_diff(source: Column, target: Column) -> tuple[Column, Column]:
    """Placeholders that the target lacks and has too many of, as multisets."""
    a, b = T.placeholders(source), T.placeholders(target)
    return T.multiset_minus(a, b), T.multiset_minus(b, a)


def untranslated_words(target: Column) -> tuple[Column, Column]:
    """Suspicious Latin words (not short, allowed, with a digit or a short capital code) and all words of a target without markers."""
    t = T.strip_markers(target)
    words = F.regexp_extract_all(t, F.lit("[A-Za-zА-Яа-яЁё]+"), F.lit(0))
    latin = F.regexp_extract_all(t, F.lit("[A-Za-z][A-Za-z0-9/-]*"), F.lit(0))
    odd = F.filter(latin, lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*ALLOWED) & ~w.rlike("[0-9]") & ~((F.upper(w) == w) & (F.length(w) <= 5)))
    return odd, words


def cyrillic_words(target: Column) -> Column:
    return F.transform(F.regexp_extract_all(T.strip_markers(target), F.lit("[А-Яа-яЁё]{2,}"), F.lit(0)), F.lower)


#: At most so many repeated words, so many repeated groups of words, and so many control words are reported.
MOST_REPEATS, MOST_LEAKS = 6, 8


def repeated_words(target: Column) -> Column:
    """Words that directly repeat, with nothing but blanks and light marks between, in order of place."""
    again = F.regexp_extract_all(target, F.lit(r"(?iU)\b([А-Яа-яЁё]{2,})\b[\s,;:()\-]+\1\b"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(again, F.lower)), 1, MOST_REPEATS)


def repeated_phrases(w: Column, most: int = 3) -> Column:
    """Groups of two up to ``most`` words of a list that are followed by themselves, shorter groups first."""
    return F.slice(F.array_distinct(F.concat(*(_repeats(w, n) for n in range(2, max(2, most) + 1)))), 1, MOST_REPEATS)


def _repeats(w: Column, n: int) -> Column:
    at = F.when(F.size(w) >= 2 * n, F.sequence(F.lit(1), F.size(w) - 2 * n + 1)).otherwise(F.array().cast("array<int>"))
    hit = F.filter(at, lambda i: F.slice(w, i, n) == F.slice(w, i + n, n))
    return F.transform(hit, lambda i: F.array_join(F.slice(w, i, n), " "))


def leaked_control(target: Column) -> Column:
    """Control words in a target, distinct, in order of place."""
    hit = F.regexp_extract_all(target, F.lit(rf"(?iU)\b(?:(?:{'|'.join(CONTROL)})\b|(?:{'|'.join(CONTROL_WITH_SEPARATOR)})\b\s*[:=])"), F.lit(0))
    return F.array_distinct(F.transform(hit, lambda x: F.upper(F.regexp_replace(x, r"(?U)\s*[:=]$", ""))))


def issues(pairs: DataFrame, key: str, source: str, target: str, source_tagged: str | None = None, target_tagged: str | None = None, high_ratio: float = 3.0, short_ratio: float = 0.35, short_from: int = 24, latin_ratio: float = 0.15) -> DataFrame:
    """``key, code, severity, details`` in long form. ``source`` and ``target`` are plain texts, the tagged ones hold markers (the plain ones if not given).

    A null target counts as empty, a null source as empty too.
    """
    s, t = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(target), F.lit(""))
    st, tt = F.coalesce(F.col(source_tagged or source), F.lit("")), F.coalesce(F.col(target_tagged or target), F.lit(""))
    odd_, words_ = untranslated_words(t)
    # The token lists come first, so that each is made once a row.
    base = pairs.select(
        F.col(key).alias("key"), F.length(T.strip(T.strip_markers(s))).alias("ls"), F.length(T.strip(T.strip_markers(t))).alias("lt"), (F.length(T.strip_markers(s)) > 0).alias("has_source"), T.placeholders(st).alias("ps"), T.placeholders(tt).alias("pt"),
        T.style_tokens(st).alias("ss"), T.style_tokens(tt).alias("sts"), T.numbers(s).alias("ns"), T.numbers(t).alias("nt"), odd_.alias("odd"), F.size(words_).alias("words"), cyrillic_words(t).alias("cw"), repeated_words(T.strip_markers(t)).alias("again"),
        F.slice(leaked_control(T.strip_markers(t)), 1, MOST_LEAKS).alias("leaked"),
        (F.upper(tt).contains("TASK: REPAIR_MARKERS") | F.upper(tt).contains("SOURCE:") & F.upper(tt).contains("OUTPUT:")).alias("payload"),
    )
    ls, lt, odd, leaked, again = (F.col(c) for c in ("ls", "lt", "odd", "leaked", "again"))
    differ = F.array_sort("ps") != F.array_sort("pt")
    missing, extra = T.multiset_minus(F.col("ps"), F.col("pt")), T.multiset_minus(F.col("pt"), F.col("ps"))
    base = base.withColumn("phrases", repeated_phrases(F.col("cw")))
    phrases = F.col("phrases")
    share = F.size(odd) / F.greatest(F.col("words"), F.lit(1))
    rule = lambda cond, code, severity, details: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), details.alias("details")))
    ratio = F.concat_ws("/", lt, ls)
    least = max(0.0, min(1.0, short_ratio))
    found = F.array(
        rule(differ, ORDER[0], "error", F.concat(F.array_join(missing, ","), F.lit("/"), F.array_join(extra, ","))),
        rule(F.col("ss") != F.col("sts"), ORDER[1], "error", F.concat(F.array_join("ss", ","), F.lit("/"), F.array_join("sts", ","))),
        rule(F.col("ns") != F.col("nt"), ORDER[2], "warn", F.concat(F.array_join("ns", ","), F.lit("/"), F.array_join("nt", ","))),
        rule((ls > 0) & (lt == 0), ORDER[3], "error", F.lit("")),
        rule((ls > 0) & (lt > ls * high_ratio), ORDER[4], "warn", ratio),
        rule((ls >= max(1, short_from)) & (lt / F.greatest(ls, F.lit(1)) < least), ORDER[5], "warn", ratio),
        rule(F.col("has_source") & (F.col("words") > 0) & (F.size(odd) > 0) & (share >= latin_ratio), ORDER[6], "warn", F.array_join(first_samples(odd), ",")),
        rule((F.size(again) > 0) | (F.size(phrases) > 0), ORDER[7], "warn", F.concat(F.array_join(F.array_sort(again), ","), F.lit("/"), F.array_join(F.array_sort(phrases), ","))),
        rule(F.size(leaked) > 0, ORDER[8], "warn", F.array_join(leaked, ",")),
        rule(F.col("payload"), ORDER[9], "error", F.lit("")),
    )
    return base.select("key", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("key", "i.code", "i.severity", "i.details")


def first_samples(words: Column, most: int = 8) -> Column:
    """The first spelling of each word, case ignored, at most so many."""
    low = F.transform(words, F.lower)
    return F.slice(F.transform(F.array_distinct(low), lambda w: F.get(words, (F.array_position(low, w) - 1).cast("int"))), 1, most)


def missing_terms(found: DataFrame, targets: DataFrame, key: str, target: str, mode: str = "warn", lemma: Callable[[str], str] | None = None) -> DataFrame:
    """``key, term, target``: matched terms whose target the translation lacks, case ignored; nothing in mode ``off``.

    With a function that gives the lemma of a word, a term is there too if all its lemmas are among those of the
    translation. An unknown mode is ``off``. ``found`` has ``key, term, target``.
    """
    t = targets.select(F.col(key).alias("key"), F.lower(T.strip_markers(target)).alias("body"))
    if mode not in ("warn", "retry"):
        return found.select("key", "term", "target").limit(0)
    absent = found.join(t, "key").where(~F.contains(F.coalesce("body", F.lit("")), F.lower("target")))
    if lemma is not None:

        @F.pandas_udf("array<string>")
        def lemmas(texts: pd.Series) -> pd.Series:
            return pd.Series([sorted({lemma(w) or w for w in _WORD.findall((x or "").lower())}) for x in texts])

        absent = absent.withColumn("_b", lemmas("body")).withColumn("_t", lemmas("target"))
        absent = absent.where((F.size("_b") == 0) | (F.size(F.array_except("_t", "_b")) > 0))
    return absent.select("key", "term", "target")


def term_issues(missing: DataFrame, mode: str = "warn") -> DataFrame:
    """One ``glossary_lemma_mismatch`` a key, with the missing terms in order."""
    terms = F.transform(F.array_sort(F.collect_set(F.struct("term", "target"))), lambda x: F.concat(x["term"], F.lit("=>"), x["target"]))
    return missing.groupBy("key").agg(F.array_join(terms, ",").alias("details")).select("key", F.lit("glossary_lemma_mismatch").alias("code"), F.lit("warn").alias("severity"), "details", F.lit(mode).alias("mode"))


def fewer_missing(before: DataFrame, after: DataFrame) -> DataFrame:
    """``key, before, after, accept``: a second attempt is taken only where it lacks fewer terms than the first."""
    n = lambda df, c: df.groupBy("key").agg(F.count("*").alias(c))
    j = n(before, "before").join(n(after, "after"), "key", "full").na.fill(0)
    return j.withColumn("accept", F.col("after") < F.col("before"))


def downgraded(rows: DataFrame) -> DataFrame:
    """Errors as warnings under a code that tells it."""
    e = F.col("severity") == "error"
    return rows.withColumn("code", F.when(e, F.concat("code", F.lit("_downgraded"))).otherwise(F.col("code"))).withColumn("severity", F.when(e, "warn").otherwise(F.col("severity")))


def histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("code", "severity").agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, limit: int = 12) -> DataFrame:
    """``code, n``: the most frequent codes; ties fall to the smaller code."""
    return rows.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "code").limit(limit)


def attach(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Issues on segments: those without a key go to the first segment, those with an unknown one are dropped."""
    first = segments.agg(F.min_by("segment_id", F.struct("doc_id", "seq")).alias("_first"))
    known = segments.select("segment_id").distinct()
    return rows.crossJoin(F.broadcast(first)).withColumn("segment_id", F.coalesce("key", "_first")).drop("_first").join(known, "segment_id")
