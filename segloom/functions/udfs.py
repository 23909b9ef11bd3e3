"""Functions for SQL: what no built-in function says, under the names ``seq_ratio``, ``shield_text``, ``lemma_missing``, ``split_chunks`` and ``balanced_json``."""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import recover, shield

_WORD = re.compile(r"[A-Za-zА-Яа-яЁё]+")


class SplitChunks:
    """``SELECT * FROM split_chunks(text, limit)``: ``no, chunk`` of whole lines up to the limit; longer lines are cut. Null texts give no rows."""

    def eval(self, text: str, limit: int):
        open_, no = "", 0
        for line in (text or "").splitlines(keepends=True):
            for piece in (line[i : i + limit] for i in range(0, len(line), limit)):
                if open_ and len(open_) + len(piece) > limit:
                    yield no, open_
                    open_, no = "", no + 1
                open_ += piece
        if open_:
            yield no, open_


class BalancedJson:
    """``SELECT * FROM balanced_json(text)``: ``no, chunk`` of the balanced objects in a text, from left to right."""

    def eval(self, text: str):
        yield from enumerate(recover.balanced_chunks(text or ""))


def lemma_missing(lemma: Callable[[str], str]):
    """Whether a text lacks a term: neither the term itself, case ignored, nor all its lemmas. Null texts lack all terms, blank terms are never missing."""

    @F.pandas_udf(BooleanType())
    def run(term: pd.Series, text: pd.Series) -> pd.Series:
        words = lambda x: {lemma(w) or w for w in _WORD.findall(x)}
        out = []
        for a, b in zip(term, text):
            a, b = (a or "").lower().strip(), (b or "").lower()
            out.append(bool(a) and a not in b and not (words(b) and words(a) <= words(b)))
        return pd.Series(out, dtype="bool")

    return run


def register(spark: SparkSession, lemma: Callable[[str], str] | None = None) -> None:
    """Registers all of them; without a function for lemmas a word is its own."""
    ratio = F.pandas_udf(lambda a, b: pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="object"), "double")
    mask = F.pandas_udf(lambda s: pd.Series([None if t is None else shield.mask(t, shield.DEFAULT_RULES)[0] for t in s], dtype="object"), "string")
    spark.udf.register("seq_ratio", ratio)
    spark.udf.register("shield_text", mask)
    spark.udf.register("lemma_missing", lemma_missing(lemma or (lambda w: w)))
    spark.udtf.register("split_chunks", F.udtf(SplitChunks, returnType="no int, chunk string"))
    spark.udtf.register("balanced_json", F.udtf(BalancedJson, returnType="no int, chunk string"))
