"""Problem 7: texts that look the same but differ in their characters.

Classes of look-alike strings are computed by union-find over strings and code points: seed links
come from Unicode data (width and presentation variants, spaces, invisible characters) and from
the table of look-alike letters below, and links are transitive. The representative of a class is
its most frequent member in the corpus. A text is decomposed, rewritten greedily by an automaton
of all class members (longest match first), and composed again.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts with the shape of a Latin letter, each after the letter it looks like.
LETTERS = (
    "AΑА BΒВ CСϹ DᎠ EΕЕ FϜ GԌ HΗН IΙІӀ JЈͿ KΚКК LᏞ MΜМ NΝ OΟО PΡР QԚ SЅ TΤТ UՍ VѴ WԜ XΧХ YΥҮ ZΖ "
    "aаɑ bᖯ cсϲ dԁ eе gɡ hһ iіι jјϳ lӏ nո oоο pрρ qԛ sѕ uυս vνѵ wԝ xхχ yуγ"
)
#: Marks drawn alike.
MARKS = "-‐‑﹣－ '’ʼ＇ \"“”＂ ·•∙⋅"
_KINDS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>", "<small>"}


class UnionFind:
    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        p = self.parent.setdefault(x, x)
        while p != self.parent[p]:
            self.parent[p] = p = self.parent[self.parent[p]]
        return p

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


def invisible(ch: str) -> bool:
    """Format characters and variation selectors, which leave no mark on the screen."""
    return unicodedata.category(ch) == "Cf" or ch in "͏ᅟᅠ឴឵ㅤ" or "︀" <= ch <= "️"


def _seeds(points: list[str]) -> Iterator[tuple[str, str]]:
    for group in LETTERS.split():
        yield from ((group[0], ch) for ch in group[1:])
    for group in MARKS.split():
        yield from ((group[0], ch) for ch in group[1:])
    for ch in points:
        if invisible(ch):
            yield "", ch
        elif unicodedata.category(ch) == "Zs":
            yield " ", ch
        else:
            kind, _, rest = unicodedata.decomposition(ch).partition(" ")
            if kind in _KINDS:
                yield "".join(chr(int(x, 16)) for x in rest.split()), ch


def classes_of(counts: dict[str, int]) -> dict[str, str]:
    """Each member that must be rewritten, with its representative.

    ``counts`` has the code points of the (decomposed) corpus; a string counts as often as its rarest code point.
    Only classes with a member in the corpus matter; ties fall to the smaller string. Invisible characters go.
    """
    uf = UnionFind()
    for a, b in _seeds([c for c in counts if not c.isascii()]):
        uf.union(a, b)
    out = {}
    for members in uf.classes().values():
        if "" in members:
            best = ""
        else:
            best = min(members, key=lambda m: (-min(counts.get(c, 0) for c in m), m))
        out |= {m: best for m in members if m != best}
    return out


@lru_cache(maxsize=4)
def _automaton(rules: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for member, best in rules:
        a.add_word(member, (len(member), best))
    a.make_automaton()
    return a


def rewrite(text: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The text in its one form: decomposed, members replaced left to right by the longest match, composed."""
    t = unicodedata.normalize("NFD", text)
    seen = set()
    while t not in seen:  # a replacement may join with its neighbours to another member
        seen.add(t)
        parts, at = [], 0
        for end, (n, best) in _automaton(rules).iter_long(t):
            parts += [t[at : end + 1 - n], best]
            at = end + 1
        if parts:
            t = unicodedata.normalize("NFD", "".join(parts) + t[at:])
    return unicodedata.normalize("NFC", t)


def code_points(texts: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each code point occurs in all texts. There are at most 1.1 million code points, which bounds the result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            c.update(unicodedata.normalize("NFD", "\n".join(b.iloc[:, 0])))
        yield pd.DataFrame(list(c.items()), columns=["ch", "n"]).astype({"n": "int64"})

    rows = texts.select(text).where(F.col(text).isNotNull()).mapInPandas(run, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n"))
    return {r["ch"]: r["n"] for r in rows.toLocalIterator()}


def with_form(texts: DataFrame, text: str = "text", form: str = "form", rules: tuple | None = None) -> DataFrame:
    """Adds the one form of each text. Null texts have a null form. Plain ASCII texts, which no rule changes, don't leave the JVM.

    A rule whose representative isn't ASCII (where the look-alike is more frequent than the letter) makes all texts take the long way.
    """
    if rules is None:
        rules = tuple(sorted(classes_of(code_points(texts, text)).items()))
    plain = all(not m.isascii() for m, _ in rules)
    udf = F.pandas_udf(lambda s: pd.Series([None if t is None else rewrite(t, rules) for t in s]), "string")
    ascii_only = F.col(text).rlike(r"\A[\x00-\x7f]*\z")
    if not plain:
        return texts.withColumn(form, udf(F.col(text)))
    same = texts.where(ascii_only | F.col(text).isNull()).withColumn(form, F.col(text))
    other = texts.where(~ascii_only).withColumn(form, udf(F.col(text)))
    return same.unionByName(other)


def lookalike_pairs(texts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """Pairs ``key_a < key_b`` of records whose texts have one form but differ in code points.

    Every pair has at least one record whose text differs from its own form, so only those few are joined with all
    records of the form; copies of one text never meet. Only keys and 128 bits of hashes are shuffled. Empty texts
    pair with texts of nothing but invisible characters; null texts pair with nothing; repeated rows count once.
    """
    h = lambda c: F.struct(F.xxhash64(c), F.xxhash64(F.lit(1), F.col(c)))
    rows = with_form(texts.select(key, text).where(F.col(text).isNotNull()), text).select(
        F.col(key).alias("k"), h("form").alias("f"), h(text).alias("t"), (F.col("form") != F.col(text)).alias("changed")
    )
    rows = rows.select("k", "t", "changed", F.col("f.col1").alias("f1"), F.col("f.col2").alias("f2"))
    left = rows.where("changed").select(F.col("k").alias("k1"), F.col("t").alias("t1"), "f1", "f2")
    # Salt of the few, so that a form with many records is joined in several tasks.
    salts = 8
    right = rows.withColumn("s", F.pmod(F.xxhash64("k"), F.lit(salts)))
    left = left.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("s", F.col("s").cast("long"))
    pairs = left.join(right, ["f1", "f2", "s"]).where((F.col("t1") != F.col("t")) & (~F.col("changed") | (F.col("k1") < F.col("k"))) & (F.col("k1") != F.col("k")))
    return pairs.select(F.least("k1", "k").alias("key_a"), F.greatest("k1", "k").alias("key_b")).distinct()
