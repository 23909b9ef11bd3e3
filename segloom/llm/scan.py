"""Problem 6: noise in text from scanned pages, and its repair into paragraphs.

Running lines and page numbers are known from the page margins; lines inside texts are matched
with them. Words divided over two lines are joined unless the mark is their own. Misread words
are found with a symmetric-delete index over the corpus frequency lexicon: the candidates of a
word share a string with it once up to one character of either is deleted, after both are
written in a form in which confused shapes are equal. A weighted edit distance with confusion
pairs verifies them, and the counts of the word before (bigrams) pick the repair. An edit that is no
confusion needs a long word and bigrams that speak for it, and must not be an inflection.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from ..sources.tables import keep_latest

#: Share of the page height at the top and bottom that holds running lines and page numbers.
MARGIN = 0.08
#: A candidate occurs at least so often, and so many times as often as the misread word.
LEAST_COUNT, RATIO = 5, 10
#: The most frequent words, which are sent to the tasks to pass them by; a longer list changes no result.
COMMON_WORDS = 20_000
#: Largest weighted distance of a repair: a confusion costs CONFUSED, another edit 1.
CONFUSED, LARGEST = 0.25, 1.0
#: In words of at least so many letters, one other edit and a confusion, or so many confusions more, are within reach.
LONG_WORD, LARGEST_LONG = 6, 1.25

#: Shapes that scans confuse, each with the plainer shape it is written as.
SHAPES = [
    ("m", "rn"), ("n", "ri"), ("u", "ii"), ("d", "cl"), ("w", "vv"),
    ("i", "l"), ("1", "l"), ("|", "l"), ("!", "l"), ("0", "o"), ("5", "s"), ("$", "s"), ("6", "b"), ("8", "b"), ("h", "b"),
    ("9", "g"), ("q", "g"), ("e", "c"), ("f", "t"), ("7", "t"), ("2", "z"), ("j", "l"),
]

_DIGITISH = r"[\dlIOoSsBZ|]"
_PAGE = re.compile(
    rf"(?:[-–—•\[(]\s*)?(?:(?:page|pag\.?|p\.|pg\.?|seite|s\.|стр\.?|страница|с\.|лист)\s*(?={_DIGITISH}))?(?:{_DIGITISH}*\d{_DIGITISH}*|{_DIGITISH}{{1,4}}(?=\s*(?:of|из|/))|(?<=[a-zа-я.] ){_DIGITISH}{{1,4}}(?![^\W\d_]))(?:\s*(?:-|–|/|of|von|из)\s*{_DIGITISH}*\d{_DIGITISH}*)?(?:\s*[-–—•\])])?|[ivxlc]{{1,7}}",
    re.I,
)
_PAGE_TAIL = re.compile(rf"\s{{2,}}(?:{_PAGE.pattern})$", re.I)
_PAGE_NEXT = re.compile(r"[-–]\s*\d|page|стр|of", re.I)
_BREAK = re.compile(r"(?<![A-Za-zА-Яа-яЁё0-9])([A-Za-zА-Яа-яЁё0-9]+)([-‐‑­¬])[ \t]*\n[ \t]*([a-zа-яё0-9]+)")
# The signs ! and $ belong to a word only where it goes on behind them.
_PART = r"(?:[!$](?=[a-z]))?[A-Za-z0-9|]+(?:[!$]+[A-Za-z0-9|]+)*"
_TOKEN = re.compile(rf"{_PART}(?:-{_PART})*")
_INFLECTED = re.compile(r"(?:s|es|d|ed|r|er|n|en|y|ly|e|ing|al|or)?")


@lru_cache(maxsize=200_000)
def shape(word: str) -> str:
    w = word.lower()
    for a, b in SHAPES:
        w = w.replace(a, b)
    return w


def is_page_number(line: str) -> bool:
    """A line of nothing but a page number; a bare roman number counts only where it is lower case or alone."""
    t = line.strip()
    return 0 < len(t) <= 24 and _PAGE.fullmatch(t) is not None


def running_key(line: str) -> str:
    """What is the same in all occurrences of a running line: its shape without the page number and spaces."""
    t = _PAGE_TAIL.sub("", line.strip())
    return re.sub(r"\s+", "", shape(t))


def is_word(token: str) -> bool:
    """A token that may be a (misread) word, no code: small letters prevail, or all are capital letters with at most one other sign."""
    letters = sum(c.isalpha() for c in token)
    other = len(token) - letters
    if letters < 1 or other > letters or (len(token) < 3 and other and not token[-1].islower() and not token[0].islower()):
        return False
    return not other or token[1:].upper() != token[1:] or (other == 1 and letters >= 4)


def split_lines(text: str, running: set[int] | None = None) -> tuple[list[str], bool]:
    """Lines without running lines (their numbers are given) and page numbers; whether there was a page number.

    A page number inside a text is a line of its own between, before or behind others.
    """
    lines = text.split("\n")
    if len(lines) == 1:
        return lines, False
    keep, number = [], False
    for i, line in enumerate(lines):
        if running and i in running:
            continue
        if is_page_number(line) and not (len(lines) == 2 and all(is_page_number(x) for x in lines)):
            number = True
            continue
        keep.append(line)
    return keep, number


def divided_shapes(lines: list[str]) -> list[str]:
    """The shapes that words divided over two lines have with their mark."""
    return list({shape(f"{m[1]}-{m[3]}") for m in _BREAK.finditer("\n".join(lines))})


def join_broken(lines: list[str], compounds: set[str]) -> tuple[str, int]:
    """The text with divided words joined, and how many there were. A hyphen of the word's own stays: one of the compounds, or before digits."""
    n = 0

    def one(m: re.Match) -> str:
        nonlocal n
        a, mark, b = m.groups()
        if not a[-1].isalpha() and not any(c.isalpha() for c in a) or not any(c.isalpha() for c in b):
            return f"{a}{mark}{b}"
        before = re.search(r"[\w-]*$", m.string[max(0, m.start() - 64) : m.start()]).group()
        if mark in "-‐‑":
            if shape(f"{a}-{b}") in compounds or (sum(c.isdigit() for c in a) > 1 and sum(c.isdigit() for c in a) * 2 >= len(a)) or before.endswith("-") and any(c.isdigit() for c in before):
                return f"{a}-{b}"
        n += 1
        return a + b

    return _BREAK.sub(one, "\n".join(lines)), n


def words_of(text: str) -> Iterator[tuple[str, str]]:
    """Words that may be misread, with the word before; both in lower case, '' at the start."""
    before = ""
    for m in _TOKEN.finditer(text):
        token = m.group()
        if "-" in token and any(sum(c.isdigit() for c in p) * 2 > len(p) for p in token.split("-")):
            before = "#"
            continue
        for part in token.split("-"):
            if is_word(part):
                yield before, part.lower()
                before = part.lower()
            else:
                before = "#"


def weighted_distance(a: str, b: str) -> float:
    """Edit distance of two words in which confused shapes cost CONFUSED for each place, other edits 1."""
    a, b = a.lower(), b.lower()
    pairs = {}
    for x, y in SHAPES:
        pairs.setdefault(shape(x), set()).update((x, y))
    width = 2
    row = {(0, 0): 0.0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            best = row.get((i, j), 1e9) if i == j == 0 else 1e9
            if i and j and a[i - 1] == b[j - 1]:
                best = min(best, row[i - 1, j - 1])
            for p in range(0, width + 1):
                for q in range(0, width + 1):
                    if (p or q) and p <= i and q <= j:
                        x, y = a[i - p : i], b[j - q : j]
                        if p and q and x != y and shape(x) == shape(y):
                            best = min(best, row[i - p, j - q] + CONFUSED)
                        elif p <= 1 and q <= 1:
                            best = min(best, row[i - p, j - q] + 1)
            row[i, j] = best
    return row[len(a), len(b)]


def _deletes(word: str) -> list[str]:
    """The shape of a word, and its shapes without one letter."""
    return list({shape(word), *(shape(word[:i] + word[i + 1 :]) for i in range(len(word)))}) if len(word) > 3 else [shape(word)]


def inflected(a: str, b: str) -> bool:
    """The words differ at most in an ending, or one has another first letter or one more: different words rather than a misread one."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return n == 0 or _INFLECTED.fullmatch(a[n:]) is not None and _INFLECTED.fullmatch(b[n:]) is not None


def margin_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct blocks with ``margin``: in the top or bottom MARGIN of the page. A page without known height has no margins."""
    height = pages.groupBy("doc_id", "page_number").agg(F.max("height_pt").alias("height_pt"))
    b = blocks.select("doc_id", "page_number", "block_id", "x0", "y0", "x1", "y1", "text", "column_index").distinct().join(height, ["doc_id", "page_number"], "left")
    return b.withColumn("margin", F.coalesce((F.col("y1") <= F.col("height_pt") * MARGIN) | (F.col("y0") >= F.col("height_pt") * (1 - MARGIN)), F.lit(False))).drop("height_pt")


def scanned_records(segments: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``table_name, record_key, text, margin`` of blocks and of the segments made from them."""
    b = margin_blocks(blocks, pages).select(F.lit("pdf_blocks").alias("table_name"), F.concat_ws("/", "doc_id", "page_number", "block_id").alias("record_key"), "text", "margin")
    s = segments.where(F.col("location").startswith("pdf/")).select(F.lit("segments").alias("table_name"), F.col("segment_id").alias("record_key"), F.col("source_plain").alias("text"), F.lit(False).alias("margin"))
    return b.unionByName(s).where(F.length(F.trim("text")) > 0)


@F.pandas_udf(T.StringType())
def _running_key(s: pd.Series) -> pd.Series:
    return s.map(running_key)


@F.pandas_udf(T.BooleanType())
def _page_number(s: pd.Series) -> pd.Series:
    return s.map(is_page_number)


def with_noise_lines(records: DataFrame) -> DataFrame:
    """Records with ``running`` (numbers of running lines inside the text), ``is_running`` and ``is_number`` (the margin block as a whole)."""
    single = records.where("margin").withColumn("is_number", _page_number("text")).withColumn("is_running", ~F.col("is_number"))
    known = single.where("is_running").select(F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) > 0).select(_running_key("line").alias("k")).where(F.length("k") >= 6).distinct()
    body = records.where(~F.col("margin"))
    lines = body.where(F.contains("text", F.lit("\n"))).select("table_name", "record_key", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.length("line") >= 5)
    hits = lines.withColumn("k", _running_key("line")).join(known, "k").groupBy("table_name", "record_key").agg(F.collect_set("no").alias("running"))
    inner = body.join(hits, ["table_name", "record_key"], "left").withColumn("is_number", F.lit(False)).withColumn("is_running", F.lit(False))
    return inner.unionByName(single.withColumn("running", F.lit(None).cast("array<int>")))


def lexicon(texts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``w, n`` of all words and ``k, n`` of the shapes of all hyphenated words within a line, counted over all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for t in b.iloc[:, 0]:
                for line in t.split("\n"):
                    for m in _TOKEN.finditer(line):
                        token = m.group()
                        if "-" in token:
                            if not any(ch.isdigit() for ch in token):
                                c["-", token.lower()] += 1
                            parts = token.split("-")
                        else:
                            parts = (token,)
                        # The last word of a line may be the half of a divided one.
                        c.update(("", p.lower()) for p in parts if is_word(p))
            if len(c) > 300_000:
                yield pd.DataFrame([(k, w, n) for (k, w), n in c.items()], columns=["kind", "w", "n"])
                c.clear()
        yield pd.DataFrame([(k, w, n) for (k, w), n in c.items()], columns=["kind", "w", "n"])

    counts = materialize(texts.select(text).where(F.col(text).isNotNull()).mapInPandas(run, "kind string, w string, n long").groupBy("kind", "w").agg(F.sum("n").alias("n")))
    return counts.where("kind = ''").select("w", "n"), counts.where("kind = '-'").select("w", "n")


@F.pandas_udf(T.StringType())
def _shape(s: pd.Series) -> pd.Series:
    return s.map(shape)


def _compounds(hyphenated: DataFrame, words: DataFrame) -> DataFrame:
    """``k``: shapes of all hyphenated words seen twice and not rarer than the same letters without the hyphen."""
    plain = words.select(F.col("w").alias("j"), F.col("n").alias("nj"))
    h = hyphenated.where("n >= 2").withColumn("j", F.regexp_replace("w", "-", "")).join(plain, "j", "left").where("n >= coalesce(nj, 0)")
    return h.select(_shape("w").alias("k")).distinct()


def _expand(words: DataFrame) -> DataFrame:
    udf = F.pandas_udf(lambda s: s.map(_deletes), "array<string>")
    return words.withColumn("key", F.explode(udf("w")))


def corrections(words: DataFrame) -> DataFrame:
    """``w, c, nc, distance, plain``: candidates of each misread word, by the symmetric-delete index over the lexicon; ``plain`` where more than confusions differ."""
    good = words.where((F.col("n") >= LEAST_COUNT) & F.col("w").rlike(r"^\p{L}+$") & (F.length("w") > 1))
    a = _expand(good.withColumnRenamed("n", "nc").select("w", "nc")).select(F.col("w").alias("c"), "nc", "key")
    b = _expand(words).select("w", "n", "key")
    cand = b.join(a, "key").where((F.col("w") != F.col("c")) & (F.col("nc") >= F.col("n") * RATIO) & (F.abs(F.length("w") - F.length("c")) <= 4)).select("w", "n", "c", "nc").distinct()
    dist = F.pandas_udf(lambda x, y: pd.Series([weighted_distance(p, q) for p, q in zip(x, y)], dtype="float64"), "double")
    # Words of two letters are taken for misread only against far more frequent ones.
    strict = (F.length("w") > 2) | (F.col("nc") >= F.col("n") * RATIO * 5)
    plain = F.pandas_udf(lambda x, y: pd.Series([shape(p) != shape(q) for p, q in zip(x, y)], dtype="bool"), "boolean")
    apart = F.pandas_udf(lambda x, y: pd.Series([not inflected(p, q) for p, q in zip(x, y)], dtype="bool"), "boolean")
    long = F.least(F.length("w"), F.length("c")) >= LONG_WORD
    found = cand.where(strict).withColumn("plain", plain("w", "c")).where(~F.col("plain") | long & apart("w", "c")).withColumn("distance", dist("w", "c"))
    return found.where((F.col("distance") < LARGEST) & ~F.col("plain") | long & (F.col("distance") <= LARGEST_LONG))


def clean_bodies(noisy: DataFrame, compounds: DataFrame) -> DataFrame:
    """Body records with ``clean`` (noise lines gone, divided words joined), ``numbers`` and ``broken``. Divided words meet the whole table of compounds in a join."""
    body = noisy.where(~F.col("margin"))
    kept = lambda t, r: split_lines(t, set(r) if r is not None else None)
    divided = F.pandas_udf(lambda text, running: pd.Series([divided_shapes(kept(t, r)[0]) for t, r in zip(text, running)]), "array<string>")
    ends = body.where(F.col("text").rlike(r"[-‐‑][ \t]*\n")).select("table_name", "record_key", F.explode(divided("text", "running")).alias("k"))
    own = ends.join(compounds, "k").groupBy("table_name", "record_key").agg(F.collect_set("k").alias("own"))

    @F.pandas_udf("struct<clean: string, numbers: boolean, broken: int>")
    def run(text: pd.Series, running: pd.Series, own: pd.Series) -> pd.DataFrame:
        out = []
        for t, r, c in zip(text, running, own):
            lines, number = kept(t, r)
            clean, n = join_broken(lines, set(c) if c is not None else set())
            out.append((clean, number, n))
        return pd.DataFrame(out, columns=["clean", "numbers", "broken"])

    return body.join(own, ["table_name", "record_key"], "left").withColumn("_x", run("text", "running", "own")).select("*", "_x.clean", "_x.numbers", "_x.broken").drop("_x", "own")


def _suspicious(bodies: DataFrame, common: set[str]) -> DataFrame:
    """``table_name, record_key, before, w`` of the words that aren't common."""
    shared = bodies.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(t, k, before, w) for t, k, text in zip(b["table_name"], b["record_key"], b["clean"]) for before, w in words_of(text) if w not in shared.value]
            yield pd.DataFrame(out, columns=["table_name", "record_key", "before", "w"])

    return bodies.select("table_name", "record_key", "clean").mapInPandas(run, "table_name string, record_key string, before string, w string")


def _bigrams(bodies: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for t in b.iloc[:, 0]:
                c.update(words_of(t))
            if len(c) > 300_000:
                yield pd.DataFrame([(x, y, n) for (x, y), n in c.items()], columns=["before", "c", "n"])
                c.clear()
        yield pd.DataFrame([(x, y, n) for (x, y), n in c.items()], columns=["before", "c", "n"])

    return bodies.select("clean").mapInPandas(run, "before string, c string, n long").groupBy("before", "c").agg(F.sum("n").alias("n2"))


def analyse(segments: DataFrame, blocks: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The records with their noise lines, the cleaned bodies, and the repairs ``table_name, record_key, before, w, c``."""
    records = scanned_records(segments, blocks, pages)
    noisy = materialize(with_noise_lines(records))
    corpus = segments.where(~F.col("location").startswith("pdf/") | F.col("location").isNull()).select(F.col("source_plain").alias("text")).unionByName(noisy.where(~F.col("margin")).select("text"))
    _, hyphenated = (first := lexicon(corpus))
    compounds = _compounds(hyphenated, first[0])
    bodies = materialize(clean_bodies(noisy, compounds))
    words, _ = lexicon(corpus.where(~F.contains("text", F.lit("\n"))).unionByName(bodies.select(F.col("clean").alias("text"))))
    fixes = materialize(corrections(words))
    wrong = fixes.select("w").distinct()
    common = {r["w"] for r in words.join(wrong, "w", "left_anti").orderBy(F.col("n").desc(), "w").limit(COMMON_WORDS).collect()}
    found = _suspicious(bodies, common).join(fixes, "w")
    bigrams = materialize(_bigrams(bodies))
    seen = found.join(bigrams, ["before", "c"], "left").join(bigrams.select("before", F.col("c").alias("w"), F.col("n2").alias("nw")), ["before", "w"], "left")
    spoken_for = ~F.col("before").isin("", "#") & (F.coalesce("n2", F.lit(0)) >= LEAST_COUNT) & (F.coalesce("n2", F.lit(0)) >= F.coalesce("nw", F.lit(0)) * RATIO)
    seen = seen.where(~F.col("plain") | spoken_for)
    best = Window.partitionBy("table_name", "record_key", "before", "w").orderBy((F.log1p(F.coalesce("n2", F.lit(0))) * 2 + F.log1p("nc") - F.col("distance") * 4).desc(), "c")
    repairs = seen.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("table_name", "record_key", "before", "w", "c")
    return noisy, bodies, repairs


def noise_kinds(segments: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``table_name, record_key, noise_kind`` of all noisy records; blank and null texts have no noise, repeated blocks count once."""
    noisy, bodies, repairs = analyse(segments, blocks, pages)
    kind = lambda df, cond, name: df.where(cond).select("table_name", "record_key", F.lit(name).alias("noise_kind"))
    out = kind(noisy, F.col("is_running") | F.col("running").isNotNull(), "running_line")
    out = out.unionByName(kind(noisy, F.col("is_number"), "page_number")).unionByName(kind(bodies, F.col("numbers"), "page_number"))
    out = out.unionByName(kind(bodies, F.col("broken") > 0, "broken_word")).unionByName(kind(repairs, F.lit(True), "misread"))
    return out.distinct()


def paragraphs(segments: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, block_id, text``: continuous clean paragraphs of each document, in reading order of the first two keys and the column.

    Blocks that only ``segments`` has count as well: the latest extraction, placed behind the block before it on its page.
    Margins and noise lines are gone, divided and misread words repaired, lines joined by blanks. A block goes on in the
    next one of its page, or the first one of the next page, if it has no final mark and the other starts with a small
    letter; a paragraph may go over any number of page breaks.
    """
    _, bodies, repairs = analyse(segments, blocks, pages)
    b = bodies.select("table_name", "record_key", F.col("text").alias("raw"), "clean")
    fix = repairs.groupBy("table_name", "record_key").agg(F.collect_set(F.struct("before", "w", "c")).alias("fixes"))

    @F.pandas_udf("string")
    def repaired(text: pd.Series, fixes: pd.Series) -> pd.Series:
        return pd.Series([_repair(t, f) for t, f in zip(text, fixes)])

    place = blocks.select("doc_id", "page_number", "block_id", "column_index", "x0", "y0").groupBy("doc_id", "page_number", "block_id").agg(*(F.min(c).alias(c) for c in ("column_index", "x0", "y0")))
    place = place.withColumn("table_name", F.lit("pdf_blocks")).withColumn("record_key", F.concat_ws("/", "doc_id", "page_number", "block_id")).withColumn("raw", F.lit(None).cast("string"))
    place = _with_segments(place, segments)
    t = b.join(fix, ["table_name", "record_key"], "left").withColumn("text", repaired("clean", "fixes")).where(F.length("text") > 0)
    t = t.withColumnRenamed("raw", "body").join(place, ["table_name", "record_key"]).where("raw is null or raw = body").dropDuplicates(["doc_id", "page_number", "block_id", "text"])
    page = Window.partitionBy("doc_id", "page_number").orderBy(F.coalesce("column_index", F.lit(0)), "y0", "x0", "block_id")
    ended = F.col("text").rlike(r"[.!?:;]\W*$")
    t = t.withColumn("ended", ended).withColumn("small", F.col("text").rlike(r"^\p{Ll}")).withColumn("pos", F.row_number().over(page)).withColumn("start", (~(F.col("small") & F.coalesce(~F.lag("ended").over(page), F.lit(False)))).cast("int"))
    t = materialize(t.select("doc_id", "page_number", "block_id", "text", "small", "ended", "pos", "start"))
    # Each block counts the starts of its page before it; a page adds those of the pages before, one row a page.
    pages_ = t.groupBy("doc_id", "page_number").agg(F.sum("start").alias("starts"), F.min_by("small", "pos").alias("small"), F.max_by("ended", "pos").alias("ended"))
    by_page = Window.partitionBy("doc_id").orderBy("page_number")
    over = F.col("small") & F.coalesce(~F.lag("ended").over(by_page) & (F.lag("page_number").over(by_page) == F.col("page_number") - 1), F.lit(False))
    pages_ = pages_.withColumn("over", over.cast("int")).withColumn("offset", F.sum(F.col("starts") - F.col("over")).over(by_page.rowsBetween(Window.unboundedPreceding, 0)) - F.col("starts"))
    t = t.withColumn("_no", F.sum("start").over(Window.partitionBy("doc_id", "page_number").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    t = t.join(pages_.select("doc_id", "page_number", "offset"), ["doc_id", "page_number"]).withColumn("paragraph", F.col("offset") + F.col("_no"))
    g = t.groupBy("doc_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("page_number", "pos", "block_id", "text"))).alias("b"))
    return g.select("doc_id", F.col("b")[0]["page_number"].alias("page_number"), F.col("b")[0]["block_id"].alias("block_id"), F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("text"))


def _with_segments(place: DataFrame, segments: DataFrame) -> DataFrame:
    """Places of blocks, and those of the scanned segments without a block: their latest text ``raw``, at the coordinates of the last block before them on the page."""
    part = lambda i: F.regexp_extract("location", r"^pdf/p(\d+)(?:/s(\d+))?", i)
    s = segments.where(F.col("location").startswith("pdf/") & (F.length(F.trim("source_plain")) > 0))
    s = s.select("doc_id", part(1).try_cast("int").alias("page_number"), F.coalesce(part(2).try_cast("int"), F.col("seq").cast("int")).alias("block_id"), F.lit("segments").alias("table_name"), F.col("segment_id").alias("record_key"), F.col("source_plain").alias("raw"), "extracted_at")
    alone = s.join(place.select("doc_id", "page_number", "block_id"), ["doc_id", "page_number", "block_id"], "left_anti")
    latest = keep_latest(alone, ["doc_id", "page_number", "block_id"], [F.col("extracted_at").desc_nulls_last(), F.col("record_key"), F.col("raw")]).drop("extracted_at")
    before = Window.partitionBy("doc_id", "page_number").orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0)
    return place.unionByName(latest, allowMissingColumns=True).withColumns({c: F.last(c, ignorenulls=True).over(before) if c != "column_index" else F.when(F.col("table_name") == "segments", F.last(c, ignorenulls=True).over(before)).otherwise(F.col(c)) for c in ("column_index", "x0", "y0")})


def _repair(text: str, fixes) -> str:
    """Misread words replaced in the case they were in; white space becomes single blanks."""
    known = {(f["before"], f["w"]): f["c"] for f in fixes} if fixes is not None else {}
    if known:
        by_word = {w: c for (_, w), c in known.items()}
        before = ""

        def one(m: re.Match) -> str:
            nonlocal before
            w = m.group()
            c = known.get((before, w.lower())) or by_word.get(w.lower())
            before = w.lower()
            if c is None:
                return w
            letters = [x for x in w if x.isalpha()]
            return c.upper() if len(letters) > 1 and all(x.isupper() for x in letters) else c.capitalize() if w[0].isupper() or w[0].isdigit() and before == "" else c

        text = re.sub(_PART, one, text)
    return re.sub(r"\s+", " ", text).strip()
