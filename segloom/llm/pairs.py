"""Problems 1 and 3: truncated texts and defective prompt and response pairs.

Truncation. Texts that lack a final mark are suspects; a self-join by prefix finds the cut ones among them:

* every word of every sentence of the corpus is keyed by the hash of the two words before it (marks
  of a sentence's start where there are fewer), a prefix of fixed length. A suspect's last word, whole or
  cut, is looked up under the hash of the two words before it: the suspect is a strict prefix of
  other copies where they go on, in that word or behind it, and a complete text where they end with it;
* copies that only go on show a cut text. Only where they do both, or where none is known and all that is
  known is that the last word is the start of other words, or where the source lacks the
  final mark as well, the terminal context breaks the tie: over all pairs it is counted which last word
  follows which last words of the source; a text that stops elsewhere than its source has
  stopped too early. Counted are distinct pairs of texts, so copies of a cut text don't make its
  last word an end.

The other defects are found text by text: no letters or digits; a message of refusal, by
dictionaries of openings, inability and subject; a copy, by the size of the response compressed
with its prompt as a zstandard dictionary, held against that of the prompt itself; another language, by
script, letters and function words.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import current_memory, table

#: Words of the fixed-length prefix under which continuations are looked up.
PREFIX_WORDS = 2
#: A last word that no copy has at its place is the start of another word if such words are so many times as frequent as itself.
RARER = 20
#: A last word with at least this share after its source's last words is an end like others; under SEEN texts the share says nothing.
LEAST_SHARE, SEEN = 0.02, 8

_MARKER = re.compile("⟦[^⟧]*(?:⟧|$)")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\w+")
_ORDINARY = re.compile(r"(?<![\w\-/])[A-Za-zÀ-ž]{3,}+(?![\w]*\d)(?!-\d)")

#: The dictionaries of refusals.
OPENINGS = (
    r"\b(?:sorry|apolog\w+|unfortunately|(?:i'm|i am|im) afraid|regret\w*|hello|к сожалению|извините\w*|простите|прошу прощения|увы|боюсь|сожалею|здравствуйте|приношу извинения"
    r"|désolé\w*|malheureusement|leider|entschuldig\w+|tut mir leid|на жаль|вибачте|перепрошую)\b"
)
INABILITY = (
    r"(?:\bi (?:can(?:no|')?t|cannot|can not|am (?:un|not )able|must decline|do not have|don't have|won't|will not|am not allowed)|\b(?:un|not )able to (?:provide|translate|process|help|assist|answer)|must decline|decline to"
    r"|no translation|cannot be (?:processed|translated)|can(?:no|')t (?:translate|help|assist|provide|process|answer)|against my|not (?:be )?(?:possible|permitted|allowed) to translate|enough context|refuse to"
    r"|не могу|не можем|не вправе|не в состоянии|невозможно|не имею возможности|не хватает|не удалось|не получилось|не предоставлен|отклон[её]н|нарушает правила|ответа не будет|не буду|не способен|отказ\w* (?:от|в|перев)|не переведен|перевода не"
    r"|ne peux pas|impossible de|kann (?:ich )?(?:\w+ )?nicht|nicht möglich|не можу)"
)
SUBJECT = (
    r"(?:translat|перев[оеё][дс]|перевест|traduc|traduire|übersetz|запрос|request|фрагмент|passage|assist|помочь|ответ|answer|сообщени|контекст|context|guideline|правил|инструкци|языков\w+ модел|language model|"
    r"\bcontent\b|\binput\b|обработать текст|process)"
)
_REFUSAL = [re.compile(x) for x in (INABILITY, OPENINGS, SUBJECT)]  # for lower-case texts

#: Letters that Russian lacks, and function words of its neighbours.
FOREIGN_LETTERS = set("іїєґўјљњћђџќѓѕ")
FOREIGN_WORDS = {"якщо", "щоб", "після", "допомогою", "калі", "пасля", "преди", "който", "бъде", "како", "ако", "што", "със", "није"}


def strip_markers(text: str) -> str:
    return _MARKER.sub("", text)


def is_refusal(text: str) -> bool:
    """Two of the three dictionaries speak of it: inability with one of the others, or an opening with the subject."""
    inability, opening, subject = _REFUSAL
    if inability.search(text):
        return bool(opening.search(text) or subject.search(text))
    return bool(opening.search(text) and subject.search(text))


#: Each character as four bytes without regularity, so that texts of a few letters are long enough to compress and equal letters alone don't.
_SPREAD = np.random.default_rng(11).integers(0, 1 << 32, size=1 << 16, dtype=np.uint32)
#: Share of the prompt's size that a copy may cost beyond what the prompt itself costs.
COPY_SLACK = 0.1


def _spread(words: list[str]) -> bytes:
    return _SPREAD[np.frombuffer(" ".join(words).encode("utf-16-le"), dtype=np.uint16)].tobytes()


def is_copy(source: str, target: str) -> bool:
    """The target is the source but for case, spacing, marks and a lead-in of at most two words; the source has ordinary words.

    With the source as dictionary the target costs hardly more than the source itself. Texts of other lengths can't be one.
    """
    if not _ORDINARY.search(source):
        return False
    s, t = _TOKEN.findall(source.lower()), _TOKEN.findall(target.lower())
    prompt = _spread(s)
    few = len(prompt) * COPY_SLACK
    leads = [x for x in (_spread(t[k:]) for k in range(min(3, len(t)))) if abs(len(x) - len(prompt)) <= few]
    if not leads:
        return False
    rule = zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    cost = zstandard.ZstdCompressor(level=3, dict_data=rule, write_content_size=False).compress
    return min(len(cost(x)) for x in leads) - len(cost(prompt)) <= few


_NOT_LATIN, _NOT_CYRILLIC = re.compile(r"[^a-zà-öø-ž]+"), re.compile(r"[^а-яёіїєґўјљњћђџќѓѕ]+")
_FOREIGN = re.compile(rf"\w*[{''.join(sorted(FOREIGN_LETTERS))}]\w*|\b(?:{'|'.join(sorted(FOREIGN_WORDS))})\b")


def is_other_language(target: str, latin: int, cyrillic: int) -> bool:
    """Whether a text of so many Latin and Cyrillic letters is in another language than Russian."""
    if cyrillic > latin:
        hits = _FOREIGN.findall(target.lower())
        return len(hits) >= 2 or len(hits) == 1 and cyrillic < 60 and any(c in FOREIGN_LETTERS for c in hits[0])
    plain = [w for w in _ORDINARY.findall(target) if not w.isupper() or target.isupper()]
    return len(plain) >= 2 and sum(map(len, plain)) > cyrillic


def label(source: str | None, target: str) -> str | None:
    """The defect of a pair apart from truncation; the first that holds."""
    t = strip_markers(target) if "⟦" in target else target
    low = t.lower()
    latin, cyrillic = len(_NOT_LATIN.sub("", low)), len(_NOT_CYRILLIC.sub("", low))
    if not latin and not cyrillic and not any(c.isalnum() for c in t):
        return "empty"
    if is_refusal(low):
        return "refusal"
    if source and latin and latin >= cyrillic and is_copy(source, t):
        return "copied_source"
    if source and is_other_language(t, latin, cyrillic):
        return "wrong_language"
    return None


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """``table_name, record_key, grp, src, tgt`` of segments and current memory rows with a target; ``grp`` is the config or the origin."""
    a = table(spark, d, "segments").select(F.lit("segments").alias("table_name"), F.col("segment_id").alias("record_key"), F.col("config_id").cast("string").alias("grp"), F.col("source_plain").alias("src"), F.col("target_tagged").alias("tgt"))
    m = current_memory(spark, d, "meta_json")
    b = m.select(F.lit("tm_exact").alias("table_name"), F.col("source_hash").alias("record_key"), F.get_json_object("meta_json", "$.origin").alias("grp"), F.col("source_norm").alias("src"), F.col("target_text").alias("tgt"))
    return a.unionByName(b).where(F.col("tgt").isNotNull())


#: Between two sentences, as regular expression.
_BETWEEN = r"(?<=[.!?])\s+(?=[\p{Lu}\d«(])"


def _tails(df: DataFrame) -> DataFrame:
    """Columns about the ends of both texts.

    ``body`` is the target without markers and without marks of a cut, ``mark`` whether it had any (a source that ends
    alike explains them), ``final`` whether it ends with a final mark, ``t1`` its last word; ``s2, s1`` are the last words
    of the source sentence at the place of the target's last one, ``fewer`` whether the target has fewer sentences,
    ``closed`` whether the source ends with a final mark, ``broken_code`` whether the last token is the start of a code of the source.
    """
    clean = F.regexp_replace(F.regexp_replace("tgt", "⟦[^⟧]*(⟧|$)", ""), r"[\p{Cf}]", "")
    df = df.withColumn("_clean", F.regexp_replace(clean, r"(?U)(?<!\s)\s+$", ""))
    # Each pattern starts only at the start of a run, so that long runs take linear time.
    tail = r"(?U)(?<![\s\x{FFFD}….])[\s\x{FFFD}….]+$"
    df = df.withColumn("body", F.when(F.regexp_extract("_clean", tail, 0).rlike(r"\.\.|[…\x{FFFD}]"), F.regexp_replace("_clean", tail, "")).otherwise(F.col("_clean")))
    mark = (F.col("body") != F.col("_clean")) & ~F.col("src").rlike(r"(…|\.{2,})\s*$") | F.col("tgt").rlike("⟦[^⟧]*$")
    df = df.withColumn("mark", mark).withColumn("final", F.col("body").rlike(r"[.!?][»”\"')\]]*$") & ~mark)
    df = df.withColumn("closed", F.col("src").rlike(r"[.!?][»”\"')\]]*\s*$"))
    df = df.withColumn("_ss", F.split("src", _BETWEEN)).withColumn("parts", F.split("body", _BETWEEN)).withColumn("_nt", F.size("parts"))
    df = df.withColumn("_s", F.regexp_replace(F.lower(F.coalesce(F.get("_ss", F.col("_nt") - 1), "src")), r"\s*\([^()]{0,60}\)\s*\.?\s*$", "")).withColumn("fewer", F.col("_nt") < F.size("_ss"))
    # The last words are read from the last blank-separated tokens, of whatever length.
    last = lambda c, n: F.array_join(F.slice(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""), -n, n), " ")
    tokens = lambda c, n: F.when(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")) >= n, last(c, n)).otherwise(c)
    end = F.lower(tokens(F.element_at("parts", -1), 2))
    df = df.withColumn("_st", tokens(F.col("_s"), 3))
    df = df.withColumn("s1", F.regexp_extract("_st", r"(?U)(\w+)\W*$", 1)).withColumn("s2", F.regexp_replace(F.regexp_extract("_st", r"(?U)(\w+)\W+\w+\W*$", 1), r".*\d.*", "#"))
    df = df.withColumn("t1", F.regexp_extract(end, r"(?U)(\w+)\W*$", 1)).withColumn("code", F.regexp_extract(end, r"(?U)([\w\-]*\w)[^\w]*$", 1))
    # A last token that is a strict prefix of a code of the source has lost the rest of it.
    blank = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"(?U)[^\w\-]+", " "), F.lit(" "))
    of_code = F.contains(blank(F.col("src")), F.concat(F.lit(" "), "code")) & ~F.contains(blank(F.col("src")), F.concat(F.lit(" "), "code", F.lit(" ")))
    df = df.withColumn("broken_code", F.when(~F.col("final") & F.col("code").rlike("[a-z0-9]"), of_code).otherwise(False))
    return df.drop("_clean", "_ss", "_nt", "_s", "_st", "code")


def _sentence(text) -> F.Column:
    """Lower case, every token with a digit as one mark, white space as one blank."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)(?<![\w\-])(?=[\w\-]*\d)[\w\-]+", "#"), r"(?U)\s+", " ")


#: Marks of a sentence's start and end in the prefix join.
_START, _END = "\x02", "\x03"


def _words(sentence) -> F.Column:
    """Words of a sentence behind marks of its start, as many as a prefix has."""
    return F.concat(F.array(*[F.lit(_START)] * PREFIX_WORDS), F.filter(F.split(sentence, " "), lambda x: x != ""))


def _prefix(w, i) -> F.Column:
    return F.xxhash64(*(F.get(w, i - k) for k in range(PREFIX_WORDS, 0, -1)))


def _prefix_evidence(suspects: DataFrame, texts: DataFrame) -> DataFrame:
    """Of suspects' fragments: ``frag, longer, whole, starts``.

    Counts of distinct sentences that go on where the fragment ends, that end with it, and (word for word, whatever
    stands before) of occurrences of words that start with its last word, if these are RARER times as many as those of the word itself.
    """
    f = suspects.select("frag").distinct().withColumn("w", _words(F.regexp_replace("frag", "[.!?;:,]+$", "")))
    f = f.where(F.size("w") > PREFIX_WORDS).select("frag", _prefix("w", F.size("w") - 1).alias("key"), F.element_at("w", -1).alias("rest"))
    # Only sentences that the final mark closes show where a sentence ends; an open one is evidence of longer copies only.
    s = texts.select(F.explode("parts").alias("s")).select(_sentence(F.col("s")).alias("s")).where(F.length("s") > 0).groupBy("s").agg(F.count("*").alias("n"))
    closed = F.col("s").rlike("[.!?;:]$")
    s = s.select("n", F.when(closed, F.concat(F.regexp_replace("s", "[.!?;:]+$", ""), F.lit(_END))).otherwise(F.col("s")).alias("s")).select("n", _words(F.col("s")).alias("w"))
    last = F.size("w") - 1
    at = F.transform(F.sequence(F.lit(PREFIX_WORDS), last), lambda i: F.struct(_prefix("w", i).alias("key"), F.concat(F.get("w", i), F.when(i < last, F.lit(" ")).otherwise(F.lit(""))).alias("next")))
    steps = materialize(s.where(last >= PREFIX_WORDS).select("n", F.explode(at).alias("x")).groupBy("x.key", "x.next").agg(F.sum("n").alias("n")))
    n, next_, rest = F.col("n"), F.col("next"), F.col("rest")
    whole = next_ == F.concat(rest, F.lit(_END))
    hit = f.join(steps, "key").where(F.startswith(next_, rest)).groupBy("frag").agg(F.sum(F.when(~whole & (F.length(next_) > F.length(rest)), n).otherwise(0)).alias("longer"), F.sum(F.when(whole, n).otherwise(0)).alias("whole"))
    hit = hit.where("longer + whole > 0")  # a fragment meets itself
    # Where no copy has the fragment's end: its last word held against all words, by the hash of its first letters, a prefix of fixed length again.
    # A word at an open end may be cut itself, so only others count as that word.
    bare = F.regexp_replace("next", f"[ ,{_END}]+$", "")
    words = steps.groupBy(bare.alias("word")).agg(F.sum(F.when(next_ != bare, n).otherwise(0)).alias("n"))
    alone = f.join(hit, "frag", "left_anti").select("frag", "rest", F.left("rest", F.lit(1)).alias("first"))
    tails = alone.select("rest", "first").distinct()
    starts = tails.join(words.withColumn("first", F.left("word", F.lit(1))), "first").where(F.startswith("word", rest)).groupBy("rest").agg(F.sum(F.when(F.length("word") > F.length(rest), F.col("n")).otherwise(0)).alias("starts"), F.sum(F.when(F.col("word") == rest, F.col("n")).otherwise(0)).alias("same"))
    only = alone.join(starts.where(F.col("starts") >= RARER * F.col("same")), "rest", "left").select("frag", F.lit(0).cast("bigint").alias("longer"), F.lit(0).cast("bigint").alias("whole"), F.coalesce("starts", F.lit(0)).alias("starts"))
    return hit.withColumn("starts", F.lit(0).cast("bigint")).unionByName(only)


def _tie_counts(texts: DataFrame) -> DataFrame:
    """``s2, s1, t1, k, f, r``: of the last words of sources and targets the distinct pairs of texts, those with a final mark, and the rows.

    Totals have nulls: of ``s2, s1`` with any last word, of ``s1, t1``, and of ``s1`` alone.
    """
    pairs_ = texts.groupBy("s2", "s1", "t1", "pair").agg(F.max(F.col("final").cast("int")).alias("f"), F.count("*").alias("r"))
    return pairs_.groupBy("s2", "s1", "t1").agg(F.count("*").alias("k"), F.sum("f").alias("f"), F.sum("r").alias("r"))


def _with_share(ties: DataFrame, counts: DataFrame) -> DataFrame:
    """Suspects with ``p``, the share of their last word after their source's last words; null where too little is known."""
    z = lambda c: F.coalesce(c, F.lit(0))
    total = lambda keys, n: counts.groupBy(*keys).agg(F.sum("k").alias(f"k{n}"), F.sum("r").alias(f"r{n}"))
    known = ties.join(counts.select("s2", "s1", "t1", F.col("k").alias("kt2"), F.col("r").alias("rt2")), ["s2", "s1", "t1"], "left").join(total(["s2", "s1"], "n2"), ["s2", "s1"], "left")
    known = known.join(total(["s1", "t1"], "t1"), ["s1", "t1"], "left").join(total(["s1"], "n1"), "s1", "left")
    own = (~F.col("mark")).cast("int")  # the text of a suspect without a mark counts itself
    share = lambda k, n: F.when(F.col(n) - own >= SEEN, (z(F.col(k)) - own) / (F.col(n) - own))
    same_code = F.when(F.col("s1").rlike(r"\d"), (F.col("s1") == F.col("t1")).cast("double"))
    # Headings have no final mark and repeat as they are: where the source has none either, the rows count too.
    rows_share = F.when(~F.col("closed"), F.coalesce(share("rt2", "rn2"), share("rt1", "rn1")))
    usual = F.greatest(F.coalesce(share("kt2", "kn2"), share("kt1", "kn1")), rows_share)  # without nulls
    # A text without a final mark that lacks whole sentences too stopped within its last one.
    return known.withColumn("p", F.when(~F.col("fewer"), F.coalesce(same_code, usual)).otherwise(F.lit(0.0)))


def defects(all_pairs: DataFrame) -> DataFrame:
    """``table_name, record_key, grp, defect_type`` (null where none) of all pairs with a target.

    Repeated rows repeat. A null source is an empty one: its target can be empty, a refusal or in another language.
    """
    udf = F.pandas_udf(lambda s, t: pd.Series([label(a, b) for a, b in zip(s, t)]), "string")
    rows = _tails(all_pairs.withColumn("src", F.coalesce("src", F.lit("")))).withColumn("other", udf("src", "tgt"))
    frag = F.when(~F.col("final") & F.col("other").isNull(), _sentence(F.element_at("parts", -1)))
    keep = rows.select("table_name", "record_key", "grp", "other", "mark", "final", "s1", "s2", "t1", "fewer", "closed", "broken_code", "parts", F.xxhash64("src", "tgt").alias("pair"), frag.alias("frag"))
    keep = materialize(keep)
    suspects = keep.where(F.col("frag").isNotNull()).select("table_name", "record_key", "mark", "closed", "fewer", "broken_code", "s1", "s2", "t1", "frag")
    evidence = materialize(_prefix_evidence(suspects, keep.select("parts")))
    seen = suspects.join(evidence, "frag")
    cut = F.col("closed") & ((F.col("longer") > 0) & (F.col("whole") == 0) | F.col("broken_code"))
    sure = seen.where(cut).select("table_name", "record_key")
    # Ties: copies that go on and copies that end, no copy at all, or a source without a final mark.
    none = (F.col("longer") == 0) & (F.col("whole") == 0) & ((F.col("starts") > 0) | F.col("fewer"))
    ties = seen.where(~cut & ((F.col("longer") > 0) | F.col("closed") & none))
    counts = materialize(_tie_counts(keep.where(F.col("other").isNull() & ~F.col("mark"))))
    unusual = ~F.coalesce(F.col("p") >= LEAST_SHARE, F.lit(False))
    open_known = F.col("closed") | F.col("p").isNotNull() | F.col("mark") | F.col("broken_code")
    found = sure.unionByName(_with_share(ties, counts).where(unusual & open_known).select("table_name", "record_key")).distinct().withColumn("cut", F.lit(True))
    return keep.join(found, ["table_name", "record_key"], "left").select("table_name", "record_key", "grp", F.coalesce("other", F.when(F.col("cut") & ~F.col("final"), F.lit("truncated"))).alias("defect_type"))
