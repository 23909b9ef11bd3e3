"""Problem 10: texts that are template residue, filler, error pages or script notices.

A regularised linear classifier over hashed word and character n-grams, length, title and
vocabulary features scores each text. It is trained on weak labels, from status codes, phrases and
the forms of unfilled placeholders, of a bounded sample of texts of most hosts, and validated on the
hosts left out. Features of a whole batch of texts are made at once with array operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Labelled texts used for training, at most so many of each label, of at most so many characters each. Bounds of the sample only; all texts are counted and scored whole.
SAMPLE_PER_LABEL, SAMPLE_CHARS = 3_000, 20_000
#: Words that occur in at least this share of all texts without a phrase are known words. A share bounds their number: a text of k different words adds k to the sum of all counts.
KNOWN_SHARE = 0.004
BITS = 20
HELD_OUT_OF = 5
#: Characters that are turned into arrays at once; bounds memory, results do not depend on it.
CHUNK_CHARS = 400_000

_NAME = r"[A-Za-zА-Яа-яЁё][\w.\-]*[\wА-я]"
#: Delimiters around one name: the usual forms of variables in templates, each with what it must hold.
PLACEHOLDERS = {
    "braces": (r"\{\{[{%#!]?\s*[\w.|\- ]{1,60}\}\}|\{%[^%\n]{1,60}%\}|[$#]\{\s*[\w.]{1,60}\s*\}", ["{"]),
    "brace": (rf"\{{\s*{_NAME}\s*\}}", ["{"]),
    "angle": (
        rf"<%[^%\n]{{1,60}}%>|<<\s*[\w.\- ]{{1,60}}>>|<(?!/?(?:a|b|i|u|p|br|hr|em|li|ol|ul|td|th|tr|h[1-6]|img|div|pre|sub|sup|span|code|html|head|body|table|title|strong|script|style)\b){_NAME}>",
        ["<"],
    ),
    "bracket": (r"\[\[\s*[\w.\- ]{1,60}\]\]|\[(?:TODO|INSERT|FIXME|TBD|PLACEHOLDER|FILL IN|ENTER|YOUR|ВСТАВИТЬ|ВСТАВЬТЕ|УКАЗАТЬ|УКАЖИТЕ|EINFÜGEN|INSÉRER)\b[^\]\n]{0,60}\]|«\s*(?:insert|enter|fill in|указать|укажите|введите|впишите|заполните|вставить|вставьте|eintragen|einfügen|insérer|indiquer)\b[^»\n]{0,60}»", ["[", "«"]),
    "marks": (rf"([%#@$])(?<![\w%#@$].){_NAME}\1(?!\w)|__(?<!\w__){_NAME}__(?!\w)|%\({_NAME}\)[sd]", ["%", "#", "@", "$", "__"]),
}

#: Phrases that weak labels are made from, by kind (for lower-case texts), each with words of which a match holds at least one (none: all texts are tried).
PHRASES = {
    "number": (r"^\W*[45]\d\d\b\W+[a-zа-я]", []),
    "status": (
        r"\b(?:error|http|status|code|fehler|erreur|ошибка|ошибки|сбой)\W{0,3}[45]\d\d\b|traceback|stack ?trace|(?:error|exception) in \w",
        ["error", "http", "status", "code", "fehler", "erreur", "ошибк", "сбой", "traceback", "stack", "exception"],
    ),
    "error": (
        r"page (?:you asked for )?(?:was |is |could )?not (?:be )?(?:found|here)|access to this .{1,30} denied|access denied|session has expired|too many requests|something went wrong|try again (?:later|in a few)"
        r"|temporarily unavailable|no longer valid|could not (?:finish|process|complete) (?:the|your) request|please (?:sign|log) in|seite wurde nicht gefunden|zugriff verweigert|bitte anmelden|page n'existe|momentanément indisponible|accès refusé"
        r"|страница не найдена|доступ .{0,30}запрещ|сеанс истёк|сервис .{0,20}недоступ|превышено число|не смог обработать запрос|войдите в систему|повторите попытку",
        ["page ", "denied", "expired", "too many", "went wrong", "try again", "unavailable", "no longer", "could not", "please ", "seite wurde", "verweigert", "bitte an", "indisponible", "refusé", "страница", "доступ", "сеанс", "сервис", "превышено", "не смог", "войдите", "повторите"],
    ),
    "script": (
        r"java ?script|(?:enable|allow|turn on|switch(?:ed)? o[nf]f?|activate) (?:\w+ )?(?:scripts?|active content)|scripts? (?:is|are) (?:required|needed|disabled|switched off)|scripts? (?:switched off|in your browser)|active content"
        r"|(?:включите|разрешите|поддержива\w+) .{0,25}(?:скрипт|сценари)|выполнение скриптов|(?:браузер|browser|navigateur) .{0,40}(?:скрипт|script|сценари)",
        ["script", "скрипт", "сценари", "active content"],
    ),
    "filler": (
        r"\b(?:lorem|ipsum|dolor|amet|tempor|aliqua|laoreet|tellus)\b(?:\W+\w+){0,3}\W+(?:lorem|ipsum|dolor|amet|elit|tempor|aliqua|laoreet|tellus|magna|varius)\b"
        r"|(?:sample|dummy|placeholder|example) text|your (?:own )?(?:content|text|heading|title)\b.{0,8}(?:here|$)|replace this (?:paragraph|text)|text (?:goes|will be|comes) here|здесь будет текст|появится позже|текст раздела|beispieltext|blindtext|platzhalter|texte? d'exemple|coming soon",
        ["lorem", "ipsum", "dolor", "amet", "tempor", "aliqua", "laoreet", "tellus", "sample text", "dummy text", "placeholder text", "example text", "text goes", "text will", "text comes", "будет текст", "текст раздела", "beispieltext", "blindtext", "text d'", "texte d'", "your ", "replace this", "появится", "platzhalter", "coming soon"],
    ),
    "repeat": (r"(?:asdf|qwerty|xxx|bla|test|text|проба|тест|текст)(?:\W+(?:asdf|qwerty|xxx|bla|test|text|проба|тест|текст)){3,}", ["asdf", "qwerty", "xxx", "bla", "test", "text", "проба", "тест", "текст"]),
    "form": (
        r"(?:^|\n)[^\n:]{2,30}:[ \t]*(?:tbd|tba|todo|n/a|\?{2,}|x{3,}|_{3,}|\.{3,}|—|-{1,3})[ \t]*(?=\n[^\n:]{2,30}:[ \t]*(?:tbd|tba|todo|n/a|\?{2,}|x{3,}|_{3,}|\.{3,}|—|-{1,3})[ \t]*(?:\n|$))",
        [":"],
    ),
}
_DUMMY = re.compile(r":[ \t]*(?:tbd|tba|todo|n/a|\?{2,}|x{3,}|_{3,}|\.{3,}|—|-{1,3})?[ \t]*$", re.M)

#: The rules by number: phrases first, then placeholders.
_RULES = [(re.compile(p, re.M), keys) for p, keys in PHRASES.values()] + [(re.compile(p), keys) for p, keys in PLACEHOLDERS.values()]
N_PHRASES = len(PHRASES)
#: Rules without such words come first.
N_ALWAYS = sum(not keys for _, keys in _RULES)
DENSE = 40
_TOP = (1 << BITS) - DENSE


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Of the words that matches hold, with the numbers of the rules as bits."""
    bits: dict[str, int] = {}
    for no, (_, keys) in enumerate(_RULES):
        for k in (k for k in keys if len(k) > 1):
            bits[k] = bits.get(k, 0) | 1 << no
    a = ahocorasick.Automaton()
    for k, b in bits.items():
        a.add_word(k, b)
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), dtype=bool, count=1 << 16)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, by which hashes of places anywhere in a text are compared."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_CHARS + 1)
        base = 0x9E3779B97F4A7C15
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, x, dtype=np.uint64)])) for x in (base, pow(base, -1, 1 << 64))]
    return _POWERS


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def has_placeholder(text: str) -> bool:
    return bool(hits([text])[0, N_PHRASES:].any())


def hits(texts: list[str]) -> np.ndarray:
    """A row for each text, a column for each rule. A rule is tried where the text holds one of its words."""
    out = np.zeros((len(texts), len(_RULES)), dtype=bool)
    find = _automaton().iter
    always = sum(1 << no for no in range(N_ALWAYS))
    rules = [(no, p) for no, (p, _) in enumerate(_RULES)]
    single = [(k, sum(1 << no for no, (_, keys) in enumerate(_RULES) if k in keys)) for k in sorted({k for _, keys in _RULES for k in keys if len(k) == 1})]
    for i, t in enumerate(texts):
        low = t.lower()
        seen = always
        for _, b in find(low):
            seen |= b
        for k, b in single:
            if k in low:
                seen |= b
        for no, pattern in rules if seen != always else rules[:N_ALWAYS]:
            if seen >> no & 1:
                out[i, no] = pattern.search(low if no < N_PHRASES else t) is not None
    return out


class Words:
    """The words (letters, two or more) of some texts: ``doc`` and hash ``h`` of each, ``short`` the hash of its first four letters, ``title`` whether it is in the first line of several, ``size`` its letters."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        code = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.docs = len(texts)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 1)])[:-1]
        self.starts = starts
        letter = np.zeros(len(code) + 2, dtype=np.int8)
        letter[1:-1] = _letters()[code if not len(code) or code.max() < 1 << 16 else np.where(code < 1 << 16, code, 0)]
        step = np.diff(letter)
        a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        keep = b - a >= 2
        a, b = a[keep], b[keep]
        n = b - a
        power, inverse = _powers(len(code))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((code + np.uint64(7)) * power[: len(code)], dtype=np.uint64)])
        self.h = _mix((sums[b] - sums[a]) * inverse[a])
        self.short = _mix((sums[a + np.minimum(n, 4)] - sums[a]) * inverse[a])
        self.size = n
        self.doc = np.searchsorted(starts, a, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.docs)
        breaks = np.flatnonzero(code == 10)
        self.lines = np.bincount(np.searchsorted(starts, breaks, "right") - 1, minlength=self.docs) + (np.arange(self.docs) == self.docs - 1)
        first = np.append(breaks, len(code))[np.searchsorted(breaks, starts)] if self.docs else starts
        self.title = (a < first[self.doc]) & (self.lines[self.doc] > 1) if len(a) else np.empty(0, dtype=bool)
        digit = np.flatnonzero((code >= 48) & (code <= 57))
        self.digits = np.bincount(np.searchsorted(starts, digit, "right") - 1, minlength=self.docs)


def _ids(kind: int, h: np.ndarray) -> np.ndarray:
    return (_mix(h + np.uint64(kind * 0xD6E8FEB86659FD93 % (1 << 64))) % np.uint64(_TOP)).astype(np.int64) + DENSE


def word_ids(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Documents and feature numbers of their different words."""
    both = np.unique(w.doc.astype(np.int64) << BITS | _ids(1, w.h))
    return both >> BITS, both & ((1 << BITS) - 1)


def known_share(w: Words, known: np.ndarray) -> np.ndarray:
    """Of each text, the share of its words that are known; 0 without words."""
    return np.bincount(w.doc, weights=known[_ids(1, w.h)], minlength=w.docs) / np.maximum(1, w.count)


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def features(texts: list[str], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, feature numbers and values, ordered by text. Numbers below DENSE are those that aren't hashed."""
    w = Words(texts)
    hit = hits(texts)
    body = ~w.title
    of, h, short, size = w.doc[body], w.h[body], w.short[body], w.size[body]
    n = np.bincount(of, minlength=w.docs)
    share = np.bincount(of, weights=known[_ids(1, h)], minlength=w.docs) / np.maximum(1, n)
    doc, ids, val = [], [], []

    def add(kind: int, d: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The different n-grams of a kind weigh together alike in all texts; returns their numbers by text."""
        both = np.unique(d.astype(np.int64) << BITS | _ids(kind, h))
        at = both >> BITS
        many = np.bincount(at, minlength=w.docs)
        doc.append(at)
        ids.append(both & ((1 << BITS) - 1))
        val.append(1 / np.sqrt(1.0 + many[at]))
        return many

    different = add(1, of, h)
    same = of[1:] == of[:-1]
    add(2, of[1:][same], (h[:-1] * np.uint64(3) + h[1:])[same])
    add(3, of[size > 4], short[size > 4])
    add(4, w.doc[w.title], w.h[w.title])
    dummy = np.fromiter((len(_DUMMY.findall(t.lower())) if ":" in t else 0 for t in texts), dtype=np.float64, count=len(texts))
    length = np.fromiter(map(len, texts), dtype=np.float64, count=len(texts))
    variety = different / np.maximum(1, n)
    phrase = hit[:, :N_PHRASES]
    dense = np.column_stack([
        np.ones(w.docs), share, 1 - share, np.minimum(n, 200) / 50, n < 8, n < 20, n < 50, variety, (n > 20) & (variety < 0.5), w.lines <= 1, w.lines <= 3, dummy / np.maximum(1, w.lines),
        w.digits / np.maximum(1, length), phrase * (1.2 - share)[:, None], 2.0 * phrase.any(axis=1) * (1.2 - share), phrase.any(axis=1) & (n < 40), 2.0 * hit[:, N_PHRASES:], 2.0 * hit[:, N_PHRASES:].any(axis=1),
    ]).astype(np.float64)
    doc.append(np.repeat(np.arange(w.docs), dense.shape[1]))
    ids.append(np.tile(np.arange(dense.shape[1]), w.docs))
    val.append(dense.ravel())
    d, i, v = np.concatenate(doc), np.concatenate(ids), np.concatenate(val)
    order = np.argsort(d, kind="stable")
    return d[order], i[order], v[order]


def scores(texts: list[str], weights: np.ndarray, known: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for start, part in _chunks(texts):
        d, i, v = features(part, known)
        z = np.bincount(d, weights=weights[i] * v, minlength=len(part))
        out[start : start + len(part)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def weak_labels(texts: list[str], known: np.ndarray) -> np.ndarray:
    """1 residue, 0 content, -1 undecided. A text that merely speaks of such things holds mostly known words beside the phrase; an unfilled placeholder is residue anywhere."""
    out = np.full(len(texts), -1)
    for start, part in _chunks(texts):
        w, hit = Words(part), hits(part)
        share, n = known_share(w, known), w.count
        different = np.bincount(word_ids(w)[0], minlength=w.docs)
        phrase = hit[:, :N_PHRASES].any(axis=1)
        y = np.where(~phrase & (share > 0.45) & (n > 3), 0, -1)
        y = np.where(phrase & (share > 0.8) & (n > 12), 0, y)
        y = np.where(phrase & (share < 0.7) & ((n < 60) | (different < 0.4 * n)), 1, y)
        out[start : start + len(part)] = np.where(hit[:, N_PHRASES:].any(axis=1), 1, y)
    return out


def train(texts: list[str], labels: list[int], known: np.ndarray, epochs: int = 6, l2: float = 1e-5, rate: float = 0.3) -> np.ndarray:
    """Weights of an L2-regularised logistic regression by adaptive gradient steps; both labels weigh alike."""
    rows = []
    for _, part in _chunks(texts):
        d, i, v = features(part, known)
        cut = np.searchsorted(d, np.arange(len(part) + 1))
        rows += [(i[a:b], v[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    y = np.asarray(labels, dtype=np.float64)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            idx, val = rows[k]
            p = 1 / (1 + np.exp(-np.clip(w[idx] @ val, -30, 30)))
            g = weight[k] * (p - y[k]) * val + l2 * w[idx]
            g2[idx] += g * g
            w[idx] -= rate * g / np.sqrt(g2[idx])
    return w


def _texts(documents: DataFrame, text: str, host: str) -> DataFrame:
    """``t, h, apart``: non-blank texts with their hash and whether their host is left out of training."""
    apart = F.pmod(F.xxhash64(F.coalesce(F.col(host), F.lit(""))), F.lit(HELD_OUT_OF)) == 0
    return documents.where(F.length(F.trim(text)) > 0).select(F.col(text).alias("t"), F.xxhash64(text).alias("h"), apart.alias("apart"))


def survey(documents: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """One pass over all texts: ``kind, key, n``; of kind 0 the number of texts without a phrase and of those with each word, of kinds 1 and 2 (hosts left out: 3 and 4) the hashes of texts without and with a rule's hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(1 << BITS, dtype=np.int64), 0
        out = lambda kind, key, n: pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["kind", "key", "n"])
        for b in batches:
            texts = b.column("t").to_pylist()
            kinds = np.where(np.asarray(b.column("apart").to_pylist(), dtype=bool), 3, 1)
            for start, part in _chunks(texts):
                hit = hits(part)
                free = ~hit[:, :N_PHRASES].any(axis=1)
                doc, ids = word_ids(Words(part))
                count += np.bincount(ids[free[doc]], minlength=1 << BITS)
                total += int(free.sum())
                kinds[start : start + len(part)] += hit.any(axis=1)
            yield out(kinds, b.column("h").to_numpy(zero_copy_only=False), np.ones(len(kinds)))
        ids = np.flatnonzero(count)
        yield out(np.zeros(len(ids) + 1), np.append(ids, -1), np.append(count[ids], total))

    return _texts(documents, text, host).mapInArrow(run, "kind int, key long, n long")


def known_words(surveyed: DataFrame) -> np.ndarray:
    """Of each feature number of a word, whether the word is known."""
    counts = surveyed.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n"))
    total = next((r["n"] for r in counts.where("key = -1").collect()), 0)
    known = np.zeros(1 << BITS, dtype=bool)
    for r in counts.where((F.col("key") >= 0) & (F.col("n") >= max(2, KNOWN_SHARE * total))).toLocalIterator():
        known[r["key"]] = True
    return known


def known_of(words) -> np.ndarray:
    """The words of a collection as known ones."""
    known = np.zeros(1 << BITS, dtype=bool)
    known[_ids(1, Words(list(words)).h)] = True
    return known


def labelled_sample(documents: DataFrame, known, text: str = "text", host: str = "source", per_label: int = SAMPLE_PER_LABEL, held_out: bool = False, surveyed: DataFrame | None = None) -> list[tuple[str, int]]:
    """Distinct texts with weak labels, the first ``per_label`` of each by hash, of the hosts used for training, or of those left out.

    Candidates are the first 2 * ``per_label`` different hashes of the texts with a rule's hit and of those without. ``known`` comes
    from known_words, or is a set of words.
    """
    surveyed = survey(documents, text, host) if surveyed is None else surveyed
    known = known_of(known) if isinstance(known, set) else known
    first = []
    for kind in (3, 4) if held_out else (1, 2):
        first += [r["key"] for r in surveyed.where(F.col("kind") == kind).select("key").distinct().orderBy("key").limit(2 * per_label).collect()]
    if not first:
        return []
    keys = documents.sparkSession.createDataFrame([(k,) for k in first], "h long")
    texts = _texts(documents, text, host).where(F.col("apart") == held_out).join(F.broadcast(keys), "h", "left_semi").where(F.length("t") <= SAMPLE_CHARS)
    found = sorted({(r["h"], r["t"]) for r in texts.select("h", "t").distinct().collect()})
    labels = weak_labels([t for _, t in found], known)
    out = []
    for y in (0, 1):
        out += [(t, y) for (_, t), got in zip(found, labels) if got == y][:per_label]
    return out


def fit(documents: DataFrame, text: str = "text", host: str = "source") -> tuple[np.ndarray, np.ndarray]:
    """Weights and known words, both of fixed size."""
    surveyed = materialize(survey(documents, text, host))
    known = known_words(surveyed)
    sample = labelled_sample(documents, known, text, host, surveyed=surveyed)
    return train([t for t, _ in sample], [y for _, y in sample], known).astype(np.float32), known


def residue(documents: DataFrame, text: str = "text", host: str = "source", threshold: float = 0.5, model: tuple | None = None) -> DataFrame:
    """The rows with ``residue`` (the text is to be excluded) and ``score``.

    Null, empty and blank texts are no residue and have no score; without any labelled text nothing is scored above the threshold. The model and the known words have fixed sizes,
    so they can be sent to all tasks; texts are scored whole, in one pass without a shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents, text, host))

    @F.pandas_udf("double")
    def run(col: pd.Series) -> pd.Series:
        w, known = shared.value
        out = np.full(len(col), np.nan)
        real = np.fromiter((bool(t and t.strip()) for t in col), dtype=bool, count=len(col))
        if real.any():
            out[real] = scores(list(col[real]), w, known)
        return pd.Series(out).astype(object).where(real, None)

    documents = documents.drop("residue", "score")  # results take the place of columns of their names
    return documents.withColumn("score", run(F.col(text))).withColumn("residue", F.coalesce(F.col("score") > threshold, F.lit(False)))


def validate(documents: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Agreement with the weak labels on the hosts left out: one row of ``texts, positives, precision, recall``."""
    surveyed = materialize(survey(documents, text, host))
    known = known_words(surveyed)
    sample = labelled_sample(documents, known, text, host, surveyed=surveyed)
    w = train([t for t, _ in sample], [y for _, y in sample], known)
    held = labelled_sample(documents, known, text, host, held_out=True, surveyed=surveyed)
    got = [(s >= 0.5, y) for s, (_, y) in zip(scores([t for t, _ in held], w, known), held)]
    tp, fp, fn = sum(s and y for s, y in got), sum(s and not y for s, y in got), sum(y and not s for s, y in got)
    row = (len(got), sum(y for _, y in got), float(tp / max(1, tp + fp)), float(tp / max(1, tp + fn)))
    return documents.sparkSession.createDataFrame([row], "texts int, positives int, precision double, recall double")
