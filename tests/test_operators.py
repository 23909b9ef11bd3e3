"""Operators on small cases, ties, nulls and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segloom.operators import alignment, glossary, layout, memory, ordered, review, similarity, translate, usage, validate
from segloom.sources.tables import keep_latest


def test_upsert_keeps_the_first_creation(spark):
    m = spark.createDataFrame([("h", "a", "x", 1, 1), ("h", "a", "y", 5, 9), ("h", "a", "z", 5, 9), (None, "n", "n", 2, 2)], "source_hash string, source_norm string, target_text string, created_at int, updated_at int")
    got = {r["source_hash"]: (r["target_text"], r["created_at"]) for r in memory.upsert(m).collect()}
    assert got == {"h": ("z", 1), None: ("n", 2)}
    assert memory.upsert(m.limit(0)).count() == 0


def test_reuse(spark):
    seg = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s1",)], "segment_id string")
    p = spark.createDataFrame([("s1", "ok", "h1", None, 2), ("s1", "error", None, "x", 1), ("s2", "error", "h1", "boom", 1)], "segment_id string, status string, source_hash string, error string, updated_at int")
    m = spark.createDataFrame([("h1", "t")], "source_hash string, target_text string")
    got = {r["segment_id"]: r["reuse"] for r in memory.reusable(seg, p, m).collect()}
    assert got == {"s1": True, "s2": False, "s3": False}


def test_rekey(spark):
    from segloom.functions import text as T

    m = spark.createDataFrame([("a",), ("b",)], "source_norm string").withColumn("source_hash", F.when(F.col("source_norm") == "a", T.memory_key("source_norm", "old")).otherwise("zz"))
    got = memory.rekey(m, "old", "new")
    assert got.count() == 1
    p = spark.createDataFrame([("s", got.first()["old_hash"])], "segment_id string, source_hash string")
    assert memory.rekey_progress(p, got).first()["source_hash"] == got.first()["source_hash"]
    index = memory.token_index(m.where("source_hash = 'zz'").withColumn("source_norm", F.lit("two words")))
    assert memory.missing_from_index(m, index).count() == 1


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [(f"e{i}", " ".join(f"w{rng.randint(0, 12)}" for _ in range(rng.randint(1, 8)))) for i in range(60)] + [("e_null", None), ("e_empty", "!")]
    q = [(f"q{i}", t) for i, (_, t) in enumerate(texts[:20])]
    sets = lambda t: set(t.split()) if t else set()
    want = {(a, b) for a, x in q for b, y in texts if sets(x) & sets(y) and y != "!" and len(sets(x) & sets(y)) / len(sets(x) | sets(y)) >= 0.6 - 1e-12}
    got = similarity.jaccard_pairs(spark.createDataFrame(q, "a string, b string"), spark.createDataFrame(texts, "a string, b string"), "a", "b", "a", "b", 0.6)
    assert {(r["q"], r["e"]) for r in got.collect()} == want


def test_lookup_moves_no_more_than_similar_pairs(spark):
    # Texts share a rare word but little else: many candidates, few pairs, and those as in brute force.
    rng = random.Random(5)
    text = lambda i: " ".join([f"r{i % 7}", *(f"w{rng.randint(0, 400)}" for _ in range(9))])
    texts = [(f"e{i:03}", text(i)) for i in range(200)]
    texts += [(f"f{i:03}", t) for i, (_, t) in enumerate(texts[:40])] + [(f"g{i:03}", t.upper()) for i, (_, t) in enumerate(texts[:40])] + [("e_null", None), ("e_empty", "!")]
    q = [(f"q{i}", t) for i, (_, t) in enumerate(texts[:30])] + [(f"r{i}", t + " of unknown") for i, (_, t) in enumerate(texts[:30])]
    sets = lambda t: set((t or "!").lower().replace("!", "").split())
    jac = lambda x, y: len(sets(x) & sets(y)) / max(1, len(sets(x) | sets(y)))
    want, hybrid = {}, {}
    for a, x in q:
        best = sorted((-round(jac(x, y), 6), b) for b, y in texts if jac(x, y) >= 0.7)[:3]
        want |= {(a, b): (r, -s) for r, (s, b) in enumerate(best, 1)}
        scored = [(-(0.65 * jac(x, y) + (1 - 0.65) * similarity.ratio(x, y)), b) for b, y in texts if y and jac(x, y) > 0]
        hybrid |= {(a, b): (r, round(-s, 9)) for r, (s, b) in enumerate(sorted(x for x in scored if -x[0] >= 0.75)[:3], 1)}
    frames = spark.createDataFrame(q, "a string, b string"), spark.createDataFrame(texts, "a string, b string")
    candidates = []
    spied = similarity._similar_sets
    similarity._similar_sets = lambda *a: candidates.append(spied(*a)) or candidates[-1]
    try:
        got = similarity.jaccard_top_k(*frames, "a", "b", "a", "b", 0.7)
        best = similarity.hybrid_top_k(*frames, "a", "b", "a", "b")
    finally:
        similarity._similar_sets = spied
    assert {(r["q"], r["e"]): (r["hit_rank"], r["jaccard"]) for r in got.collect()} == want
    assert {(r["q"], r["e"]): (r["hit_rank"], round(r["score"], 9)) for r in best.collect()} == hybrid
    # What leaves the join is similar, and equal sets (three keys here) are one.
    assert all(c.count() == c.distinct().count() and c.where(f"jaccard < {t} - 1e-9").isEmpty() for c, t in zip(candidates, (0.7, 0.4 / 0.65)))
    assert candidates[0].count() == len({(frozenset(sets(x)), frozenset(sets(y))) for _, x in q for _, y in texts if jac(x, y) >= 0.7})


def test_hot_token_is_dealt(spark, monkeypatch):
    texts = [(f"e{i:02}", f"hot w{i % 9} v{i % 4}") for i in range(40)]
    frame = spark.createDataFrame(texts, "a string, b string")
    pairs = lambda: {(r["q"], r["e"], round(r["jaccard"], 9)) for r in similarity.jaccard_pairs(frame, frame, "a", "b", "a", "b", 0.2).collect()}
    whole = pairs()
    monkeypatch.setattr(similarity, "PART_PAIRS", 30)
    assert pairs() == whole and len(whole) == 1600


def test_scored_lookup_in_parts(spark, monkeypatch):
    frame = spark.createDataFrame([(f"e{i:02}", f"hot w{i % 9} v{i % 4} the same long end of all") for i in range(40)], "a string, b string")
    hits = lambda: {tuple(r) for r in similarity.hybrid_top_k(frame, frame, "a", "b", "a", "b").collect()}
    whole = hits()
    monkeypatch.setattr(similarity, "PART_ROWS", 7)
    monkeypatch.setattr(similarity, "RUN", 2)
    assert hits() == whole and len(whole) == 120


def test_ratio_is_that_of_the_sequence_matcher():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("abc d") for _ in range(rng.randint(0, 30)))
        b = "".join(c for c in a if rng.random() < 0.8) + a[:5] * (rng.random() < 0.5)
        assert similarity.ratio(a, b) == similarity.SequenceMatcher(None, a, b).ratio()


def test_hybrid_lookup(spark):
    m = spark.createDataFrame([("h1", "install lower bearing subassembly"), ("h2", "remove upper torque link"), ("h3", "install lower bearing assembly")], "h string, t string")
    q = spark.createDataFrame([("q", "install lower bearing subassembly")], "k string, t string")
    got = similarity.hybrid_top_k(q, m, "k", "t", "h", "t", 3, 0.4).orderBy("hit_rank").collect()
    assert got[0]["e"] == "h1" and got[0]["score"] == 1.0 and [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    seq = similarity.hybrid_top_k(q, m, "k", "t", "h", "t", 3, 0.5, "sequence").collect()
    assert {r["e"]: round(r["score"], 6) for r in seq} == {e: round(similarity.ratio("install lower bearing subassembly", t), 6) for e, t in (("h1", "install lower bearing subassembly"), ("h3", "install lower bearing assembly"))}
    assert similarity.hybrid_top_k(q, m, "k", "t", "h", "t", 3, 0.4, pattern="[").count() == len(got) and similarity.hybrid_top_k(q, m, "k", "t", "h", "t", 3, 0.4, pattern="zz").count() == 0
    assert similarity.ratio("tide", "diet") == 0.25 and similarity.ratio("diet", "tide") == 0.5


def test_glossary(spark):
    text = "| English | Русский |\n|---|---|\n| 2. Locking Lever | Рычаг замка |\n# note\n1) Bearing — Подшипник\na => b\n\nnothing here"
    assert glossary.parse_pairs(text) == [("Locking Lever", "Рычаг замка"), ("Bearing", "Подшипник")]
    g = spark.createDataFrame([("Main fitting", "Основной фитинг", None, 1), (" MAIN FITTING ", "другой", None, 2), ("bolt", "болт", None, 3), (None, "x", None, 4), (" ", "y", None, 5)], "source string, target string, pattern string, rank int")
    terms = glossary.distinct_terms(g)
    assert {tuple(r) for r in terms.select("term", "target").collect()} == {("main fitting", "Основной фитинг"), ("bolt", "болт")}
    t = spark.createDataFrame([("1", "The main \n⟦BRLINE_3⟧fitting and bolts, main-fitting"), ("2", "BOLT"), ("3", None), ("4", "Amain fitting, main, fitting; ubolt2")], "k string, t string")
    assert {(r["key"], r["term"]) for r in glossary.matches(t, terms, "k", "t").collect()} == {("1", "main fitting"), ("2", "bolt")}


def test_glossary_matches_equal_their_patterns(spark):
    import re

    pairs = [("self-sealing coupling", "муфта"), ("bolt", "болт"), ("болт", "bolt"), ("(x) ring", "кольцо"), ("ISO 9 bolt", "код"), ("c++", "язык"), ("Bolt", "другой")]
    texts = ["Self -\nsealing  COUPLING", "selfsealing coupling", "u-bolt", "bolts", "два болта", "the (x) ring", "a(x) ring", "c++!", "c++a", "abc++", "ISO 9 bolt", "", None, "x" * 30_000 + " bolt"]
    g = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "source string, target string, rank int")
    found = glossary.matches(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), glossary.distinct_terms(g), "k", "t")
    terms = {"self-sealing coupling", "bolt", "болт", "(x) ring", "c++"}
    want = {(i, t) for i, x in enumerate(texts) if x for t in terms if re.search(glossary.pattern_of(t), x, re.I)}
    assert {(r["key"], r["term"]) for r in found.collect()} == want
    assert [r["term"] for r in glossary.top_matches(found.withColumn("key", F.lit(1)).distinct(), 2).orderBy("pos").collect()] == ["self-sealing coupling", "(x) ring"]
    out = spark.createDataFrame([("Fit the Self-  Sealing coupling, see table 4 and Table of Contents\u200b",)], "t string")
    assert out.select(glossary.final_cleanup(glossary.rewritten("t", [("self-sealing coupling", "муфту $1")]))).first()[0] == "Fit the муфту $1, see таблица 4 and Table of Contents"


def test_inconsistency_needs_a_strict_majority(spark):
    v = spark.createDataFrame([("a", "X", "1"), ("a", "x!", "2"), ("a", "y", "3"), ("b", "p", "1"), ("b", "q", "2"), ("c", "same", "1")], "term string, variant string, key string")
    got = {r["term"]: (r["majority"], r["majority_count"], r["minority_count"]) for r in glossary.inconsistencies(v).collect()}
    assert got == {"a": ("X", 2, 1), "b": (None, None, None)}


@pytest.mark.parametrize(("s", "t", "code"), [
    ("Hello ⟦PN_1⟧ ⟦S_1⟧x⟦/S_1⟧", "⟦PN_2⟧", "placeholders_mismatch"), ("⟦S_1⟧a⟦/S_1⟧⟦S_2⟧b⟦/S_2⟧", "⟦S_2⟧a⟦/S_2⟧⟦S_1⟧b⟦/S_1⟧", "style_tags_mismatch"), ("5 mm", "6 мм", "numbers_mismatch"), ("Text", None, "empty_translation"),
    ("Remove", "Снимите этот узел полностью", "length_ratio_high"), ("x" * 53, "Установите узел.", "short_translation"), ("a", "Смажьте hinge и latch.", "untranslated_fragments"), ("a", "Снимите снимите болт", "repeated_words"), ("a", "Текст SECTION=Brakes", "context_leakage"),
])
def test_validators(spark, s, t, code):
    df = spark.createDataFrame([("k", s, t)], "k string, s string, t string")
    assert code in {r["code"] for r in validate.issues(df, "k", "s", "t").collect()}


def test_validators_pass(spark):
    df = spark.createDataFrame([("k", "Install PN123 on the MLG now.", "Установите PN123 на MLG."), ("n", None, None)], "k string, s string, t string")
    assert validate.issues(df, "k", "s", "t").count() == 0 and validate.issues(df.limit(0), "k", "s", "t").count() == 0
    e = spark.createDataFrame([("k", "a", "error"), ("k", "b", "warn")], "key string, code string, severity string")
    assert {(r["code"], r["severity"]) for r in validate.downgraded(e).collect()} == {("a_downgraded", "warn"), ("b", "warn")}
    seg = spark.createDataFrame([("s1", "d", 1), ("s0", "d", 0)], "segment_id string, doc_id string, seq long")
    i = spark.createDataFrame([(None, "c"), ("s1", "c"), ("zz", "c")], "key string, code string")
    assert sorted(r["segment_id"] for r in validate.attach(i, seg).collect()) == ["s0", "s1"]


def test_greedy_groups_equal_the_fold(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 7)
    rng = random.Random(4)
    rows = [("d" + str(i % 3 // 2), i * 3, "x" * rng.randint(0, 300)) for i in range(120)]
    want = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        k = items = load = 0
        for j, (_, seq, t) in enumerate(mine):
            c = len(t) + 128
            if j and (items >= 4 or load + c > 700):
                k, items, load = k + 1, 0, 0
            items, load = items + 1, load + c
            want[g, seq] = k
    got = ordered.greedy_groups(spark.createDataFrame(rows, "g string, seq long, t string"), "g", "seq", "t", 4, 700).collect()
    assert {(r["g"], r["seq"]): r["group_no"] for r in got} == want


def test_ordered_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    chunks = lambda t, n=3800: list(one(ordered.split_chunks(F.lit(t), n)))
    long = "a" * 9000 + "\nb\n" + "c" * 3900
    assert "".join(chunks(long)) == long and [len(x) for x in chunks(long)] == [3800, 3800, 1403, 3800, 100] and chunks("") == []
    assert max(map(len, chunks("ab\n" * 5000))) <= 3800 and chunks("aa\nbb\nc", 6) == ["aa\nbb\n", "c"]
    assert one(ordered.soft_wrap(F.lit("one two three four five six seven eight nine"))) == "one two three four five six seven\neight nine"
    assert one(ordered.soft_wrap(F.lit("a b c"))) == "a b c" and one(ordered.soft_wrap(F.lit("a b\nc d"))) == "a b\nc d" and one(ordered.soft_wrap(F.lit(f"a b {'x' * 40} c"))) == f"a b\n{'x' * 40}\nc"
    parts = lambda t, n: list(one(ordered.distribute(F.lit(t), F.array(*map(F.lit, n)) if n else F.array().cast("array<int>"))))
    assert parts("abcdefghij", [1, 1, 2]) == ["ab", "cde", "fghij"] and parts("ab", [0, 0]) == ["ab", ""] and parts("ab", []) == ["ab"] and parts("abcde", [1, -2, 1]) == ["ab", "", "cde"]
    rng = random.Random(1)
    for _ in range(8):
        n = [rng.randint(0, 5) for _ in range(rng.randint(1, 6))]
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        if sum(n):
            ends = [round(len(t) * sum(n[: i + 1]) / sum(n)) for i in range(len(n) - 1)] + [len(t)]
            assert parts(t, n) == [t[a:b] for a, b in zip([0, *ends], ends)]
    pieces = one(ordered.toc_pieces(F.lit("Fit bolt . . . . 12\tRow ")))
    assert [tuple(x) for x in pieces] == [("Fit bolt ", "Fit bolt"), (". . . . ", None), ("12", None), ("\t", None), ("Row ", "Row")]
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate([100, 300, 200, 50])], "g string, i int, c int")
    assert [r["i"] for r in ordered.within_budget(df, "g", ["i"], "c", 450).collect()] == [0, 1]
    rows = spark.createDataFrame([("d", i, p) for i, p in enumerate([1, 1, 2, 3, None, 5, 6, 6, 7, 8])], "d string, seq int, page int")
    assert {r["chunk_id"] for r in ordered.page_chunks(rows, "d", "page", "seq", 3, 4).collect()} == {"pages_1_3", "pages_5_7", "pages_8_8"}
    assert {r["chunk_id"] for r in ordered.page_chunks(rows.withColumn("page", F.lit(None).cast("int")), "d", "page", "seq", 3, 4).collect()} == {"segments_1_4", "segments_5_8", "segments_9_10"}


def test_layout(spark):
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0)], "doc_id string, page_number int, width_pt double, height_pt double")
    b = spark.createDataFrame([("d", 1, 0, 80.0, 100.0, 300.0, 120.0, "Install", "body", 0), ("d", 1, 1, 82.0, 126.0, 305.0, 145.0, "bolt", "body", 0), ("d", 1, 2, 80.0, 260.0, 300.0, 280.0, "Tighten", "body", 0)], "doc_id string, page_number int, block_id int, x0 double, y0 double, x1 double, y1 double, text string, block_type string, column_index int")
    assert [r["text"] for r in layout.merged_blocks(b).orderBy("segment_no").collect()] == ["Install\nbolt", "Tighten"]
    two = spark.createDataFrame([("d", 1, i, x, y, x + 200, y + 20, "some words of text here") for i, (x, y) in enumerate([(60.0, 100.0), (60.0, 200.0), (340.0, 100.0), (340.0, 200.0)])], "doc_id string, page_number int, block_id int, x0 double, y0 double, x1 double, y1 double, text string")
    assert layout.two_columns(two, pages).first()["columns"] == 2
    assert layout.two_columns(b.drop("block_type", "column_index"), pages).first()["columns"] == 1
    cols = spark.createDataFrame([("d", 1, 0, 50.0, 270.0), ("d", 1, 1, 330.0, 550.0)], "doc_id string, page_number int, column_no int, x0 double, x1 double")
    assert sorted(r["column_no"] for r in layout.nearest_column(two, cols).collect()) == [0, 0, 1, 1]
    region = spark.createDataFrame([("d", 1, 7, 50.0, 90.0, 560.0, 230.0), ("d", 1, 8, 0.0, 0.0, 600.0, 800.0)], "doc_id string, page_number int, drawing_id int, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in layout.table_regions(two, region, pages).collect()] == [("d", 1, 0, 50.0, 90.0, 560.0, 230.0)]
    boxes = F.array(*(F.struct(*(F.lit(float(v)).alias(c) for v, c in zip(x, ("x0", "y0", "x1", "y1")))) for x in ((0, 0, 100, 100), (50, 50, 150, 150), (300, 300, 310, 310))))
    assert [tuple(x) for x in spark.range(1).select(layout.merged_regions(boxes)).first()[0]] == [(0.0, 0.0, 150.0, 150.0), (300.0, 300.0, 310.0, 310.0)]
    typed = layout.classified(two, pages, tables=layout.table_regions(two, region, pages)).collect()
    assert {(r["block_id"], r["block_type"], r["region_id"]) for r in typed} == {(i, "table_cell", 0) for i in range(4)}
    assert sorted(r["column_index"] for r in layout.with_columns(two, pages).collect()) == [0, 0, 1, 1]
    file = lambda b, bold, it: spark.range(1).select(layout.font_file(F.lit(b), F.lit(bold), F.lit(it))).first()[0]
    assert [file("A-Regular.ttf", True, True), file("A", False, True), file("A-Regular.ttf", False, None)] == ["A-BoldItalic.ttf", "A-Italic", "A-Regular.ttf"]
    st = spark.createDataFrame([("Arial-Black", 2, 0x0102FF, 0.0, 1.0), (None, None, -1, 0.0, 0.0)], "f string, g int, c int, x double, y double").select(layout.span_style(*map(F.col, "fgcxy"))).collect()
    assert [tuple(r[0]) for r in st] == [(True, True, 1, 2, 255, 90.0), (False, False, None, None, None, 0.0)]
    assert layout.overlapping(two).count() == 0
    got = spark.createDataFrame([([1.0, 5.0, 30.0, 9.0],)], "v array<double>").select(layout.cluster_count(F.col("v"), 6.0)).first()[0]
    assert got == 2


def test_monotone_and_greedy_maps():
    sim = np.array([[0.9, 0, 0, 0], [0.8, 0.1, 0.7, 0], [0, 0, 0.1, 0.9]])
    assert alignment.monotone_map(sim) == [0, 2, 3]
    with pytest.raises(ValueError):
        alignment.monotone_map(sim.T)
    rng = random.Random(6)
    import itertools

    for n, m in ((1, 4), (2, 5), (3, 6), (4, 4)):
        sim = np.array([[rng.random() for _ in range(m)] for _ in range(n)])
        cost = lambda c: sum(sim[i, j] - 0.0015 * abs(j + 1 - (i + 1) * m / n) for i, j in enumerate(c)) - 0.01 * sum(b - a - 1 for a, b in zip(c, c[1:]))  # noqa: E731, B023
        assert abs(cost(alignment.monotone_map(sim)) - max(map(cost, itertools.combinations(range(m), n)))) < 1e-12
    bag = lambda t: {w: t.split().count(w) for w in t.split()}
    assert alignment.grouped_map([bag("a")], [bag("a"), bag("b")]) == [[], [0]] and alignment.grouped_map([], [{}]) == [[]] and alignment.grouped_map([{}] * 3, [{}, {}]) == [[0, 1], [2]]
    base, over = ["alpha one", "alpha two", "bravo one", "charlie", "delta"], ["alpha one alpha two", "bravo one", "charlie delta"]
    assert alignment.greedy_map([bag(x) for x in base], [bag(x) for x in over]) == [[0, 1], [2], [3, 4]]


def test_grouped_pages(spark):
    rows = [("p", "base", i, {w: 1 for w in t.split()}) for i, t in enumerate(["alpha one", "alpha two", "bravo", "delta"])] + [("p", "overlay", i, {w: 1 for w in t.split()}) for i, t in enumerate(["alpha one two", "delta bravo"])]
    got = alignment.grouped(spark.createDataFrame(rows, "pair string, side string, no int, tokens map<string,int>")).orderBy("row").collect()
    assert [(r["row"], list(r["columns"])) for r in got] == [(0, [0, 1]), (1, [2, 3])]
    assert alignment.page_mapping("greedy_group") is alignment.grouped_map
    with pytest.raises(ValueError):
        alignment.page_mapping("other")


def test_recent_terms_over_blocks(spark, monkeypatch):
    """Blocks of a document give what one fold over all of it does."""
    monkeypatch.setattr(glossary, "BLOCK", 5)
    rng = random.Random(8)
    seg = [(f"s{d}{i:02}", f"d{d}", i * 2) for d in range(2) for i in range(30)]
    hits = [(s, rng.choice("abcdefg"), d) for s, d, _ in seg for _ in range(rng.randint(0, 2))]
    want = {}
    for d in ("d0", "d1"):
        seen = []
        for s, doc, _ in seg:
            if doc == d:
                if seen:
                    want[s] = "|".join(seen[-4:])
                for t in sorted({t for k, t, _ in hits if k == s}):
                    seen = [x for x in seen if x != t] + [t]
    found = spark.createDataFrame([(k, t) for k, t, _ in hits], "key string, term string")
    got = glossary.recent_terms(found, spark.createDataFrame(seg, "segment_id string, doc_id string, seq long"), 4)
    assert {r["segment_id"]: r["terms"] for r in got.collect()} == want


def test_memory_records(spark):
    p = spark.createDataFrame([("a", "ok", "h1", None, 5), ("b", "error", None, "x", 9)], "segment_id string, status string, source_hash string, error string, updated_at int")
    new = p.where("segment_id = 'b'").withColumn("status", F.lit("ok")).withColumn("updated_at", F.lit(1))
    assert {(r["segment_id"], r["status"]) for r in memory.put_progress(p, new).collect()} == {("a", "ok"), ("b", "ok")}
    s = spark.createDataFrame([("s", "⟦PN_1⟧ a", "⟦PN_1⟧⟦S_1⟧ b", {"⟦PN_1⟧": "77"}, None), ("t", None, "x", None, True)], "segment_id string, shielded_tagged string, target_shielded_tagged string, token_map map<string,string>, in_table boolean")
    assert [(r["source_text"], r["target_text"], r["in_table"]) for r in memory.history(s, "llm").orderBy("segment_id").collect()] == [("77 a", "77 b", False), ("", "x", True)]
    k = memory.profile_key({"provider": " OpenAI ", "fuzzy_min_similarity": 0.75, "hard_glossary": True}, "a  b\r\n", None)
    assert k.startswith("provider=openai|model=|") and "hard_glossary=1" in k and "fuzzy_min_similarity=0.7500" in k and "reasoning_effort=default" in k and k.endswith("glossary_sha=none")
    assert memory.fingerprint("a  b\r\n") == memory.fingerprint("a b") != memory.fingerprint("ab") and k.count("|") == 28


def test_usage(spark):
    u = spark.createDataFrame([("translate", 120, 55, 175, 0.0105), ("checker", 40, 12, 52, 0.0012), ("", -5, 1, 1, None)], "phase string, input_tokens int, output_tokens int, total_tokens int, cost double")
    got = {r["phase"]: r for r in usage.totals(u).collect()}
    assert got[None]["requests"] == 3 and got[None]["cost"] == 0.0117 and got[None]["input_tokens"] == 160
    assert got["unknown"]["cost"] is None and got["unknown"]["cost_records"] == 0
    m = spark.createDataFrame([("OpenAI", "gpt-5-mini-2026-01-15"), ("openai", "gpt-50"), (None, None)], "provider string, model string")
    assert {r["model"]: r["profile"] for r in usage.with_profile(m, spark).collect()} == {"gpt-5-mini-2026-01-15": "gpt-5-mini", "gpt-50": None, None: None}
    r = spark.range(1).select(usage.workers(F.lit(4), F.lit(10), F.lit(120000)), usage.workers(F.lit(4), F.lit(3), F.lit(18000)), usage.eta(F.lit(5), F.lit(10), F.lit(10.0)), usage.eta(F.lit(0), F.lit(10), F.lit(10.0))).first()
    assert tuple(r) == (2, 3, 10.0, None)


def test_review(spark):
    trace = [(1, "request", "segments_1_2", None), (2, "response", "segments_1_2", 1), (3, "request", "segments_3_4", None), (4, "split", "segments_3_4", None), (5, "request", "segments_3_4.a", None), (6, "response", "segments_3_4.a", 0), (7, "request", "segments_3_4.b", None), (8, "response", "segments_3_4.b", 2), (9, "request", "segments_5_6", None)]
    t = spark.createDataFrame(trace, "line_no long, event string, chunk_id string, edits_count int")
    for c in ("requests_total", "requests_succeeded", "requests_failed", "chunks_failed", "suggestions_total"):
        t = t.withColumn(c, F.lit(None).cast("int"))
    r = review.replay(t).first()
    assert (r["requests_total"], r["requests_succeeded"], r["suggestions_total"], r["summary_present"]) == (5, 3, 3, False)
    assert sorted(x["chunk_id"] for x in review.completed_roots(t).collect()) == ["segments_1_2", "segments_3_4"]
    e = spark.createDataFrame([("a", "a", "No change needed.", 0.9), ("⟦S_1⟧x⟦/S_1⟧", "x", "fix", 0.9), ("a", "b", "fix", 0.9), ("a", "", "", None)], "c string, s string, i string, p double")
    got = [list(r[0]) for r in e.select(review.reasons(F.col("c"), F.col("s"), F.col("i"), F.col("p"), 0.7)).collect()]
    assert got == [["no_op", "nochange_instruction"], ["style_tags_mismatch"], [], ["missing_suggested_target", "missing_instruction", "low_confidence"]]
    seg = spark.createDataFrame([("s", "l", 1, "a")], "segment_id string, location string, seq int, target_tagged string")
    ed = spark.createDataFrame([("s", None, 1, "a", "b", "x", 0.9), ("s", None, 2, "a", "c", "x", 0.9), (None, "l", 3, "b", "d", "x", 0.9)], "segment_id string, location string, edit_no int, current_target string, suggested_target string, instruction string, confidence double")
    steps = review.apply_edits(seg, ed.unionByName(ed.limit(1).withColumn("segment_id", F.lit("zz")).withColumn("edit_no", F.lit(9))))
    assert sorted((r["edit_no"], r["applied"], *r["reasons"]) for r in steps.collect()) == [(1, True), (2, False, "current_target_mismatch"), (3, True), (9, False, "segment_not_found")]
    assert tuple(review.applied_targets(steps).first()) == ("s", "d", 2, 1)
    assert {tuple(r) for r in review.skipped_reasons(steps).collect()} == {("current_target_mismatch", 1), ("segment_not_found", 1)}
    loose = ed.limit(1).withColumn("current_target", F.lit(" ")).withColumn("instruction", F.lit("без изменений"))
    assert review.apply_edits(seg, loose).first()["reasons"] == ["nochange_instruction"]


def test_replay_of_summaries(spark):
    """A summary's counters take the place of what came before, key by key; later events add to them."""
    rows = [(1, "request", None, None, None), (2, "split", None, None, None), (3, "summary", None, 50, None), (4, "request", None, None, None), (5, "summary", None, None, 7), (6, "response", 3, None, None), (7, "response", -2, None, None)]
    t = spark.createDataFrame(rows, "line_no long, event string, edits_count int, requests_total int, chunks_total int").withColumn("chunk_id", F.lit("c"))
    r = review.replay(t).first()
    assert (r["requests_total"], r["split_events"], r["chunks_total"], r["suggestions_total"], r["requests_succeeded"], r["summary_present"]) == (51, 1, 7, 3, 2, True)
    assert review.replay(t.limit(0)).first()["summary_present"] is False
    deep = [("c", "request"), ("c", "split"), ("c.a", "split"), ("c.b", "response"), ("c.a.a", "split"), ("c.a.b", "failed_chunk"), ("c.a.a.a", "response"), ("c.a.a.b", "response"), ("d", "request"), ("d", "split"), ("d.a", "response")]
    assert [x["chunk_id"] for x in review.completed_roots(spark.createDataFrame(deep, "chunk_id string, event string")).collect()] == ["c"]


def test_answers_become_edits(spark):
    edit = '{"segment_id": "%s", "suggested_target": "x", "instruction": "i", "issue_type": " Style ", "confidence": 7}'
    a = spark.createDataFrame([("c1", '{"edits": [%s, %s, {"segment_id": "s1"}, 5]}' % (edit % "s1", edit % "zz")), ("c2", "{}"), ("c3", None)], "chunk_id string, payload string")
    got = review.parse_edits(a, spark.createDataFrame([("c1", "s1"), ("c2", "s1")], "chunk_id string, segment_id string")).collect()
    assert [(r["chunk_id"], r["edit_no"], r["segment_id"], r["issue_type"], r["severity"], r["confidence"]) for r in got] == [("c1", 1, "s1", "style", "warn", 1.0)]
    terms = spark.createDataFrame([("c", 2, "Bolt", "болт"), ("c", 1, "bolt ", "Болт"), ("c", 3, "", "x"), ("c", 4, "nut", "гайка")], "chunk_id string, pos int, source string, target string")
    assert [tuple(x) for x in review.used_terms(terms).first()["terms"]] == [("bolt", "Болт"), ("nut", "гайка")]


def test_lemmas_and_term_issues(spark):
    found = spark.createDataFrame([("1", "bolt", "новый болт"), ("2", "bolt", "новый болт"), ("3", "bolt", "новый болт")], "key string, term string, target string")
    t = spark.createDataFrame([("1", "Новый болт."), ("2", "два новых болта"), ("3", None)], "k string, t string")
    missing = lambda **k: sorted(r["key"] for r in validate.missing_terms(found, t, "k", "t", **k).collect())
    lemma = {"новых": "новый", "болта": "болт"}.get
    assert missing() == ["2", "3"] and missing(lemma=lambda w: lemma(w, w)) == ["3"] and missing(mode="off") == [] and missing(mode="?") == []
    m = validate.missing_terms(found, t, "k", "t")
    assert {(r["key"], r["details"]) for r in validate.term_issues(m).collect()} == {("2", "bolt=>новый болт"), ("3", "bolt=>новый болт")}
    assert {(r["key"], r["accept"]) for r in validate.fewer_missing(m, m.where("key = '3'")).collect()} == {("2", True), ("3", False)}


def test_services():
    class Odd:
        def __init__(self, answers):
            self.answers = list(answers)

        def translate(self, texts):
            return [self.answers.pop(0) if self.answers else t.upper() for t in texts]

    valid = lambda x: "⟦A⟧" in x
    assert translate.attempts("x⟦A⟧", Odd(["y⟦A⟧"]), valid) == ("y⟦A⟧", "ok")
    assert translate.attempts("x⟦A⟧", Odd(["no", "no", "z⟦A⟧"]), valid, repair=lambda s, t: s) == ("z⟦A⟧", "repaired")
    assert translate.attempts("x⟦A⟧ y ", Odd(["no", "no"]), valid) == ("X⟦A⟧ Y ", "spans")
    assert translate.attempts("a", Odd(["aa", "a"]), lambda x: True, missing=len) == ("a", "ok") and translate.attempts("a", Odd(["a", "aa"]), lambda x: True, missing=len) == ("a", "ok")
    assert translate.by_spans("⟦S_1|B⟧ab⟦/S_1⟧ c", Odd([])) == "⟦S_1|B⟧AB⟦/S_1⟧ C"
    with pytest.raises(ValueError):
        translate.service_of("none")


def test_review_splits(spark):
    def factory():
        def ask(texts):
            if len(texts) > 1:
                raise TimeoutError("timed out")
            if texts[0] == "bad":
                raise ValueError("boom")
            return "{}"

        return ask

    c = spark.createDataFrame([("k1", ["a", "b", "bad"]), ("k2", ["a"] * 5)], "chunk_id string, segments array<string>")
    got = [(r["chunk_id"], r["event"]) for r in translate.review(c, factory, most_segments=4).collect()]
    assert got == [("k1", "request"), ("k1", "error"), ("k1", "split"), ("k1.a", "request"), ("k1.a", "error"), ("k1.a", "split"), ("k1.a.a", "request"), ("k1.a.a", "response"), ("k1.a.b", "request"), ("k1.a.b", "response"),
                   ("k1.b", "request"), ("k1.b", "error"), ("k1.b", "request"), ("k1.b", "error"), ("k1.b", "failed_chunk")]


def test_structure(spark):
    from segloom.operators import prompts, structure

    cols = "doc string, seq int, location string, text string"
    a = spark.createDataFrame([("d", 0, "body/p0", "x"), ("d", 1, "body/p1", "y"), ("d", 2, "body/t0/r0/c0/p0", "z"), ("d", 3, "body/p9", "q")], cols)
    b = spark.createDataFrame([("d", 0, "body/p0", "x"), ("d", 1, "body/p1", "Y⟦A⟧"), ("d", 2, "body/t1/r0/c0/p0", "z"), ("d", 3, "body/p9", "r")], cols)
    assert [tuple(r) for r in structure.mismatches(a, b).orderBy("seq").collect()] == [("d", 1, "body/p1", "y", "Y⟦A⟧"), ("d", 2, "body/t0/r0/c0/p0 != body/t1/r0/c0/p0", "", "")]
    assert tuple(structure.basic_stats(a).first()) == ("d", 3, 1, 4) and structure.marker_leaks(b).first()["leaks"] == 1
    x = spark.createDataFrame([("d", '<w:br/><w:br w:type="column"/>'), ("d", None)], "doc string, xml string")
    got = structure.pattern_diff(x, x.limit(0)).first()
    assert (got["br_any"], got["br_column"], got["drawing"]) == (-2, -1, 0)
    runs = spark.createDataFrame([("p", 0, "a", "B"), ("p", 1, "", "I"), ("p", 2, "b", "B"), ("p", 3, "c", None), ("p", 4, "d", None)], "paragraph string, pos int, text string, style string")
    assert [tuple(r)[1:4] for r in structure.merged_spans(runs).orderBy("span_id").collect()] == [(1, "ab", "B"), (2, "cd", None)]
    m = lambda d: F.create_map(*(F.lit(v) for kv in d.items() for v in kv))
    assert spark.range(1).select(prompts.merged_maps(m({"a": "1", "b": "2"}), m({"b": "3"}))).first()[0] == {"a": "1", "b": "3"}
    assert prompts.system_prompt("base", " custom ", "") == "base\n\ncustom"


def test_prompts(spark):
    from segloom.operators import prompts

    cols = "part string, section_header string, in_table boolean, in_textbox boolean, is_toc_entry boolean, max_target_chars int, prev_text string, next_text string"
    df = spark.createDataFrame([("header", "Head", False, None, None, 40, " before ", None), (None, None, True, None, True, None, "x", "y")], cols)
    pair = lambda *p: F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in p))
    none = F.lit(None).cast("array<struct<source: string, target: string>>")
    got = [r[0] for r in df.select(prompts.user_prompt(F.lit("T"), pair(("a", "b"), ("", "c")), none, pair(("x" * 60, "y"), ("z", "z")), none, 70)).collect()]
    assert "Context: SECTION: Head | DOC_SECTION=header | SPACE_LIMIT: ~40 chars max, keep translation concise | PREV: before\n\nMATCHED_GLOSSARY (EN -> RU):\n- a => b\n\nTM_REFERENCES:\n- " + "x" * 60 + " => y\n\nTranslate" in got[0]
    assert "Context: TABLE_CELL | TOC_ENTRY\n\n" in got[1] and got[1].endswith("text below:\nT")
    items = spark.createDataFrame([("g", 2, "2", "t2", "c"), ("g", 1, "1", "t1", "c")], "g string, pos int, id string, text string, context string").withColumn("terms", none).withColumn("hints", pair(("a", "b"), ("c", "d"))).withColumn("recent", none)
    assert prompts.batch_prompts(items, ["g"], "DO").first()["prompt"] == 'DO\nINPUT_JSON:\n[{"id":"1","text":"t1","context":"c","tm_hints":[{"source":"a","target":"b"}]},{"id":"2","text":"t2","context":"c","tm_hints":[{"source":"a","target":"b"}]}]'


def test_translation(spark):
    class Slow:
        def translate(self, texts):
            if len(texts) > 1:
                raise TimeoutError("slow")
            if "bad" in texts[0]:
                raise RuntimeError("boom")
            return [t.upper() for t in texts]

    df = spark.createDataFrame([("1", "a ⟦X_1⟧"), ("2", "a ⟦X_1⟧"), ("3", "bad"), ("4", "known"), ("5", None)], "k string, t string")
    m = spark.createDataFrame([("known", "TM")], "source_norm string, target_text string")
    got = {r["key"]: (r["target"], r["origin"], r["error"]) for r in translate.translate(df, "k", "t", m, Slow).collect()}
    assert got == {"1": ("A ⟦X_1⟧", "llm", None), "2": ("A ⟦X_1⟧", "llm", None), "3": (None, "llm", "boom"), "4": ("TM", "tm", None), "5": (None, None, None)}


def test_keep_latest_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert keep_latest(df, ["k"], [F.col("v").desc()]).count() == 0
