"""Small cases, brute force and edge cases of the text operators."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from segloom.llm import align, encode, leak, lookalike, neardup, pack, pairs, residue, scan

SEG = "segment_id string, doc_id string, seq long, config_id int, extracted_at timestamp, source_plain string, target_tagged string, location string"
TM = "source_hash string, source_norm string, target_text string, meta_json string, created_at timestamp, updated_at timestamp"


# -- problem 1 and 3 -----------------------------------------------------------------------------------------------------
def _pair_rows():
    parts = [("valve", "клапан"), ("bolt", "болт"), ("hinge", "петлю"), ("panel", "панель"), ("needle", "иглу"), ("collar", "хомут")]
    out = []
    for i in range(60):
        en, ru = parts[i % 6]
        out.append((f"k{i}", f"Clean the {en} before each flight.", f"Очистите {ru} перед каждым полётом."))
        out.append((f"m{i}", f"Hold the {en} by hand only.", f"Удерживайте {ru} только вручную."))
    cases = {
        "cut_word": ("Clean the valve before each flight.", "Очистите клапан перед каждым пол"),
        "cut_mark": ("Hold the bolt by hand only.", "Удерживайте болт тол…"),
        "cut_sentence": ("Clean the bolt before each flight.", "Очистите болт перед"),
        "whole": ("Clean the bolt before each flight.", "Очистите болт перед каждым полётом"),
        "empty": ("Clean the bolt.", "⟦S_1⟧ … ⟦/S_1⟧"),
        "refusal": ("Clean the bolt.", "Извините, я не могу перевести этот текст."),
        "copy": ("Clean the bolt before each flight.", "Перевод: CLEAN THE BOLT BEFORE EACH FLIGHT"),
        "code": ("KIT-40475", "KIT-40475"),
        "german": ("Clean the bolt.", "Reinigen Sie den Bolzen vor jedem Flug."),
        "ukrainian": ("Clean the bolt.", "Очистіть болт перед кожним польотом."),
    }
    return out + [(k, *v) for k, v in cases.items()]


def test_defects(spark):
    df = spark.createDataFrame([("t", k, None, s, t) for k, s, t in _pair_rows()], "table_name string, record_key string, grp string, src string, tgt string")
    got = {r["record_key"]: r["defect_type"] for r in pairs.defects(df).collect()}
    want = {"cut_word": "truncated", "cut_mark": "truncated", "cut_sentence": "truncated", "whole": None, "empty": "empty", "refusal": "refusal", "copy": "copied_source", "code": None, "german": "wrong_language", "ukrainian": "wrong_language", "k1": None, "m2": None}
    assert {k: got[k] for k in want} == want


def test_defects_of_nothing_and_odd_rows(spark):
    schema = "table_name string, record_key string, grp string, src string, tgt string"
    assert pairs.defects(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([("t", "a", None, None, "x" * 50_000), ("t", "b", None, None, ""), ("t", "b", None, None, ""), ("t", None, None, "", "Да.")], schema)
    got = pairs.defects(df).collect()
    assert len(got) == 4 and {r["defect_type"] for r in got if r["record_key"] == "b"} == {"empty"}


def test_copies_of_cut_texts_are_found(spark):
    """Neither copies of a cut text nor variants of it with other numbers make its last word a usual end."""
    rows = _pair_rows() + [(f"hot{i}", "Clean the bolt before each flight.", "Очистите болт перед каждым пол") for i in range(40)]
    rows += [(f"var{i}", f"Clean the hinge {i} before each flight.", f"Очистите петлю {i} перед каждым") for i in range(40)] + [(f"n{i}", f"Clean the hinge {i} before each flight.", f"Очистите петлю {i} перед каждым полётом.") for i in range(50, 60)]
    rows += [(f"head{i}", "Vent line", "Дренажная трубка") for i in range(20)] + [("sentence", "Vent line is blue.", "Дренажная трубка синяя.")] + [(f"line{i}", f"Hold the blue {w} line", f"Удерживайте {w}") for i, w in enumerate("abcdefghij" * 2)]
    df = spark.createDataFrame([("t", k, None, s, t) for k, s, t in rows], "table_name string, record_key string, grp string, src string, tgt string")
    got = {r["record_key"] for r in pairs.defects(df).where("defect_type = 'truncated'").collect()}
    assert got == {"cut_word", "cut_mark", "cut_sentence"} | {f"hot{i}" for i in range(40)} | {f"var{i}" for i in range(40)}


def test_cut_texts_come_from_the_prefix_join(spark, monkeypatch):
    """Without the prefix join no text is known to be cut; without the terminal context those are that have longer copies alone."""
    df = spark.createDataFrame([("t", k, None, s, t) for k, s, t in _pair_rows()], "table_name string, record_key string, grp string, src string, tgt string")
    found = lambda: {r["record_key"] for r in pairs.defects(df).where("defect_type = 'truncated'").collect()}
    with monkeypatch.context() as m:
        m.setattr(pairs, "_with_share", lambda ties, counts: ties.limit(0).withColumn("p", F.lit(None).cast("double")))
        assert found() == {"cut_word", "cut_mark", "cut_sentence"}
    evidence = pairs._prefix_evidence
    monkeypatch.setattr(pairs, "_prefix_evidence", lambda *a: evidence(*a).limit(0))
    assert found() == set()


def test_compression_alone_tells_copies(monkeypatch):
    class Blind:
        def __init__(self, **_):
            pass

        def compress(self, x):
            return x

    assert pairs.is_copy("oil", "OIL") and not pairs.is_copy("oil", "gas") and not pairs.is_copy("Hold the oil cup", "Hold the gas cup")
    monkeypatch.setattr(pairs.zstandard, "ZstdCompressor", Blind)
    assert pairs.is_copy("oil", "gas")


@pytest.mark.parametrize(("s", "t", "want"), [("Vent line", "«Vent line»", True), ("Vent line", "Дренажная трубка", False), ("840", "840", False), ("SB 63-2682", "SB 63-2682", False), ("Hold the valve near the bolt.", "hold  the valve near the bolt", True)])
def test_copies(s, t, want):
    assert pairs.is_copy(s, t) is want


# -- problem 2 -----------------------------------------------------------------------------------------------------------
def test_packing_keeps_all_and_never_overflows(spark):
    rng = random.Random(3)
    rows = [(f"s{i}", "hot" if i % 3 else f"d{i % 7}", i, 1, None, "w" * rng.choice([0, 1, 40, 120, 400, 999]), None, None) for i in range(900)]
    rows += [("long", "d1", 5000, 1, None, "word " * 700, None, None), ("long", "d1", 5000, 1, None, "word " * 700, None, None), ("none", None, 1, None, None, None, None, None)]
    cfg = spark.createDataFrame([(1, 1000, 6)], "config_id int, batch_max_chars int, batch_segments int")
    got = pack.pack_requests(spark.createDataFrame(rows, SEG), cfg).toPandas()
    assert set(got.segment_id) == {r[0] for r in rows}
    by = got.groupby("request_id").agg(n=("n_chars", "size"), c=("n_chars", "sum"), cap=("capacity", "first"))
    assert (by.c <= by.cap).all()
    assert (got[got.segment_id != "none"].groupby("request_id").size() <= 6).all()
    assert set(got[got.n_pieces > 1].segment_id) == {"long"} and got[got.segment_id == "long"].n_chars.sum() == 3500


def test_packing_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pack, "BLOCK_ITEMS", 50)
    rows = [(f"s{i}", "hot", i, 1, None, "w" * (i % 90 + 1), None, None) for i in range(400)]
    cfg = spark.createDataFrame([(1, 300, 100)], "config_id int, batch_max_chars int, batch_segments int")
    got = pack.pack_requests(spark.createDataFrame(rows, SEG), cfg).toPandas()
    assert len(got) == 400 and got.segment_id.nunique() == 400
    least = -(-got.n_chars.sum() // 300)
    assert got.request_id.nunique() <= least * 1.1
    assert pack.pack_requests(spark.createDataFrame([], SEG), cfg).count() == 0


# -- problem 4 -----------------------------------------------------------------------------------------------------------
def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 60)}x" for _ in range(12)] for _ in range(12)]
    texts = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 30)}y"
        rng.shuffle(w)
        texts.append((f"k{i:03}", " ".join(w)))
    texts += [("n", None), ("e", ""), ("short", "one two")]
    sets = {k: set(t.split()) for k, t in texts if t and len(set(t.split())) >= 5}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    df = spark.createDataFrame(texts, "key string, text string")
    got = neardup.similar_pairs(df, "key", "text", 0.8, 5).select("key_a", "key_b").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and want
    groups = {r["key"]: r for r in neardup.similar_groups(df, "key", "text", 0.8, 5).collect()}
    assert set(groups) == set(sets)
    for a, b in want:
        assert groups[a]["group_id"] == groups[b]["group_id"]
    other = {k: {x for p in want if k in p for x in p if x != k and groups[x]["class_id"] != groups[k]["class_id"]} for k in sets}
    assert all(groups[k]["links"] == len(other[k]) for k in sets)


def test_similar_pairs_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART_GROUPS", 3)
    df = spark.createDataFrame([(f"k{i}", " ".join([f"a{j}b" for j in range(9)] + [f"z{i}z"])) for i in range(12)], "key string, text string")
    assert neardup.similar_pairs(df, "key", "text", 0.8, 5).count() == 66
    assert neardup.similar_pairs(df.limit(0), "key", "text").count() == 0


def test_components(spark):
    e = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("q", "q")], "c1 string, c2 string")
    assert {tuple(r) for r in neardup.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}


# -- problem 5 -----------------------------------------------------------------------------------------------------------
def test_alignment(spark):
    parts = [("valve", "клапан"), ("bolt", "болт"), ("hinge", "петля"), ("panel", "панель")]
    verbs = [("Clean", "Очистите"), ("Hold", "Удерживайте"), ("Replace", "Замените"), ("Inspect", "Осмотрите")]
    units = [(f"u{i}{j}{k}", f"{v[0]} the {p[0]} number {k}{i}.", f"{v[1]} {p[1]} номер {k}{i}.") for i, v in enumerate(verbs) for j, p in enumerate(parts) for k in range(4)]
    doc = ("m", "Clean the valve.\nHold the bolt. Replace the hinge.\nInspect the panel.\nHold the panel.", "Удерживайте болт.\nЗамените петля.\nЛист 3.\nОчистите клапан; осмотрите панель.")
    rows = [*units, doc, ("null", "a\nb", None), ("blank", "a\nb", " \n"), (None, None, "x")]
    got = align.aligned_lines(spark.createDataFrame(rows, "h string, s string, t string"), "h", "s", "t").collect()
    assert {(r["source_line"], r["target_line"]) for r in got if r["key"] == "m"} == {(0, 3), (1, 0), (1, 1), (2, 3)}
    assert {r["key"] for r in got} == {"m"}


@pytest.mark.parametrize("sims", [(0.6, 0.5), (0.7, 0.6), (0.48, 0.46), (0.48, 0.47, 0.46, 0.45), (0.4,) * 8])
def test_merges_and_splits_keep_their_links(sims):
    sim = np.array(sims)[:, None]
    assert align.links(sim) == [(i, 0) for i in range(len(sims))] and align.links(sim.T) == [(0, i) for i in range(len(sims))]


def test_sentences_like_a_linked_one_do_not_join_it():
    alike = np.array([[1, 0.5], [0.5, 1]])
    assert align.links(np.array([[0.9], [0.45]]), alike) == [(0, 0)]
    assert align.links(np.array([[0.9], [0.2]])) == [(0, 0)]


def test_alignment_groups():
    table = {w: [(align.stem(t), 0.9)] for w, t in {"clean": "очистите", "valve": "клапан", "hold": "держите", "bolt": "болт", "lift": "поднимите", "cover": "крышку", "wash": "вымойте", "seat": "сиденье"}.items()}
    got = align.align_groups("Clean valve.\nHold bolt.\nLift cover.\nWash seat; hold cover.\nAlpha beta.", "Очистите клапан, держите болт.\nПоднимите крышку.\nВымойте сиденье.\nДержите крышку.\nГамма.", table)
    assert {(r["kind"], *r["source_lines"], "/", *r["target_lines"]) for r in got} == {("merge", 0, 1, "/", 0), ("1-1", 2, "/", 1), ("split", 3, "/", 2, 3), ("omission", 4, "/"), ("addition", "/", 4)}
    assert align.align_groups("", "", {}) == []


def test_association_keeps_all_translations_and_long_entries(spark):
    """Eight words are one word's translations, equally well; entries of a hundred words teach as well."""
    targets = [f"{c}слово" for c in "абвгдежз"]
    rows = [(f"a{i}{j}", "flange", t) for i, t in enumerate(targets) for j in range(3)]
    long = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100))
    rows += [(f"l{j}", long, " ".join(chr(1072 + i // 26) + chr(1072 + i % 26) for i in range(100))) for j in range(2)]
    got = align.association(spark.createDataFrame(rows, "h string, s string, t string"), "s", "t").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"flange": 8} | {w: 100 for w in long.split()}


# -- problem 6 -----------------------------------------------------------------------------------------------------------
def _scan_tables(spark):
    seg = [(f"c{i}", "man", i, 1, None, "Install the steering collar near the gearbox cover. Tighten the self-sealing coupling before each flight.", None, "body/p1") for i in range(30)]
    seg.append(("s1", "pdf1", 1, 1, None, "Install the steering c0llar near the gea-\nrbox cover.\nPage 3 of 9\nTighten the self-\nsealing coupling.", None, "pdf/p3/s1"))
    seg.append(("s2", "pdf1", 2, 1, None, "217", None, "pdf/p3/s2"))
    blocks = []
    for p in (1, 2, 3):
        blocks += [("pdf1", p, 0, 60.0, 30.0, 200.0, 42.0, "VALVE OVERHAUL MANUAL", None), ("pdf1", p, 1, 60.0, 100.0, 300.0, 140.0, f"Install the steering collar near the\nVALVE 0VERHAUL MANUAL\ngearbox cover {p}.", 0), ("pdf1", p, 2, 60.0, 810.0, 80.0, 822.0, f"- {p} -", 0)]
    blocks += [("pdf1", 3, 3, 60.0, 300.0, 90.0, 312.0, "217", 0), ("pdf1", 3, 4, 60.0, 400.0, 90.0, 412.0, "Tighten the", 0), ("pdf1", 3, 5, 60.0, 420.0, 90.0, 432.0, "coup1ing before each flight.", 0), ("pdf1", 3, 5, 60.0, 420.0, 90.0, 432.0, "coup1ing before each flight.", 0), ("pdf1", 4, 0, 60.0, 420.0, 90.0, 432.0, None, 0)]
    b = spark.createDataFrame(blocks, "doc_id string, page_number int, block_id int, x0 double, y0 double, x1 double, y1 double, text string, column_index int")
    p = spark.createDataFrame([("pdf1", i, 595.0, 842.0, True) for i in (1, 2, 3, 3)], "doc_id string, page_number int, width_pt double, height_pt double, has_text boolean")
    return spark.createDataFrame(seg, SEG), b, p


def test_scan_noise(spark):
    got = {(r["record_key"], r["noise_kind"]) for r in scan.noise_kinds(*_scan_tables(spark)).collect()}
    want = {("s1", "misread"), ("s1", "broken_word"), ("s1", "page_number"), ("pdf1/3/5", "misread")}
    want |= {(f"pdf1/{p}/0", "running_line") for p in (1, 2, 3)} | {(f"pdf1/{p}/1", "running_line") for p in (1, 2, 3)} | {(f"pdf1/{p}/2", "page_number") for p in (1, 2, 3)}
    assert got == want


def test_scan_paragraphs(spark):
    got = [r["text"] for r in scan.paragraphs(*_scan_tables(spark)).orderBy("page_number", "block_id").collect()]
    assert got == [*(f"Install the steering collar near the gearbox cover {p}." for p in (1, 2, 3)), "217", "Tighten the coupling before each flight."]
    seg, b, p = _scan_tables(spark)
    assert scan.noise_kinds(seg.limit(0), b.limit(0), p.limit(0)).count() == 0


@pytest.mark.parametrize(("a", "b", "most"), [("c0llar", "collar", 0.3), ("olcler", "older", 0.3), ("firial", "final", 0.3), ("hamess", "harness", 0.3), ("ncedle", "needle", 0.3)])
def test_confusions_cost_little(a, b, most):
    assert scan.weighted_distance(a, b) <= most and scan.weighted_distance("landing", "landings") == 1


def test_plain_misreads_need_bigrams(spark):
    """A lost, added or other letter, four confusions, ! and $ are repaired; inflections and words that stand elsewhere are not."""
    base = [(f"b{i}", "Clean the steering collar before landing. Install the millilitre gauge by the lever screw.") for i in range(60)]
    bad = {"other": ("Clean the steering cullar before landing.", "collar"), "lost": ("Clean the steerng collar", "steering"), "added": ("Clean the steeriang collar", "steering"), "four": ("Install the mi1|i1itrc gauge", "millilitre"), "sign": ("by the l!ever screw", None), "dollar": ("by the lever $crew", "screw"), "bang": ("Clean the co!lar before", "collar")}
    good = {"plural": "Clean the steering collars before", "elsewhere": "Paint a cullar", "end": "Hold the lever! screw it"}
    rows = base + [(k, t) for k, (t, _) in bad.items()] + list(good.items())
    seg = spark.createDataFrame([(k, "d", i, 1, None, t, None, "pdf/p1") for i, (k, t) in enumerate(rows)], SEG)
    _, b, p = _scan_tables(spark)
    _, _, repairs = scan.analyse(seg, b.limit(0), p)
    got = {r["record_key"]: r["c"] for r in repairs.collect()}
    assert got == {k: c for k, (_, c) in bad.items() if c}
    assert scan._repair("by the $crew", [{"before": "the", "w": "$crew", "c": "screw"}]) == "by the screw"


def test_compounds_beyond_the_common_words_keep_their_hyphen(spark, monkeypatch):
    """What is a compound does not depend on its rank."""
    monkeypatch.setattr(scan, "COMMON_WORDS", 1)
    rows = [(f"c{i}", "Use the self-sealing coupling, the self-sealing hose and the cross-feed valve.", "body/p1") for i in range(9)]
    rows += [("s1", "Close the cross-\nfeed valve and the self-\nsealing hose.", "pdf/p1"), ("s2", "Close the val-\nve now.", "pdf/p1"), ("s2", "Close the val-\nve now.", "pdf/p1")]
    seg = spark.createDataFrame([(k, "d", i, 1, None, t, None, at) for i, (k, t, at) in enumerate(rows)], SEG)
    _, b, p = _scan_tables(spark)
    _, bodies, _ = scan.analyse(seg, b.limit(0), p)
    assert [tuple(r) for r in bodies.select("record_key", "clean", "broken").orderBy("record_key").collect()] == [("s1", "Close the cross-feed valve and the self-sealing hose.", 0), *[("s2", "Close the valve now.", 1)] * 2]


def test_paragraphs_over_many_pages(spark):
    seg, b, p = _scan_tables(spark)
    texts = [(1, 0, "First one."), (1, 1, "The gland nut"), (2, 0, "is held"), (3, 0, "by the"), (3, 1, "torsion"), (4, 0, "bar. "), (4, 1, "Last one"), (6, 0, "after a gap"), (7, 0, "goes on.")]
    rows = [(d, n, i, 60.0, 100.0 + 90 * i, 300.0, 140.0 + 90 * i, x, 0) for d in ("d", "e") for n, i, x in texts]
    blocks = spark.createDataFrame([r for r in rows if r[0] == "d" or r[1] > 1], b.schema)
    pages = spark.createDataFrame([(d, n, 595.0, 842.0, True) for d in "de" for n in range(1, 8)], p.schema)
    got = {tuple(r) for r in scan.paragraphs(seg.limit(0), blocks, pages).collect()}
    both = {(d, *r) for d in "de" for r in ((4, 1, "Last one"), (6, 0, "after a gap goes on."))}
    assert got == both | {("d", 1, 0, "First one."), ("d", 1, 1, "The gland nut is held by the torsion bar."), ("e", 2, 0, "is held by the torsion bar.")}


def test_paragraphs_of_segments_without_blocks(spark):
    """Documents and blocks that only segments have come out as well, each once and by their latest text; others not twice."""
    _, b, p = _scan_tables(spark)
    day = lambda n: datetime(2025, 1, n)
    rows = [("b0", "d", 0, "The gland nut\nis held", "pdf/p1/s0", day(1)), ("b1", "d", 1, "by the old bar", "pdf/p1/s1", day(1)), ("b1", "d", 1, "by the tor-\nsion bar", "pdf/p1/s1", day(2))]
    rows += [("b1", "d", 1, "by the tor-\nsion bar", "pdf/p1/s1", day(2)), ("b2", "d", 2, "and the cap.", "pdf/p1/s2", day(1)), ("e0", "e", 0, "Only here.", "pdf/p2/s0", day(1)), ("m", "man", 0, "No scan.", "body/p1", day(1)), ("z", "e", 1, None, "pdf/p2/s1", day(1))]
    seg = spark.createDataFrame([(k, d, n, 1, at, t, None, at_) for k, d, n, t, at_, at in rows], SEG)
    blocks = spark.createDataFrame([("d", 1, i, 60.0, 100.0 + 90 * i, 300.0, 140.0 + 90 * i, x, 0) for i, x in ((0, "The gland nut\nis held"), (2, "and the cap."))], b.schema)
    pages = spark.createDataFrame([(d, n, 595.0, 842.0, True) for d, n in (("d", 1), ("e", 2))], p.schema)
    assert sorted(tuple(r) for r in scan.paragraphs(seg, blocks, pages).collect()) == [("d", 1, 0, "The gland nut is held by the torsion bar and the cap."), ("e", 2, 0, "Only here.")]


# -- problem 7 -----------------------------------------------------------------------------------------------------------
def test_lookalikes(spark):
    base = "Align the vent line at the mètre mark 5"
    texts = {"a": base, "b": base, "zero": base.replace("vent", "ve​nt"), "cyr": base.replace("e", "е", 1), "wide": base.replace("5", "５"), "nfd": base.replace("è", "è"), "nbsp": base.replace(" ", " ", 1), "plain": base.replace("è", "e"), "upper": base.upper(), "sup": base.replace("5", "⁵"), "line": base.replace(" ", "\n", 1), "null": None, "empty": "", "lig": "ﬂeet", "fleet": "fleet"}
    df = spark.createDataFrame([*texts.items(), ("a", base)], "key string, text string")
    got = {tuple(r) for r in lookalike.lookalike_pairs(df).collect()}
    same = ["a", "b", "zero", "cyr", "wide", "nfd", "nbsp"]
    want = {tuple(sorted((x, y))) for x in same for y in same if texts[x] != texts[y]} | {("fleet", "lig")}
    assert got == want
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0


def test_lookalike_forms_are_stable(spark):
    rules = tuple(sorted(lookalike.classes_of({**{c: 100 for c in "abceopxy АБ"}, "е": 2, "о": 1, "ａ": 1, "​": 3}).items()))
    for t in ("ａbс е​о", "ё й", "", "éá"):
        once = lookalike.rewrite(t, rules)
        assert lookalike.rewrite(once, rules) == once


# -- problem 8 -----------------------------------------------------------------------------------------------------------
def test_encoding_is_exact():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encode.vocabulary_path())
    t.encode_special_tokens = True
    e, d, rng = encode.encoder(encode.vocabulary_path()), encode.Decoder(encode.vocabulary_path()), random.Random(1)
    texts = ["".join(rng.choice("aab bcčцдe ёthe \n\t9813ﬁ😀​ing<|endoftext|>'s") for _ in range(rng.randint(0, 200))) for _ in range(500)] + ["a" * 4000, "the" * 2000, " " * 1000]
    for x in texts:
        assert e.encode(x) == t.encode(x, add_special_tokens=False).ids
        assert d.decode(e.encode(x)) == x


def test_encoding_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Hold the valve.", 0), (3, "Hold the valve.", 0)], "doc_id long, text string, ids int")
    got = encode.encode_texts(df.drop("ids")).collect()
    assert [list(r["ids"]) for r in got][:2] == [[], []] and got[2]["ids"] == got[3]["ids"]
    back = encode.decode_ids(encode.encode_texts(df).drop("text")).collect()
    assert back[2]["text"] == "Hold the valve."
    assert encode.encode_texts(df.limit(0)).count() == 0


# -- problem 9 -----------------------------------------------------------------------------------------------------------
def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdё1") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(12)]
    items[5] = (5, items[4][1][:90] + " " + items[5][1])
    docs = []
    for i in range(80):
        text = " ".join(word() for _ in range(60))
        if i % 3 == 0:
            src = rng.choice(items)[1]
            a = rng.randint(0, 60)
            text = text[:50] + ", " + src[a : a + rng.randint(50, 120)].upper().replace(" ", "\n- ") + "; " + text[50:]
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, items[0][1] * 200)]
    norm = {k: leak.normalise(t) for k, t in items}
    want = {(d, k) for d, t in docs for k, n in norm.items() if any(n[p : p + 60] in leak.normalise(t) for p in range(len(n) - 59))}
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, items[0], (99, None)], "item_id long, text string")
    got = leak.leaked_passages(df, it)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 10
    monkeypatch.setattr(leak, "BLOCK_CHARS", 400)
    assert {(r["doc_id"], r["item_id"]) for r in leak.leaked_passages(df, it).collect()} == want
    assert leak.clean_documents(df, got).count() == len(docs) - len({d for d, _ in want})
    assert leak.leaked_passages(df, it.limit(0)).count() == 0 and leak.leaked_passages(df.limit(0), it).count() == 0


def test_passages_are_cut(spark):
    item = "Tighten the gland nut by hand, then hold the collar until the lamp goes out, and record the result in the form."
    rest = "The crew reported vibration near the oil cooler. "
    docs = [(1, rest * 6 + item[10:90].upper() + ". " + rest), (2, rest), (3, item), (4, None), (5, ""), (2, rest), (6, rest * 9 + item + " " + item)]
    got = leak.cut_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, "short")], "item_id long, text string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert sorted(r["doc_id"] for r in got) == [1, 2, 2, 4, 5, 6] and by[2]["text"] == rest and by[4]["text"] is None
    assert leak.normalise(by[1]["text"]) == leak.normalise(rest * 7) and by[1]["removed_chars"] == len(leak.normalise(item[10:90]))
    assert leak.normalise(by[6]["text"]) == leak.normalise(rest * 9)


# -- problem 10 ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("text", "want"), [("Dear {{ name }}", True), ("Set {A, B} of shims, set {C} right", False), ("Sign: _______", False), ("at 50 % of 60 %", False), ("see [ref. 12]", False), ("[INSERT date] now", True), ("the <part_no> valve", True), ("a <b>bold</b> word", False), ("@REV@", True), ("mail a@b.com c@d.com", False), ("${qty}", True), ("No. #5 and #6", False)])
def test_placeholders(text, want):
    assert residue.has_placeholder(text) is want


def test_quoted_instructions_are_placeholders():
    assert residue.has_placeholder("Осмотр «укажите date» муфты") and not residue.has_placeholder("Осмотр «укажите путь муфты") and not residue.has_placeholder("деталь «муфта»")


def test_word_features_equal_plain_ones():
    """Words are those of letters, two or more; equal words have equal numbers wherever they stand, four first letters too."""
    import re

    texts = ["Hold the valve 5x by hand", "", "VALVE\nhold İx ß😀 ab_cd", "x" * 70_000 + " valve", "ёж Ёж"]
    w = residue.Words(texts)
    plain = [(i, x) for i, t in enumerate(texts) for x in re.findall(r"[^\W\d_]{2,}", t.lower())]
    assert [i for i, _ in plain] == w.doc.tolist() and [len(x) for _, x in plain] == w.size.tolist()
    number = {}
    for (_, x), h, k in zip(plain, w.h.tolist(), w.short.tolist()):
        assert number.setdefault(x, h) == h and number.setdefault("^" + x[:4], k) == k
    assert len({v for k, v in number.items() if k[0] != "^"}) == len({x for _, x in plain})
    assert w.lines.tolist() == [1, 1, 2, 1, 1] and w.title.sum() == 1 and w.digits.tolist() == [1, 0, 0, 0, 0]


def test_residue(spark):
    good = ["Install the valve with two new wires. Hold the bolt by hand only. Clean the hinge before each flight.", "Remove the panel after landing. The inspector shall stamp the card. Hold the valve by hand only."]
    bad = ["Error 404: page not found. Try again later.", "Please enable JavaScript in your browser to view this document.", "lorem ipsum dolor amet lorem tempor ipsum", "Replace this paragraph with your own content."]
    rows = [(i, f"{good[i % 2]} Number {i}.", f"h{i % 9}", "x") for i in range(120)] + [(200 + i, bad[i % 4] + f" {i}", f"h{i % 9}", "x") for i in range(40)]
    rows += [(300, None, None, "x"), (301, "", "h", "x"), (302, " \n", "h", "x"), (303, good[0] + " {{part_no}} left.", "h1", "x"), (304, good[0] + " Fault code 404 means that no card was found. " + good[1], "h1", "x")]
    got = {r["doc_id"]: r["residue"] for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string, source string, score string")).collect()}
    assert all(got[200 + i] for i in range(40)) and not any(got[i] for i in range(120))
    assert [got[i] for i in (300, 301, 302, 303, 304)] == [False, False, False, True, False]
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert residue.residue(df).count() == 0


def test_sample_holds_distinct_texts(spark):
    """Copies of a text don't fill the sample; which texts are in it doesn't depend on them."""
    bad = [f"Error 404: page not found. Try again later. {i}" for i in range(30)]
    good = [f"Install the valve with two new wires number {i}." for i in range(30)]
    known = set("install the valve with two new wires number".split())
    sample = lambda texts, n: residue.labelled_sample(spark.createDataFrame([(t, None) for t in texts], "text string, source string"), known, per_label=n, held_out=held)
    held = not residue.labelled_sample(spark.createDataFrame([(t, None) for t in good], "text string, source string"), known)
    one = sample(bad + good, 10)
    assert [y for _, y in one] == [0] * 10 + [1] * 10 and len(set(one)) == 20
    hot = [t for t, _ in one]
    assert sample(bad + good + hot[:1] * 50 + hot[10:11] * 50, 10) == one
    assert sorted(sample(bad + good + hot * 9, 100)) == sorted([(t, 1) for t in bad] + [(t, 0) for t in good])


def test_held_out_hosts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = residue.validate(df).first()
    assert r["texts"] > 0 and r["recall"] >= 0.8


def test_queries_are_listed():
    from segloom.llm import queries

    names = set(queries.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 9, 10)} | {"p8_ids"} <= names
    assert set(queries.oracle_sql()) <= names
    assert F is not None
