"""Expressions over text, masking and JSON recovery."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segloom.functions import recover, shield
from segloom.functions import text as T


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("r")).first()["r"]


def test_normalize(spark):
    assert one(spark, T.normalize("v"), " a \t b\r\n c  d \n") == "a b\nc d"
    assert one(spark, T.normalize("v"), None) is None and one(spark, T.normalize("v"), "") == ""
    assert one(spark, T.normalize("v"), " " * 20000 + "x" + " " * 20000 + "y") == "x y"


@pytest.mark.parametrize(("t", "want"), [("Длина 5,5 ± 0,1 и 5m, 5A", ["5.5 ± 0.1", "5"]), ("⟦S_1⟧12⟦/S_1⟧ -3", ["12", "-3"]), ("1.5A", ["1"]), ("", [])])
def test_numbers(spark, t, want):
    assert one(spark, T.numbers("v"), t) == want


@pytest.mark.parametrize(("t", "want"), [("Снимите узел.", False), ("Снимите узел KIT с MLG и тяги управления шасси.", False), ("Remove the bolt.", True), ("   ", False), ("123", False), (None, False)])
def test_needs_translation(spark, t, want):
    assert one(spark, T.needs_translation("v"), t) is want


def test_multisets_keep_multiplicity(spark):
    r = spark.createDataFrame([(["a", "a", "b"], ["a", "c"])], "x array<string>, y array<string>").select(T.multiset_minus(F.col("x"), F.col("y")), T.counts(F.col("x"))).first()
    assert r[0] == ["a", "b"] and r[1] == {"a": 2, "b": 1}


def test_compact_and_keys(spark):
    assert one(spark, T.compact("v", 10), "abc  def ghi jkl") == "abc def..."
    assert one(spark, T.key_normal("v"), "Main-Fitting №1!") == "mainfitting1"
    assert one(spark, T.severity("v"), " ERROR ") == "error" and one(spark, T.severity("v"), None) == "warn"
    assert [one(spark, T.confidence("v"), x) for x in ("0.4", "7", "x", None)] == [0.4, 1.0, 0.0, 0.0]
    assert one(spark, T.page_of(F.lit(None).cast("string"), "v"), "pdf/p12/s3") == 12


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ABC 0123456789-().,mFig⟦⟧x", max_size=60))
def test_masking_round_trip(text):
    text = text.replace("⟦", "").replace("⟧", "")
    masked, found = shield.mask(text, shield.DEFAULT_RULES)
    assert shield.unmask(masked, found) == text


def test_masking_cases(spark):
    masked, found = shield.mask("Remove the ⟦S_1|B⟧bolt⟦/S_1⟧ (1-40) and washer PN 201587001.", (shield.Rule("PN", r"\b\d{6,}\b"), shield.Rule("REF", r"\(\s*\d+\s*-\s*\d+\s*\)")))
    assert masked == "Remove the ⟦S_1|B⟧bolt⟦/S_1⟧ ⟦REF_1⟧ and washer PN ⟦PN_1⟧." and len(found) == 2
    df = spark.createDataFrame([("5 mm and 5 mm of AMM 32-00-01",), (None,)], "t string").withColumn("m", shield.shield(F.col("t")))
    back = [r[0] for r in df.select(shield.unshield(F.col("m.text"), F.col("m.map"))).collect()]
    assert back == ["5 mm and 5 mm of AMM 32-00-01", None]
    with pytest.raises(ValueError):
        shield.shield(F.lit("x"), (shield.Rule("X", "("),))
    import re

    terms = [(re.compile(r"left(?:\s+|⟦BR[^⟧]*⟧)+hinge"), "левая петля")]
    # Numbers follow the pieces between markers, not the rules.
    assert shield.mask("Table 2⟦S_1⟧Fig. 3⟦/S_1⟧", shield.DEFAULT_RULES) == ("⟦REF_1⟧⟦S_1⟧⟦REF_2⟧⟦/S_1⟧", {"⟦REF_1⟧": "Table 2", "⟦REF_2⟧": "Fig. 3"})
    assert shield.mask_terms("left⟦BRLINE_1⟧hinge", terms)[1] == {}
    assert shield.mask_terms("left⟦BRLINE_1⟧hinge", terms, bridge=True) == ("⟦GLS_1⟧", {"⟦GLS_1⟧": "левая петля"})
    safe, kept = shield.protect_markers("a ⟦X_1⟧ b")
    assert shield.restore_markers(safe.upper(), kept) == "A ⟦X_1⟧ B"
    assert shield.tagged_pieces("a⟦S_1|B⟧b⟦/S_1⟧⟦BRLINE_1⟧c") == [("plain", "a"), ("span:1", "b"), ("marker", "⟦BRLINE_1⟧"), ("plain", "c")]


@pytest.mark.parametrize(("t", "want"), [('{"a": 1}', {"a": 1}), ('x ```json\n[1, 2]\n``` y', [1, 2]), ('noise {"a": "}"} tail', {"a": "}"}), ("{broken", None), ("", None), ('{"x": {bad} } {"ok": 1}', {"ok": 1})])
def test_payload(t, want):
    assert recover.payload(t) == want


def test_translations():
    assert recover.translations('{"translations": [{"id": "1", "text": "a"}, {"id": 2, "text": "b"}]}') == {"1": "a", "2": "b"}
    assert recover.translations('{"1": "a"}') == {"1": "a"} and recover.translations("no") is None
    with pytest.raises(ValueError):
        recover.translations(json.dumps([{"id": "1", "text": "a"}, {"id": "1", "text": "b"}]))
    with pytest.raises(ValueError):
        recover.check_ids({"1": "a"}, ["1", "2"])


def test_error_kinds(spark):
    df = spark.createDataFrame([("Request timed out",), ("max_output_tokens hit",), ("invalid JSON",), ("boom",), (None,)], "e string")
    assert [r[0] for r in df.select(recover.error_kind(F.col("e"))).collect()] == ["timeout", "output_limit", "json_contract", "other", None]
    assert one(spark, recover.repair_output(F.col("v")), "x OUTPUT: a\nOUTPUT: b") == "b"


def test_sql_functions(spark):
    from segloom.functions import udfs

    udfs.register(spark, {"болта": "болт"}.get)
    one = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert one("select seq_ratio('tide', 'diet'), seq_ratio(null, 'a')") == [(0.25, None)]
    assert one("select lemma_missing('болт', 'нет болта'), lemma_missing('болт', 'гайка'), lemma_missing('x', null), lemma_missing('', 'a')") == [(False, True, True, False)]
    assert one("select * from split_chunks('ab\\ncd\\nefghi', 6)") == [(0, "ab\ncd\n"), (1, "efghi")] and one("select * from split_chunks(null, 6)") == []
    assert [x for _, x in one("""select * from balanced_json('a {"k": "}"} b {"n": {}}')""")] == ['{"k": "}"}', '{"n": {}}']
    assert one("select shield_text('see Fig. 3')")[0][0].count("⟦REF_1⟧") == 1


def test_small_predicates(spark):
    df = spark.createDataFrame([("AMS 2750", " ", "x"), ("BSX 4", None, " "), ("ISO", "t", None), (None, None, None)], "a string, b string, c string")
    assert [tuple(r) for r in df.select(T.is_standard_code("a"), T.target_text("b", "c"), T.has_latin("a"), T.flat("b")).collect()] == [(True, "x", True, ""), (False, "", True, ""), (False, "t", True, "t"), (False, "", False, "")]
    j = spark.createDataFrame([('{"text": "x"}',), ('{"text": 5}',), ("no",), (None,)], "j string")
    assert [r[0] for r in j.select(T.structured_field("j", "text")).collect()] == ["x", None, None, None]
    b = spark.createDataFrame([("⟦BRLINE_1⟧" + "⟦S_1|B⟧x⟦/S_1⟧" * 17, True), ("⟦PN_1⟧" * 13, None), (None, None)], "t string, toc boolean")
    assert [list(r[0]) for r in b.select(T.batch_reasons("t", F.col("toc"))).collect()] == [["toc_entry", "contains_brline", "too_many_style_tokens"], ["too_many_placeholders"], []]
    assert [list(r[0]) for r in b.select(T.batch_reasons("t", F.col("toc"), False, -1)).collect()][0] == ["toc_entry"]
