"""Queries without SQL that do what their counterparts with SQL leave out."""

import re
from collections import Counter

import pytest

from segloom.plans import catalog

SEG = "segment_id string, doc_id string, seq long, extracted_at timestamp, source_plain string, target_tagged string, source_tagged string, shielded_tagged string, target_shielded_tagged string"


@pytest.fixture(scope="module")
def pairs_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pairs"))
    texts = [("Hold 5 bolts.", "Держите 5 болтов."), ("Hold 5 bolts.", "Держите 6 болтов."), ("Hold 5 bolts near 7.", "Держите 7 болтов у 5."), ("Gap 1,5 mm", "Зазор 1.5 мм"), ("Hold it", "Держите 3"), ("Gap 2 mm", "Зазор зазор 2 мм")]
    rows = [(f"s{i}", f"d{i % 2}", i, None, s, t, s, s, t) for i, (s, t) in enumerate(texts)]
    spark.createDataFrame(rows, SEG).write.parquet(f"{d}/segments.parquet")
    spark.createDataFrame([("bolts", "болтов", 1), ("gap", "щель", 2)], "source string, target string, rank int").write.parquet(f"{d}/glossary.parquet")
    numbers = lambda x: re.findall(r"\d+(?:\.\d+)?", x.replace(",", "."))
    return d, {f"s{i}" for i, (s, t) in enumerate(texts) if numbers(s) != numbers(t)}


def test_differing_numbers_are_in_all_issue_queries(spark, pairs_dir):
    d, want = pairs_dir
    q = catalog.queries()
    got = [tuple(r) for r in q["q67_validate_all_rules"](spark, d).collect()]
    assert {k for k, code, _ in got if code == "numbers_mismatch"} == want == {"s1", "s2", "s4"}
    assert Counter(r[1:] for r in got) == {(r["code"], r["severity"]): r["n"] for r in q["q68_issue_histogram_all_rules"](spark, d).collect()}
    by_doc = {r["doc_id"]: r for r in q["q69_document_quality_all_rules"](spark, d).collect()}
    assert {k: (r["issues"], r["mismatched"]) for k, r in by_doc.items()} == {"d0": (2, 0), "d1": (4, 2)}  # the gaps are called otherwise
    assert q["q70_quality_summary_all_rules"](spark, d).first()["issues"] == len(got) + 2 == 6


def test_blocks_are_merged_within_their_columns(spark, tmp_path):
    d = str(tmp_path)
    blocks = [("d", 1, 2 * i + c, x, 100.0 + 14 * i, x + 200, 112.0 + 14 * i, f"{'lr'[c]}{i}", c) for i in range(3) for c, x in ((0, 60.0), (1, 340.0))]
    blocks += [blocks[0], (*blocks[0][:8], None), ("d", 2, 0, 60.0, 100.0, 260.0, 112.0, "a", None), ("d", 2, 1, 60.0, 114.0, 260.0, 126.0, "b", None)]
    spark.createDataFrame(blocks, "doc_id string, page_number int, block_id int, x0 double, y0 double, x1 double, y1 double, text string, column_index int").write.parquet(f"{d}/pdf_blocks.parquet")
    spark.createDataFrame([("d", p, 595.0, 842.0) for p in (1, 2)], "doc_id string, page_number int, width_pt double, height_pt double").write.parquet(f"{d}/pdf_pages.parquet")
    got = sorted((r["page_number"], r["x0"], r["blocks"], r["chars"]) for r in catalog.queries()["q71_column_block_islands"](spark, d).collect())
    assert got == [(1, 60.0, 3, 8), (1, 340.0, 3, 8), (2, 60.0, 2, 3)]
    assert catalog.queries()["q44_block_islands"](spark, d).where("page_number = 1").count() == 2


def test_fuzzy_lookup_asks_for_every_segment(spark, tmp_path):
    d = str(tmp_path)
    rows = [(f"s{i}", "d", i, None, f"Tighten bolt number {i} of the left landing gear", *[None] * 4) for i in range(1, 24)]
    spark.createDataFrame(rows, SEG).write.parquet(f"{d}/segments.parquet")
    entries = [(f"h{i}", r[4], "x", i) for i, r in enumerate(rows)] + [("h_other", "remove the wheel", "x", 1)]
    spark.createDataFrame(entries, "source_hash string, source_norm string, target_text string, updated_at int").write.parquet(f"{d}/tm_exact.parquet")
    got = catalog.queries()["q11_hybrid_fuzzy"](spark, d).collect()
    assert {r["segment_id"]: r["source_hash"] for r in got if r["score"] == 1.0 and r["hit_rank"] == 1} == {f"s{i + 1}": f"h{i}" for i in range(23)}
    assert Counter(r["segment_id"] for r in got) == {f"s{i}": 3 for i in range(1, 24)}
