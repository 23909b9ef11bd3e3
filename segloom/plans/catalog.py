"""The catalogue of core queries: each operator over the whole tables it is meant for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import recover, shield
from ..functions import text as T
from ..operators import alignment, glossary, layout, memory, ordered, prompts, review, similarity, structure, usage, validate
from ..sources import files
from ..sources.tables import current_memory, keep_latest, table
from . import oracle


def segments(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest extraction of each segment."""
    cols = list(dict.fromkeys(["segment_id", "doc_id", "seq", "extracted_at", *columns]))
    return keep_latest(table(spark, d, "segments").select(*cols), ["segment_id"], [F.col("extracted_at").desc_nulls_last(), F.col("doc_id"), F.col("seq")])


def q01_segments(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    lines = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("seq", "line")).where(F.length(T.strip("line")) > 0)
    loc = F.concat(F.lit("doc"), "doc_id", F.lit("/p"), "seq")
    return lines.select("doc_id", F.col("seq").cast("bigint").alias("seq"), loc.alias("location"), T.segment_id(loc, "line").alias("segment_id"), T.is_toc("line").alias("is_toc"))


def q02_normalize_hash(spark, d):
    n = T.normalize("text")
    return table(spark, d, "documents").select("doc_id", T.content_hash(n).alias("hash"), F.length(n).alias("chars"))


def q03_compact_text(spark, d):
    return segments(spark, d, "source_plain").select("segment_id", T.compact("source_plain", 60).alias("snippet"))


def q04_number_tokens(spark, d):
    return segments(spark, d, "source_plain").select("segment_id", F.array_join(T.numbers("source_plain"), "|").alias("numbers"))


def q05_source_filter(spark, d):
    return segments(spark, d, "target_tagged").select("segment_id", T.needs_translation(T.strip_markers("target_tagged")).alias("needs_translation"))


def q06_exact_hits(spark, d):
    p = memory.latest_progress(table(spark, d, "progress"))
    return memory.exact_hits(p.select("segment_id", "source_hash"), current_memory(spark, d)).select("segment_id", "hit", F.md5("memory_target").alias("target"))


def q07_memory_latest(spark, d):
    m = memory.upsert(table(spark, d, "tm_exact").select("source_hash", "source_norm", "target_text", "created_at", "updated_at"))
    return m.select("source_hash", F.md5("target_text").alias("target"), "created_at", "updated_at")


def q08_resume_reuse(spark, d):
    """Where the length of the text is even, the segment's hash now is the one of its first hit, else none is known."""
    first = table(spark, d, "fuzzy_hits").groupBy("segment_id").agg(F.min("source_hash").alias("now"))
    now = F.when(F.length("source_plain") % 2 == 0, F.col("now")).otherwise(F.col("done"))
    done = memory.latest_progress(table(spark, d, "progress")).select("segment_id", F.col("source_hash").alias("done"))
    s = segments(spark, d, "source_plain").join(first, "segment_id", "left").join(done, "segment_id", "left").withColumn("now", now)
    return memory.reusable(s, table(spark, d, "progress"), current_memory(spark, d), "now")


def q09_memory_search(spark, d):
    return memory.search(current_memory(spark, d), "bearing race", 20).select("source_hash", "updated_at")


def _queries(spark, d):
    """Query texts of the token lookup: every segment whose place in its document is divisible by 20, against all entries."""
    return segments(spark, d, "source_plain").where(F.col("seq") % 20 == 0)


def q10_token_jaccard_topk(spark, d):
    best = similarity.jaccard_top_k(_queries(spark, d), current_memory(spark, d), "segment_id", "source_plain", "source_hash", "source_norm", 0.7)
    return best.select(F.col("q").alias("segment_id"), F.col("e").alias("source_hash"), "jaccard", "hit_rank")


def q11_hybrid_fuzzy(spark, d):
    """Every segment against all entries."""
    h = similarity.hybrid_top_k(segments(spark, d, "source_plain"), current_memory(spark, d), "segment_id", "source_plain", "source_hash", "source_norm")
    return h.select(F.col("q").alias("segment_id"), F.col("e").alias("source_hash"), F.round("score", 6).alias("score"), "hit_rank")


def _terms(spark, d):
    return glossary.distinct_terms(table(spark, d, "glossary"))


def q12_glossary_match(spark, d):
    found = glossary.matches(segments(spark, d, "source_plain"), _terms(spark, d), "segment_id", "source_plain")
    return glossary.top_matches(found, 24).select(F.col("key").alias("segment_id"), "term", "pos")


def q13_glossary_priority_merge(spark, d):
    domain = table(spark, d, "part").select(F.col("p_name").alias("source"), F.col("p_type").alias("target"))
    return glossary.merge_priority(domain, table(spark, d, "glossary"))


def _tagged(spark, d):
    return segments(spark, d, "source_plain", "target_tagged", "source_tagged", "shielded_tagged", "target_shielded_tagged").where(F.col("target_tagged").isNotNull())


def q14_placeholder_multiset(spark, d):
    missing, extra = validate.placeholder_diff(F.coalesce("shielded_tagged", F.lit("")), F.coalesce("target_shielded_tagged", F.lit("")))
    r = _tagged(spark, d).select("segment_id", F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("extra"))
    return r.where("missing != '' or extra != ''")


def q15_style_sequence(spark, d):
    a, b = T.style_tokens(F.coalesce("source_tagged", F.lit(""))), T.style_tokens("target_tagged")
    return _tagged(spark, d).where(a != b).select("segment_id", F.size(a).alias("source_tokens"), F.size(b).alias("target_tokens"))


def _issues(spark, d):
    return validate.issues(_tagged(spark, d), "segment_id", "source_plain", "target_tagged", "shielded_tagged", "target_shielded_tagged")


def _issues_of(code):
    def run(spark, d):
        return _issues(spark, d).where(F.col("code").isin(*code)).select(F.col("key").alias("segment_id"), "code", "details")

    return run


q16_length_checks = _issues_of(("empty_translation", "length_ratio_high", "short_translation"))


q17_untranslated = _issues_of(("untranslated_fragments",))


def _document_issues(spark, d):
    """Documents as translations of nothing: what the rules on targets alone say of them."""
    docs = table(spark, d, "documents").select("doc_id", F.lit("").alias("source"), "text").dropDuplicates(["doc_id"])
    return validate.issues(docs, "doc_id", "source", "text")


def q18_repeated_tokens(spark, d):
    return _document_issues(spark, d).where("code = 'repeated_words'").select(F.col("key").alias("doc_id"), "details")


def q19_context_leak(spark, d):
    """Control words in documents, with lines that a control word was put before, by the number of the document."""
    words = ("PART: body ", "see SECTION ", "TABLE_CELL ", "", "", "tm_references = ", "PREVIOUS: ", "next=")
    docs = table(spark, d, "documents").dropDuplicates(["doc_id"])
    lead = F.element_at(F.array(*map(F.lit, words)), (F.col("doc_id") % len(words) + 1).cast("int"))
    i = validate.issues(docs.select("doc_id", F.lit("").alias("source"), F.concat(lead, "text").alias("text")), "doc_id", "source", "text")
    return i.where("code = 'context_leakage'").select(F.col("key").alias("doc_id"), "details")


def q20_validate_all(spark, d):
    return _issues(spark, d).select(F.col("key").alias("segment_id"), "code", "severity")


def q21_issue_histogram(spark, d):
    return validate.histogram(_issues(spark, d))


def _usage(spark, d):
    """Usage records from the event table."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events")
    return e.select(F.lit("openai").alias("provider"), F.when(F.col("user_id") % 3 == 0, "model-s").when(F.col("user_id") % 3 == 1, "MODEL-L ").otherwise("unknown").alias("model"), F.col("event_type").alias("phase"),
                    F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"), F.floor(F.col("value") * 3).cast("bigint").alias("output_tokens"), F.floor(F.col("value") * 13).cast("bigint").alias("total_tokens"), F.when(k % 2 == 0, F.floor("value") / F.lit(100.0)).alias("cost"))


def q22_usage_snapshot(spark, d):
    return usage.totals(_usage(spark, d))


def _pricing(spark):
    return spark.createDataFrame([("OpenAI", "model-s", 0.5, 1.5), ("openai", "model-l", 2.0, 8.0)], "provider string, model string, input_per_million double, output_per_million double")


def q23_usage_cost(spark, d):
    c = usage.with_cost(_usage(spark, d).drop("cost"), _pricing(spark))
    return c.groupBy("model").agg(F.count("*").alias("requests"), F.round(F.sum("cost"), 4).alias("cost"), F.count("cost").alias("priced"))


def q24_model_profile(spark, d):
    names = table(spark, d, "llm_config").select("config_id", F.lit("openai").alias("provider"), F.element_at(F.array(*(F.lit(x) for x in ("gpt-5-mini-2026", "gpt-5", "gpt-4o-mini", "gpt-5.2-x", "gpt-50", "gpt-5-nano"))), (F.col("config_id") % 6 + 1).cast("int")).alias("model"))
    return usage.with_profile(names, spark).select("config_id", "model", "profile", "tier", "input_context")


def _term_issues(spark, d):
    t = _tagged(spark, d)
    found = glossary.top_matches(glossary.matches(t, _terms(spark, d), "segment_id", "source_plain"))
    return validate.term_issues(validate.missing_terms(found, t, "segment_id", "target_tagged"))


def _quality(spark, d):
    return usage.document_quality(segments(spark, d), _issues(spark, d).unionByName(_term_issues(spark, d).drop("mode")))


def q25_document_quality(spark, d):
    return _quality(spark, d)


def q26_quality_summary(spark, d):
    return usage.quality_summary(_quality(spark, d))


def _variants(spark, d):
    return glossary.term_variants(_tagged(spark, d), _terms(spark, d), "segment_id", "source_plain", "target_tagged")


def q27_term_variants(spark, d):
    return _variants(spark, d).groupBy("term", "variant").agg(F.count("*").alias("n"), F.min("key").alias("first_segment"))


def q28_inconsistencies(spark, d):
    return glossary.inconsistencies(_variants(spark, d))


def q29_neighbours(spark, d):
    s = ordered.neighbours(segments(spark, d, "source_plain", "in_table"), "doc_id", ["seq", "segment_id"], "source_plain", 0, "in_table")
    return s.select("segment_id", "prev_text", "next_text")


def q30_recent_ring(spark, d):
    s = segments(spark, d, "target_tagged").where(F.length(T.strip("target_tagged")) > 0)
    return ordered.recent(s, "doc_id", ["seq", "segment_id"], F.col("segment_id")).select("segment_id", F.array_join("recent", ",").alias("recent"))


def q31_heading_carry(spark, d):
    s = ordered.carry_forward(segments(spark, d, "paragraph_style", "source_plain"), "doc_id", ["seq", "segment_id"], F.when(F.lower("paragraph_style").startswith("heading"), F.col("source_plain")), "heading")
    return s.select("segment_id", "heading")


def q32_greedy_pack(spark, d):
    s = segments(spark, d, "shielded_tagged")
    rank = ordered.greedy_groups(s, "doc_id", "seq", "shielded_tagged", 6, 1000)
    return rank.select("doc_id", "seq", F.col("group_no").cast("bigint").alias("group_no"))


def q33_page_chunks(spark, d):
    s = segments(spark, d, "page_number", "location").withColumn("page", T.page_of("page_number", "location"))
    c = ordered.page_chunks(s.select("doc_id", "segment_id", "seq", "page"), "doc_id", "page", "seq", 3, 40)
    return c.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def q34_batch_eligibility(spark, d):
    s = segments(spark, d, "shielded_tagged", "is_toc_entry").select(F.explode(T.batch_reasons("shielded_tagged", F.col("is_toc_entry"))).alias("reason"))
    return s.groupBy("reason").agg(F.count("*").alias("n"))


def q35_budget_prefix(spark, d):
    h = table(spark, d, "fuzzy_hits").where((F.col("similarity") >= 0) & (F.col("similarity") <= 1)).select("segment_id", "source_hash", "similarity", "hit_rank", "source_norm", "target_text").distinct()
    r = ordered.within_line_budget(h, "segment_id", [F.col("similarity").desc(), "hit_rank", "source_hash", "source_norm", "target_text"], "source_norm", "target_text", 500)
    return r.select("segment_id", "source_hash", F.md5("line").alias("line"), "running")


def q36_issue_filter(spark, d):
    s = segments(spark, d).withColumn("chunk", F.concat_ws("/", "doc_id", F.floor(F.col("seq") / 20)))
    r = review.filtered(s, _issues(spark, d), "segment_id", "chunk", codes=("style_tags_mismatch", "untranslated_fragments"), severities=("error",))
    return r.select("segment_id", "chunk")


def _edits(spark, d):
    """Edits from fuzzy hits: each hit suggests its target for the segment."""
    h = table(spark, d, "fuzzy_hits")
    t = segments(spark, d, "target_tagged").select("segment_id", F.col("target_tagged").alias("current_target"))
    e = h.join(t, "segment_id", "left").select(
        "segment_id", F.concat(F.lit("c"), F.substring("segment_id", 1, 1)).alias("chunk_id"), F.when(F.col("hit_rank") % 2 == 0, "terminology").otherwise("style").alias("issue_type"), "current_target",
        F.col("target_text").alias("suggested_target"), F.when(F.col("hit_rank") % 5 == 0, "No change needed.").when(F.col("hit_rank") % 7 == 0, "").otherwise("use the memory").alias("instruction"), F.col("similarity").alias("confidence"), "hit_rank", "source_hash",
    )
    return e.withColumn("edit_no", F.row_number().over(Window.partitionBy("segment_id").orderBy("hit_rank", "source_hash", F.coalesce("confidence", F.lit(-1.0)), "suggested_target")))


def q37_edit_reasons(spark, d):
    e = review.attach_edits(segments(spark, d), _edits(spark, d))
    why = review.reasons(F.col("current_target"), F.col("suggested_target"), F.col("instruction"), F.col("confidence"), 0.7)
    return e.select("segment_id", "edit_no", F.array_join(why, ",").alias("reasons"))


def _applied(spark, d):
    return review.apply_edits(segments(spark, d, "location", "target_tagged"), _edits(spark, d).withColumn("location", F.lit(None).cast("string")), 0.3)


def q38_apply_edits(spark, d):
    return _applied(spark, d).select("segment_id", "edit_no", "applied", F.array_join("reasons", ",").alias("reasons"), F.md5("target").alias("target"))


def q39_location_alignment(spark, d):
    s = segments(spark, d, "location", "source_plain", "target_tagged").where(F.col("location").isNotNull()).withColumn("location", F.concat_ws("#", "doc_id", "location"))
    return review.align_by_location(s.where(F.col("target_tagged").isNotNull()).select("location", "seq", F.col("target_tagged").alias("target")), s.where("seq % 50 != 0").select("location", "seq", F.col("source_plain").alias("source")))


def _trace(spark, d):
    """A trace from the event table; chunks are users, halves by parity of the event."""
    e = table(spark, d, "events")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("request", "response", "error", "split", "failed_chunk"))), (F.pmod(F.col("event_id"), F.lit(5)) + 1).cast("int"))
    half = F.when(F.col("event_id") % 3 == 0, ".a").when(F.col("event_id") % 3 == 1, ".b").otherwise("")
    zero = F.lit(None).cast("int")
    t = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 1999 == 0, "summary").otherwise(kind).alias("event"), F.concat(F.lit("c"), "user_id", F.when(kind == "request", "").otherwise(half)).alias("chunk_id"), F.floor(F.col("value")).cast("int").alias("edits_count"))
    for i, c in enumerate(("chunks_total", "requests_total", "requests_succeeded", "requests_failed", "chunks_failed", "suggestions_total")):
        t = t.withColumn(c, F.when((F.col("event") == "summary") & (F.col("line_no") % (i + 2) == 0), F.lit(100 + i)).otherwise(zero))
    return t


def q40_trace_replay(spark, d):
    return review.replay(_trace(spark, d))


def q41_split_completion(spark, d):
    return review.completed_roots(_trace(spark, d))


def _blocks(spark, d):
    return layout.distinct_blocks(table(spark, d, "pdf_blocks"))


def _pages(spark, d):
    return layout.distinct_pages(table(spark, d, "pdf_pages"))


def q42_margin_repeat(spark, d):
    return layout.repeated_margins(_blocks(spark, d), _pages(spark, d))


def _drawings(spark, d):
    """Frames around the body of every third page, and around its upper half."""
    p = _pages(spark, d).where("page_number % 3 = 0")
    box = lambda no, y0, y1: F.struct(F.lit(no).alias("drawing_id"), (F.col("width_pt") * 0.05).alias("x0"), (F.col("height_pt") * y0).alias("y0"), (F.col("width_pt") * 0.95).alias("x1"), (F.col("height_pt") * y1).alias("y1"))
    return p.select("doc_id", "page_number", F.explode(F.array(box(0, 0.1, 0.8), box(1, 0.1, 0.45), box(2, 0.85, 0.88))).alias("b")).select("doc_id", "page_number", "b.*")


def _typed_blocks(spark, d):
    b, p = _blocks(spark, d), _pages(spark, d)
    typed = layout.classified(b, p, layout.margin_blocks(b, p), layout.table_regions(b, _drawings(spark, d), p))
    return layout.with_columns(typed.drop("width_pt", "height_pt"), p)


def q43_block_types(spark, d):
    return _typed_blocks(spark, d).groupBy("doc_id", "block_type").agg(F.count("*").alias("n"))


def q44_block_islands(spark, d):
    g = layout.merged_blocks(_typed_blocks(spark, d))
    return g.select("doc_id", "page_number", "segment_id", "block_type", "blocks", F.round("x0", 3).alias("x0"), F.round("y1", 3).alias("y1"), F.md5("text").alias("text"))


def q45_bbox_join(spark, d):
    return layout.overlapping(_blocks(spark, d))


def q46_two_columns(spark, d):
    return layout.two_columns(_blocks(spark, d), _pages(spark, d))


def q47_cluster_count(spark, d):
    return _blocks(spark, d).groupBy("doc_id", "page_number").agg(F.collect_list("y0").alias("v")).select("doc_id", "page_number", layout.cluster_count(F.col("v"), 12.0).alias("clusters"))


def q48_overflow_risk(spark, d):
    return layout.overflow_issues(_contained(spark, d))


def _sections(spark, d):
    a = table(spark, d, "eval_items").select(F.concat(F.lit("i"), "item_id").alias("key"), "text")
    b = table(spark, d, "documents").where(F.length("text") > 0).select(F.concat(F.lit("d"), "doc_id").alias("key"), "text")
    return a, b


def _vectors(spark, d):
    a, b = _sections(spark, d)
    ta, tb = alignment.section_tokens(a, "key", "text"), alignment.section_tokens(b, "key", "text")
    count = lambda df: df.agg(F.count("*")).scalar()
    return alignment.weighted(ta, tb, count(a) + count(b))


def q49_tfidf_cosine(spark, d):
    wa, wb = _vectors(spark, d)
    return alignment.cosine(wa, wb, 0.2).where("cosine >= 0.2").select(F.col("a").alias("item"), F.col("b").alias("document"), F.round("cosine", 6).alias("cosine"))


def q50_overlap_f1(spark, d):
    a, b = _sections(spark, d)
    f1 = alignment.overlap_f1(alignment.counted_tokens(a, "key", "text"), alignment.counted_tokens(b, "key", "text"), 0.25)
    return f1.select(F.col("a").alias("item"), F.col("b").alias("document"), F.round("f1", 6).alias("f1"))


def q51_monotone_alignment(spark, d):
    """The lines of each document of pages held against itself without every fifth page: a monotone mapping."""
    b = _blocks(spark, d).groupBy("doc_id", "page_number").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    w = Window.partitionBy("doc_id").orderBy("page_number")
    base = b.withColumn("column", F.row_number().over(w) - 1)
    over = b.where("page_number % 5 != 0").withColumn("row", F.row_number().over(w) - 1)
    key = lambda df, c: df.select(F.concat_ws("/", "doc_id", c).alias("key"), "text")
    ta, tb = alignment.section_tokens(key(over, "row"), "key", "text"), alignment.section_tokens(key(base, "column"), "key", "text")
    count = lambda df: df.agg(F.count("*")).scalar()
    wa, wb = alignment.weighted(ta, tb, count(over) + count(base))
    # Only pages of one document meet: the document is part of the token.
    own = lambda w: w.select("key", F.concat_ws("/", F.substring_index("key", "/", 1), "token").alias("token"), "w")
    f1 = alignment.cosine(own(wa), own(wb))
    part = lambda c, i: F.split(F.col(c), "/")[i]
    sim = f1.where(part("a", 0) == part("b", 0)).select(part("a", 0).alias("pair"), part("a", 1).cast("int").alias("row"), part("b", 1).cast("int").alias("column"), F.col("cosine").alias("s"))
    size = base.groupBy("doc_id").agg(F.count("*").alias("columns")).join(over.groupBy("doc_id").agg(F.count("*").alias("rows")), "doc_id").select(F.col("doc_id").alias("pair"), F.col("rows").cast("int").alias("rows"), F.col("columns").cast("int").alias("columns"))
    return alignment.aligned(size, sim)


def q52_marker_patterns(spark, d):
    c = lambda p, name: F.sum(F.regexp_count(F.coalesce("source_tagged", F.lit("")), F.lit(p))).alias(name)
    return segments(spark, d, "source_tagged").groupBy("doc_id").agg(c("⟦S_[0-9]+", "style_open"), c("⟦/S_[0-9]+", "style_close"), c("⟦BR", "breaks"), c("⟦OBJ_", "objects"))


def q53_shield_roundtrip(spark, d):
    s = segments(spark, d, "source_plain").where(F.col("source_plain").isNotNull()).withColumn("m", shield.shield(F.col("source_plain")))
    return s.select("segment_id", F.size("m.map").alias("masked"), (shield.unshield(F.col("m.text"), F.col("m.map")) == F.col("source_plain")).alias("restored"))


def q54_sizing(spark, d):
    c = table(spark, d, "llm_config")
    return c.select("config_id", usage.grouped_timeout(F.lit(60.0), F.col("batch_segments"), F.col("batch_max_chars")).alias("timeout"), usage.review_timeout(F.lit(90.0), F.col("batch_segments") * 8).alias("review_timeout"),
                    F.when(F.col("batch_segments") > 1, F.greatest("max_output_tokens", usage.output_tokens(F.col("batch_max_chars")))).otherwise(F.col("max_output_tokens")).alias("output_tokens"), usage.workers(F.lit(4), F.lit(10), F.col("batch_max_chars")).alias("workers"))


def q55_estimate(spark, d):
    c = segments(spark, d, "config_id").groupBy("doc_id").agg(F.max("config_id").alias("config_id")).join(table(spark, d, "llm_config"), "config_id")
    s = segments(spark, d, "source_plain", "is_toc_entry", "in_textbox").withColumn("complex", F.col("in_textbox"))
    return usage.estimates(s, c.select("doc_id", "provider", "model", F.lower("provider").isin("openai", "ollama").alias("grouped"), "batch_segments", "batch_max_chars"), spark)


def q56_page_spec(spark, d):
    return spark.createDataFrame([(p,) for p in files.parse_pages("5,12,45-50,100,12")], "page int")


def q57_heartbeat_gaps(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts"))
    e = table(spark, d, "events").withColumn("stale", gap > 3600)
    return e.groupBy("user_id").agg(F.count("*").alias("beats"), F.count_if("stale").alias("gaps"))


def q58_json_recovery(spark, d):
    m = table(spark, d, "tm_exact").select("source_hash", "updated_at", "meta_json").distinct()
    return m.select("source_hash", "updated_at", recover.recover_json(F.col("meta_json")).alias("payload"))


def q59_missing_terms(spark, d):
    t = _tagged(spark, d)
    found = glossary.matches(t, _terms(spark, d), "segment_id", "source_plain")
    return validate.missing_terms(found, t, "segment_id", "target_tagged").select(F.col("key").alias("segment_id"), "term")


def q60_document_terms(spark, d):
    s = segments(spark, d, "source_plain")
    found = glossary.matches(s, _terms(spark, d), "segment_id", "source_plain")
    return glossary.recent_terms(found, s, 5)


def q61_rekey(spark, d):
    m = current_memory(spark, d).withColumn("source_hash", F.when(F.length("source_norm") % 2 == 0, T.memory_key("source_norm", "old")).otherwise(F.col("source_hash")))
    return memory.rekey(m, "old", "new").select("source_hash", "old_hash")


def q62_token_index(spark, d):
    i = memory.token_index(current_memory(spark, d))
    return i.groupBy("token").agg(F.count("*").alias("entries"))


def q63_progress_counts(spark, d):
    """Progress states with their share and what is left."""
    p = memory.latest_progress(table(spark, d, "progress"))
    return p.groupBy("status").agg(F.count("*").alias("segments"), F.count("source_hash").alias("with_hash"), F.count_if(recover.error_kind(F.col("error")) == "timeout").alias("timeouts"))


def q64_char_width(spark, d):
    return layout.char_metrics(segments(spark, d, "spans"))


def q65_expansion(spark, d):
    """Expansion of translations by document: the n-th source against the n-th target, as far as both lists go."""
    s = segments(spark, d, "source_plain", "target_tagged")
    return usage.expansion(s.select("doc_id", "seq", "segment_id", F.col("source_plain").alias("text")), s.where(F.col("target_tagged").isNotNull()).select("doc_id", "seq", "segment_id", T.strip_markers("target_tagged").alias("text")))


def q66_soft_wrap(spark, d):
    return segments(spark, d, "source_plain").select("segment_id", F.md5(ordered.soft_wrap("source_plain")).alias("wrapped"))


def q67_validate_all_rules(spark, d):
    """As ``q20``, by all nine rules."""
    return _issues(spark, d).select(F.col("key").alias("segment_id"), "code", "severity")


def q68_issue_histogram_all_rules(spark, d):
    return validate.histogram(_issues(spark, d))


def q69_document_quality_all_rules(spark, d):
    return _quality(spark, d)


def q70_quality_summary_all_rules(spark, d):
    return usage.quality_summary(_quality(spark, d))


def q71_column_block_islands(spark, d):
    """As ``q44``, with the columns that the blocks come with."""
    typed = layout.classified(_blocks(spark, d), _pages(spark, d))
    return layout.merged_blocks(typed).select("doc_id", "page_number", "segment_id", "blocks", F.round("x0", 3).alias("x0"), F.round("y1", 3).alias("y1"), F.length("text").alias("chars"))


def q72_xml_pattern_diff(spark, d):
    """Markup made of the marks in both texts of each segment, counted by document, and what the translation changed."""
    tag = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("⟦BRCOL_"), F.lit('<w:br w:type="column" n=')), F.lit("⟦BR"), F.lit("<w:br ")), F.lit("⟦OBJ_"), F.lit("<w:drawing "))
    s = segments(spark, d, "source_tagged", "target_tagged").where(F.col("target_tagged").isNotNull())
    part = lambda c: s.select(F.col("doc_id").alias("doc"), tag(F.col(c)).alias("xml"))
    return structure.pattern_diff(part("source_tagged"), part("target_tagged"))


def q73_model_sizing(spark, d):
    c = table(spark, d, "llm_config")
    models = ("gpt-5-mini-2026", "gpt-5", "gpt-4o-mini", "gpt-5.2-x", "gpt-50", "gpt-4.1-mini")
    pick = lambda k: F.element_at(F.array(*map(F.lit, models)), ((F.col("config_id") + k) % 6 + 1).cast("int"))
    r = c.select(
        "config_id", F.lit("openai").alias("provider"), pick(0).alias("model"), F.lit("openai").alias("review_provider"), pick(3).alias("review_model"), (F.col("config_id") * 37 + 60).alias("median_chars"), (F.col("config_id") * 500).alias("prompt_chars"),
        "batch_segments", "batch_max_chars", "max_output_tokens", F.when(F.col("config_id") % 5 == 0, 900).otherwise(0).alias("context_chars"), F.lit(3).alias("review_pages"), F.lit(80).alias("review_segments"), F.lit(600).alias("review_output"),
    )
    return usage.sized(r, spark).select("config_id", *(F.col(f"out_{x}").cast("bigint").alias(x) for x in ("batch_segments", "batch_chars", "output_tokens", "review_pages", "review_segments", "review_output")))


def _contained(spark, d):
    return segments(spark, d, "source_plain", "target_tagged", "width_twips", "height_twips", "in_table", "in_textbox", "in_frame", "spans")


def q74_container_limits(spark, d):
    return layout.constrained(_contained(spark, d))


def q75_fix_choice(spark, d):
    s = _contained(spark, d)
    i = layout.overflow_issues(s).withColumn("pos", F.when(F.col("code") == "length_ratio_high", 0).otherwise(1))
    return layout.fixes(i, s).select("segment_id", "code", "strategy", F.round("overflow", 6).alias("overflow"))


def q76_nearest_columns(spark, d):
    b = layout.with_columns(_blocks(spark, d), _pages(spark, d))
    return b.select("doc_id", "page_number", "block_id", "column_index")


def q77_fonts(spark, d):
    f = segments(spark, d, "spans").select(F.explode("spans.style").alias("s")).select(F.col("s.font_name").alias("font"), F.col("s.bold").alias("bold"), F.col("s.italic").alias("italic")).where(F.col("font").isNotNull())
    m = spark.createDataFrame([(0, "Arial", "PT Sans.ttf"), (1, "Cambria", "PTSerif-Regular.ttf")], "pos int, source string, target string")
    return layout.replacement_fonts(f, m).select("font", "bold", "italic", layout.font_family("font").alias("kind"), "family", "file")


def _with_neighbours(spark, d):
    cols = ("source_plain", "in_table", "in_textbox", "is_toc_entry", "part", "section_header", "paragraph_style", "row_index", "col_index", "max_target_chars")
    return ordered.neighbours(segments(spark, d, *cols), "doc_id", ["seq", "segment_id"], "source_plain", 0, "in_table")


def q78_contexts(spark, d):
    return _with_neighbours(spark, d).select("segment_id", prompts.segment_context().alias("context"), prompts.item_context().alias("item_context"))


def q79_review_contexts(spark, d):
    i = _issues(spark, d).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("code", "severity"))).alias("issues"))
    c = prompts.review_context(F.col("issues"))
    s = _with_neighbours(spark, d).join(i, F.col("segment_id") == F.col("key"), "left").withColumn("c", c)
    return s.select("segment_id", "c.part", "c.section_header", "c.paragraph_style", "c.heading_like", "c.in_table", "c.in_textbox", "c.is_toc_entry", F.array_join("c.issues.code", ",").alias("issues"), "c.prev_source", "c.next_source", "c.row_index", "c.col_index")


def q80_term_issues(spark, d):
    return _term_issues(spark, d).select(F.col("key").alias("segment_id"), "code", "details")


def q81_locked_terms(spark, d):
    s = segments(spark, d, "source_plain", "is_toc_entry", "in_table")
    return glossary.locked_terms(s, glossary.matches(s, _terms(spark, d), "segment_id", "source_plain")).select(F.col("key").alias("segment_id"), "term")


def q82_used_terms(spark, d):
    s = segments(spark, d, "source_plain")
    f = glossary.top_matches(glossary.matches(s, _terms(spark, d), "segment_id", "source_plain")).withColumnRenamed("key", "segment_id")
    t = f.join(s.select("segment_id", "doc_id", "seq"), "segment_id").select(F.col("doc_id").alias("chunk_id"), (F.col("seq") * 100 + F.col("pos")).alias("pos"), "source", "target")
    return review.used_terms(t, 20).select(F.col("chunk_id").alias("doc_id"), F.array_join("terms.source", "|").alias("sources"), F.array_join("terms.target", "|").alias("targets"))


def q83_skipped_reasons(spark, d):
    return review.skipped_reasons(_applied(spark, d))


def q84_edit_filter(spark, d):
    safe, skipped = review.filter_edits(_edits(spark, d), 0.5)
    return safe.select("segment_id", "edit_no", F.lit("").alias("reasons")).unionByName(skipped.select("segment_id", "edit_no", F.array_join("reasons", ",").alias("reasons")))


def q85_top_codes(spark, d):
    return validate.most_common(_issues(spark, d), 5)


def q86_token_counts(spark, d):
    return alignment.counted_tokens(_sections(spark, d)[0], "key", "text").select(F.col("key").alias("item"), "token", "tf")


def q87_consistency(spark, d):
    r = glossary.consistency_report(_variants(spark, d), segments(spark, d))
    return r.select("term", "variant", "n", "first_segment", F.md5(F.array_join("segments", ",")).alias("segments"))


def q88_migrated(spark, d):
    m = current_memory(spark, d).where(F.length("source_norm") % 2 == 0)
    return memory.migrated_count(table(spark, d, "progress"), m.select(F.col("source_hash").alias("old_hash")))


def q89_origins(spark, d):
    """Documents by counts of their marks, as a converter would leave them."""
    s = segments(spark, d, "in_frame", "in_textbox").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("in_frame").alias("frames"), F.count_if("in_textbox").alias("boxes"))
    o = structure.origin(F.when(F.col("doc_id").contains("7"), "ABBYY FineReader"), F.lit(None).cast("string"), F.col("frames"), F.col("n"), F.when(F.col("boxes") > F.col("n") * 0.05, 1).otherwise(0))
    return s.select("doc_id", o.alias("origin"), structure.formatting_preset(F.when(F.col("n") % 2 == 0, " Auto").otherwise("off"), o).alias("preset"))


def q90_put_progress(spark, d):
    p = table(spark, d, "progress")
    old = memory.latest_progress(p.where(F.length("segment_id") > 0))
    new = p.where("status = 'error'").withColumn("status", F.lit("ok")).withColumn("error", F.lit(None).cast("string"))
    return memory.put_progress(old, new).select("segment_id", "status", "source_hash", "error")


def q91_grouping(spark, d):
    """Modes of grouping, latencies and warnings of fallbacks by configuration."""
    c = table(spark, d, "llm_config").withColumn("g", usage.grouping(F.element_at(F.array(*map(F.lit, ("grouped_turbo", " Grouped_Aggressive", "sequential_context", "?", "grouped_fast"))), (F.col("config_id") % 5 + 1).cast("int"))))
    grouped = F.col("g.batch_segments") > 1
    c = c.withColumn("l", usage.latency(F.col("provider"), F.col("model"), grouped, F.col("g.batch_max_chars"))).withColumn("f", usage.fallback_ratio(F.col("config_id") * 10, F.col("config_id"), F.col("g.warn_ratio")))
    return c.select("config_id", F.col("g.mode").alias("mode"), F.round("l.low", 6).alias("low"), F.round("l.high", 6).alias("high"), F.round("f.ratio", 6).alias("ratio"), F.col("f.warn").alias("warn"))


def q92_toc_pieces(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("no", "line")).where(F.col("line").contains("\t") | F.col("line").rlike(r"\.\s*\.\s*\."))
    p = lines.select("doc_id", "no", F.posexplode(ordered.toc_pieces("line")).alias("k", "p"))
    return p.select("doc_id", "no", "k", F.col("p.text").alias("text"), F.col("p.core").alias("core"))


def q93_history(spark, d):
    s = segments(spark, d, "shielded_tagged", "target_shielded_tagged", "token_map", "location", "part", "section_header", "in_table").where(F.col("target_shielded_tagged").isNotNull())
    return memory.history(s, "llm").select("segment_id", "in_table", F.md5("source_text").alias("source"), F.md5("target_text").alias("target"))


def q94_table_regions(spark, d):
    r = layout.table_regions(_blocks(spark, d), _drawings(spark, d), _pages(spark, d))
    return r.select("doc_id", "page_number", "region_id", *(F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")))


def queries():
    return {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}


def oracle_sql():
    return oracle.SQL
