"""What an outer translator or reviewer is told of a segment: contexts, limits and payloads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The words that contexts and payloads are written with.
NO_CONTEXT = "(no context)"
LEAD = "Use context only for disambiguation. Do not translate or repeat context in output."
ASK = "Translate ONLY the text below:"
HEADING_STYLES = ("heading", "title", "toc", "заголов", "оглавл")
#: How many terms, similar translations and recent translations an item of a batch carries.
BATCH_TERMS, BATCH_HINTS, BATCH_RECENT = 12, 1, 3
PAIR = "struct<source: string, target: string>"


def _has(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _snippet(c: Column | str, limit: int) -> Column:
    """The compacted text; null where it is blank, so that it leaves no part behind."""
    t = T.compact(F.coalesce(T.col(c), F.lit("")), limit)
    return F.when(t != "", t)


def real_pairs(pairs: Column, limit: int = 0) -> Column:
    """Pairs with both sides, stripped, in order; at most ``limit``, all without one. An empty list for null."""
    clean = F.transform(F.coalesce(pairs, F.array().cast(f"array<{PAIR}>")), lambda p: F.struct(T.strip(F.coalesce(p["source"], F.lit(""))).alias("source"), T.strip(F.coalesce(p["target"], F.lit(""))).alias("target")))
    both = F.filter(clean, lambda p: (p["source"] != "") & (p["target"] != ""))
    return F.slice(both, 1, limit) if limit > 0 else both


def _lines(pairs: Column, lead: str, budget: int, limit: int = 120) -> Column:
    """Lines ``source => target`` of compacted pairs, those before the first that overflows the budget (none with 0); null without any."""
    line = F.transform(real_pairs(pairs), lambda p: F.concat(F.lit(lead), T.compact(p["source"], limit), F.lit(" => "), T.compact(p["target"], limit)))
    if budget > 0:
        empty = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

        def step(acc, x):
            used = acc["used"] + F.length(x) + 1
            ok = acc["open"] & (used <= budget)
            return F.struct(F.when(ok, used).otherwise(acc["used"]).alias("used"), ok.alias("open"), F.when(ok, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

        line = F.aggregate(line, empty, step, lambda acc: acc["kept"])
    return F.when(F.size(line) > 0, F.array_join(line, "\n"))


def segment_context() -> Column:
    """The context of a segment's own prompt, its parts joined by a bar. Neighbours are left out in tables."""
    part = F.lower(F.trim(F.coalesce("part", F.lit(""))))
    near = lambda name, c: F.when(~_has(F.col("in_table")), F.concat(F.lit(f"{name}: "), _snippet(c, 220)))
    parts = F.array(
        F.concat(F.lit("SECTION: "), F.when(F.length("section_header") > 0, F.col("section_header"))), F.when(_has(F.col("in_table")), "TABLE_CELL"), F.when((part != "") & (part != "body"), F.concat(F.lit("DOC_SECTION="), part)),
        F.when(_has(F.col("is_toc_entry")), "TOC_ENTRY"), F.when(F.col("max_target_chars") > 0, F.concat(F.lit("SPACE_LIMIT: ~"), F.col("max_target_chars").cast("string"), F.lit(" chars max, keep translation concise"))),
        near("PREV", "prev_text"), near("NEXT", "next_text"),
    )
    kept = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, " | ")).otherwise(NO_CONTEXT)


def user_prompt(text: Column, terms: Column, document_terms: Column, references: Column, recent: Column, reference_chars: int = 500, recent_chars: int = 900) -> Column:
    """A segment's prompt: its context, the blocks that aren't empty, and the text. Segments have the columns of segment_context; lists are of sources and targets."""
    block = lambda title, body: F.concat(F.lit(f"{title}:\n"), body)
    blocks = F.filter(
        F.array(
            block("MATCHED_GLOSSARY (EN -> RU)", _lines(terms, "- ", 0)), block("DOCUMENT_GLOSSARY (EN -> RU)", _lines(document_terms, "- ", 0)), block("TM_REFERENCES", _lines(references, "- ", reference_chars)),
            block("RECENT_TRANSLATIONS (EN => RU)", _lines(recent, "- ", recent_chars)),
        ),
        lambda x: x.isNotNull(),
    )
    extra = F.when(F.size(blocks) > 0, F.concat(F.lit("\n\n"), F.array_join(blocks, "\n\n"))).otherwise("")
    return F.concat(F.lit(f"{LEAD}\nContext: "), segment_context(), extra, F.lit(f"\n\n{ASK}\n"), text)


def item_context() -> Column:
    """The context of an item in a batch."""
    part = F.lower(F.trim(F.coalesce("part", F.lit(""))))
    named = lambda name, c, n: F.concat(F.lit(f"{name}="), _snippet(c, n))
    parts = F.array(
        named("SECTION", "section_header", 120), F.when((part != "") & (part != "body"), F.concat(F.lit("DOC_SECTION="), part)), F.when(_has(F.col("in_table")), "TABLE_CELL"), F.when(_has(F.col("in_textbox")), "TEXTBOX"),
        F.when(_has(F.col("is_toc_entry")), "TOC_ENTRY"), named("PREV", "prev_text", 80), named("NEXT", "next_text", 80),
    )
    kept = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, " | ")).otherwise(NO_CONTEXT)


def batch_prompts(items: DataFrame, group: list[str], instructions: str) -> DataFrame:
    """One prompt a group: the instructions and the items as JSON, in order of ``pos``.

    Items have ``pos, id, text, context`` and the lists ``terms, hints, recent``, which are cut to their numbers; empty ones are left out.
    """
    some = lambda c, n: F.when(F.size(real_pairs(F.col(c), n)) > 0, real_pairs(F.col(c), n))
    item = F.struct("pos", "id", "text", "context", some("terms", BATCH_TERMS).alias("glossary"), some("hints", BATCH_HINTS).alias("tm_hints"), some("recent", BATCH_RECENT).alias("recent_translations"))
    g = items.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("pos")).alias("i"))
    return g.select(*group, F.concat(F.lit(f"{instructions}\nINPUT_JSON:\n"), F.to_json("i")).alias("prompt"))


def review_context(issues: Column) -> Column:
    """What the reviewer is told of a segment: where it stands, up to six of its issues, and its neighbours; absent fields are null. ``issues`` is a list of structs with code and severity."""
    style = T.compact(F.coalesce("paragraph_style", F.lit("")), 80)
    heading = F.lit(False)
    for w in HEADING_STYLES:
        heading = heading | F.lower(style).contains(w)
    return F.struct(
        F.coalesce("part", F.lit("")).alias("part"), T.compact(F.coalesce("section_header", F.lit("")), 160).alias("section_header"), style.alias("paragraph_style"), heading.alias("heading_like"), _has(F.col("in_table")).alias("in_table"),
        _has(F.col("in_textbox")).alias("in_textbox"), _has(F.col("is_toc_entry")).alias("is_toc_entry"), F.slice(F.coalesce(issues, F.array().cast("array<struct<code: string, severity: string>>")), 1, 6).alias("issues"),
        _snippet("prev_text", 140).alias("prev_source"), _snippet("next_text", 140).alias("next_source"), "row_index", "col_index",
    )


def review_prompts(items: DataFrame, terms: DataFrame, instructions: str) -> DataFrame:
    """``chunk_id, prompt``: the instructions and the chunk with its terms and segments as JSON.

    ``items`` has ``chunk_id, pos, item`` (a struct), ``terms`` comes from used_terms.
    """
    g = items.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("segments"))
    j = g.join(terms.select("chunk_id", F.col("terms").alias("glossary_terms_used")), "chunk_id", "left").withColumn("glossary_terms_used", F.coalesce("glossary_terms_used", F.array().cast(f"array<{PAIR}>")))
    return j.select("chunk_id", F.concat(F.lit(f"{instructions}\nINPUT_JSON:\n"), F.to_json(F.struct("chunk_id", "glossary_terms_used", "segments"))).alias("prompt"))


def system_prompt(base: str, custom: str | None = None, glossary: str | None = None, examples: str | None = None, glossary_title: str = "Глоссарий (EN -> RU, приоритетно соблюдать):") -> str:
    """The instructions of a run: the basic ones, examples, those of the user and the glossary, each if it is there, apart by blank lines."""
    parts = [(x or "").strip() for x in (base, examples, custom)]
    rules = (glossary or "").strip()
    return "\n\n".join([*filter(None, parts), *([f"{glossary_title}\n{rules}"] if rules else [])])


def merged_maps(first: Column, second: Column) -> Column:
    """Both maps in one, the second's values before the first's; null maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(first, empty), F.coalesce(second, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
