"""Comparing the structure of documents before and after: counts, patterns of markup, paragraphs in step, and where a document comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The patterns of markup that are counted.
PATTERNS = {
    "drawing": r"<w:drawing", "pict": r"<w:pict", "br_any": r"<w:br", "br_column": r"<w:br[^>]*w:type=\"column\"", "hyperlink": r"<w:hyperlink", "fldChar": r"<w:fldChar", "instrText": r"<w:instrText", "sectPr": r"<w:sectPr",
}


def pattern_counts(parts: DataFrame, key: str = "doc", xml: str = "xml", patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """Per document, how often each pattern occurs in its parts; null parts count nothing."""
    n = lambda p: F.sum(F.regexp_count(F.coalesce(xml, F.lit("")), F.lit(p)))
    return parts.groupBy(key).agg(*(n(p).cast("bigint").alias(k) for k, p in patterns.items()))


def pattern_diff(before: DataFrame, after: DataFrame, key: str = "doc", patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """Per document, the counts after less those before; what is missing counts 0."""
    named = lambda df, side: pattern_counts(df, key, patterns=patterns).select(F.col(key).alias(f"_{side}"), *(F.col(c).alias(f"{side}_{c}") for c in patterns))
    j = named(before, "a").join(named(after, "b"), F.col("_a").eqNullSafe(F.col("_b")), "full")
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.select(F.coalesce("_a", "_b").alias(key), *((z(f"b_{c}") - z(f"a_{c}")).alias(c) for c in patterns))


def basic_stats(paragraphs: DataFrame, key: str = "doc") -> DataFrame:
    """Per document: body paragraphs, tables of the body, all paragraphs including those in tables. ``location`` is that of the scan."""
    table = F.regexp_extract("location", r"^(body/t\d+)(?:/|$)", 1)
    body = F.col("location").rlike(r"^body/p\d+$")
    inside = body | F.col("location").startswith("body/t")
    return paragraphs.groupBy(key).agg(F.count_if(body).alias("body_paragraphs"), F.count_distinct(F.when(table != "", table)).alias("tables"), F.count_if(inside).alias("all_paragraphs"))


def mismatches(before: DataFrame, after: DataFrame, key: str = "doc", limit: int = 20, snippet: int = 300) -> DataFrame:
    """``doc, seq, location, source, target``: paragraphs in step whose texts differ, up to the first pair of different locations, which is reported and ends the comparison; at most ``limit`` a document.

    Both have ``doc, seq, location, text``; ``seq`` numbers the paragraphs of a document from 0.
    """
    a = before.select(key, "seq", F.col("location").alias("la"), F.coalesce("text", F.lit("")).alias("ta"))
    b = after.select(key, "seq", F.col("location").alias("lb"), F.coalesce("text", F.lit("")).alias("tb"))
    j = a.join(b, [key, "seq"]).withColumn("apart", F.col("la") != F.col("lb"))
    end = j.where("apart").groupBy(key).agg(F.min("seq").alias("_end"))
    j = j.where("apart or ta != tb").join(end, key, "left").where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    r = j.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where(F.col("_r") <= limit)
    text = lambda c: F.when(F.col("apart"), "").otherwise(F.left(c, F.lit(snippet)))
    return r.select(key, "seq", F.when(F.col("apart"), F.concat("la", F.lit(" != "), "lb")).otherwise(F.col("la")).alias("location"), text("ta").alias("source"), text("tb").alias("target"))


def marker_leaks(paragraphs: DataFrame, key: str = "doc") -> DataFrame:
    """Per document, how many paragraphs still hold a bracket of a marker."""
    return paragraphs.groupBy(key).agg(F.count_if(F.coalesce(F.col("text").rlike("[⟦⟧]"), F.lit(False))).alias("leaks"))


def origin(author: Column, modified_by: Column, frames: Column, paragraphs: Column, no_autofit: Column) -> Column:
    """``abbyy`` for documents of that converter: by a name in the properties, fixed text boxes, or frames around three in ten paragraphs or more; else ``native_docx``."""
    name = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("abbyy")
    many = F.when(paragraphs > 0, frames / paragraphs).otherwise(0.0) >= 0.3
    return F.when(name(author) | name(modified_by) | (F.coalesce(no_autofit, F.lit(0)) > 0) | many, "abbyy").otherwise("native_docx")


def formatting_preset(preset: Column, origin_: Column) -> Column:
    """The preset itself, or for ``auto`` the one of the document's origin; ``off`` without one."""
    p = F.lower(F.trim(F.coalesce(preset, F.lit("off"))))
    return F.when(p != "auto", p).when(origin_ == "abbyy", "abbyy_standard").otherwise("native_docx")


def merged_spans(runs: DataFrame, order: Window | None = None) -> DataFrame:
    """``paragraph, span_id, source_text, style, run_lengths``: neighbouring runs of one style as one span, numbered from 1 in each paragraph.

    ``runs`` has ``paragraph, pos, text, style`` (any comparable type). Empty runs belong to no span.
    """
    w = Window.partitionBy("paragraph").orderBy("pos")
    r = runs.where(F.length("text") > 0)
    new = (~F.coalesce(F.lag("style").over(w).eqNullSafe(F.col("style")) & F.lag("pos").over(w).isNotNull(), F.lit(False))).cast("int")
    r = r.withColumn("_new", new).withColumn("span_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.array_sort(F.collect_list(F.struct("pos", "text")))
    g = r.groupBy("paragraph", "span_id").agg(item.alias("i"), F.min_by("style", "pos").alias("style"))
    return g.select("paragraph", "span_id", F.array_join(F.transform("i", lambda x: x["text"]), "").alias("source_text"), "style", F.transform("i", lambda x: F.length(x["text"])).alias("run_lengths"))
