"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import current_memory, table
from . import align, encode, leak, lookalike, neardup, pack, pairs, residue, scan


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.defects(pairs.pairs(spark, d)).where("defect_type = 'truncated'")
    return found.select("table_name", "record_key").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """Records with a target and the share of cut ones, by config of segments and origin of memory rows."""
    one = pairs.defects(pairs.pairs(spark, d)).groupBy("table_name", "grp", "record_key").agg(F.max((F.coalesce("defect_type", F.lit("")) == "truncated").cast("int")).alias("cut"))
    return one.groupBy("table_name", "grp").agg(F.count("*").alias("records"), F.sum("cut").alias("cut_records"), F.round(F.avg("cut"), 6).alias("cut_share"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(pairs.pairs(spark, d)).where(F.col("defect_type").isNotNull()).groupBy("table_name", "record_key").agg(F.min("defect_type").alias("defect_type"))


def p2_requests(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_requests(table(spark, d, "segments"), table(spark, d, "llm_config"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_requests(spark, d).where("n_pieces > 1").select("segment_id").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.similar_pairs(current_memory(spark, d), "source_hash", "source_norm")
    return pairs.select(F.col("key_a").alias("source_hash_a"), F.col("key_b").alias("source_hash_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(current_memory(spark, d), "source_hash", "source_norm").withColumnRenamed("key", "source_hash")


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    rows = align.aligned_lines(current_memory(spark, d), "source_hash", "source_norm", "target_text")
    return rows.select(F.col("key").alias("source_hash"), "source_line", "target_line", F.round("similarity", 6).alias("similarity"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_links(spark, d).select("source_hash", "source_line", "target_line").distinct()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = align.aligned_groups(current_memory(spark, d), "source_hash", "source_norm", "target_text")
    return rows.select(F.col("key").alias("source_hash"), "kind", "source_lines", "target_lines", F.round("similarity", 6).alias("similarity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scan.noise_kinds(table(spark, d, "segments"), table(spark, d, "pdf_blocks"), table(spark, d, "pdf_pages"))


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scan.paragraphs(table(spark, d, "segments"), table(spark, d, "pdf_blocks"), table(spark, d, "pdf_pages"))


def keyed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Source texts of segments and of current memory rows under one key."""
    a = table(spark, d, "segments").select(F.concat(F.lit("segments:"), "segment_id").alias("key"), F.col("source_plain").alias("text"))
    b = current_memory(spark, d).select(F.concat(F.lit("tm_exact:"), "source_hash").alias("key"), F.col("source_norm").alias("text"))
    return a.unionByName(b)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(keyed_sources(spark, d))


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.with_form(keyed_sources(spark, d)).select("key", "form")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_cut(spark: SparkSession, d: str) -> DataFrame:
    """All documents without the leaked passages; those that are mostly such are left out."""
    return leak.cut_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id", "residue", F.round("score", 6).alias("score"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents").select("doc_id", "text", "source")).where("residue").select("doc_id").distinct()


def p10_validation(spark: SparkSession, d: str) -> DataFrame:
    return residue.validate(table(spark, d, "documents"))


P2_SQL = """
SELECT DISTINCT s.segment_id FROM segments s JOIN llm_config c ON s.config_id = c.config_id
WHERE length(s.source_plain) > c.batch_max_chars
"""

P4_SQL = """
WITH cur AS (SELECT source_hash, source_norm FROM (SELECT *, row_number() OVER (PARTITION BY source_hash ORDER BY updated_at DESC, source_norm DESC, target_text DESC) rn FROM tm_exact) WHERE rn = 1),
w AS (SELECT source_hash, list_distinct(regexp_extract_all(lower(source_norm), '[a-zа-яё0-9]{2,}')) AS w FROM cur),
c AS (SELECT source_hash, w, len(w) AS n FROM w WHERE len(w) >= 40)
SELECT a.source_hash AS source_hash_a, b.source_hash AS source_hash_b FROM c a JOIN c b ON a.source_hash < b.source_hash
WHERE a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n AND len(list_intersect(a.w, b.w)) * 1.8 >= 0.8 * (a.n + b.n) - 1e-9
"""

P9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS t FROM eval_items WHERE text IS NOT NULL),
w AS (SELECT DISTINCT item_id, substr(t, k, 60) AS run FROM (SELECT item_id, t, unnest(range(1, length(t) - 58)) AS k FROM i WHERE length(t) >= 60)),
g AS (SELECT doc_id, substr(t, k, 60) AS run FROM (SELECT doc_id, t, unnest(range(1, length(t) - 58)) AS k FROM d WHERE length(t) >= 60))
SELECT DISTINCT doc_id, item_id FROM g JOIN w USING (run)
"""


def queries():
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql():
    return {"p2_found": P2_SQL, "p4_found": P4_SQL, "p9_found": P9_SQL}
