"""The translation memory: exact lookup, upsert, resume, search, re-keying."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shield import unshield
from ..sources.tables import keep_latest


def upsert(memory: DataFrame, changes: DataFrame | None = None, key: str = "source_hash") -> DataFrame:
    """One row per key, the latest by ``updated_at``; ``created_at`` stays that of the first insert. Null keys are one key; ties fall to the larger target."""
    rows = memory if changes is None else memory.unionByName(changes)
    latest = keep_latest(rows.drop("created_at"), [key], [F.col("updated_at").desc_nulls_last(), F.col("source_norm").desc_nulls_last(), F.col("target_text").desc_nulls_last()])
    first = rows.groupBy(key).agg(F.min("created_at").alias("created_at"))
    return latest.join(first.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def latest_progress(progress: DataFrame) -> DataFrame:
    """The latest state of each segment; ties fall to the larger status and hash."""
    return keep_latest(progress, ["segment_id"], [F.col("updated_at").desc_nulls_last(), F.col("status").desc_nulls_last(), F.col("source_hash").desc_nulls_last(), F.col("error").desc_nulls_last()])


def exact_hits(rows: DataFrame, memory: DataFrame, key: str = "source_hash") -> DataFrame:
    """Left join on the unique key: ``hit`` and the stored target. Null keys never hit."""
    m = memory.select(key, F.col("target_text").alias("memory_target"), F.lit(True).alias("hit"))
    return rows.join(m, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def reusable(segments: DataFrame, progress: DataFrame, memory: DataFrame, current: str | None = None) -> DataFrame:
    """Segments done before whose stored hash is that of their text now (the column ``current``, if given) and still in the memory: ``segment_id, status, reuse``."""
    state = latest_progress(progress).select("segment_id", "status", "source_hash")
    rows = segments.select("segment_id", (F.col(current) if current else F.lit(None).cast("string")).alias("_now")).dropDuplicates(["segment_id"]).join(state, "segment_id", "left")
    hit = exact_hits(rows, memory)
    same = F.coalesce(F.col("_now") == F.col("source_hash"), F.lit(False)) if current else F.lit(True)
    return hit.select("segment_id", "status", (F.coalesce(F.col("status").isin("ok", "tm"), F.lit(False)) & F.col("hit") & same).alias("reuse"))


def put_progress(progress: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per segment with all columns of its latest state; changes come after what is there, and of one batch the latest ``updated_at`` counts."""
    both = progress.withColumn("_n", F.lit(0)).unionByName(changes.withColumn("_n", F.lit(1)))
    return keep_latest(both, ["segment_id"], [F.col("_n").desc(), F.col("updated_at").desc_nulls_last(), F.col("status").desc_nulls_last(), F.col("source_hash").desc_nulls_last(), F.col("error").desc_nulls_last()]).drop("_n")


def migrated_count(progress: DataFrame, rekeyed: DataFrame) -> DataFrame:
    """``segments``: how many progress rows carry a hash that was re-keyed."""
    return progress.join(rekeyed.select(F.col("old_hash").alias("source_hash")).distinct(), "source_hash", "left_semi").agg(F.count("*").alias("segments"))


def search(memory: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """The newest entries that hold a term on either side, case ignored."""
    t = term.lower()
    return memory.where(F.lower("source_norm").contains(t) | F.lower("target_text").contains(t)).orderBy(F.col("updated_at").desc(), "source_hash").limit(limit)


def rekey(memory: DataFrame, old_profile: str, new_profile: str) -> DataFrame:
    """Entries whose key is that of the old profile, under the key of the new one: ``source_hash, old_hash`` and the texts."""
    old = T.memory_key("source_norm", old_profile)
    return memory.where(F.col("source_hash") == old).withColumn("old_hash", F.col("source_hash")).withColumn("source_hash", T.memory_key("source_norm", new_profile))


def rekey_progress(progress: DataFrame, rekeyed: DataFrame) -> DataFrame:
    """Progress with the new hashes where the old one was re-keyed."""
    m = rekeyed.select(F.col("old_hash").alias("source_hash"), F.col("source_hash").alias("_new")).distinct()
    return progress.join(m, "source_hash", "left").withColumn("source_hash", F.coalesce("_new", "source_hash")).drop("_new")


def token_index(memory: DataFrame) -> DataFrame:
    """``token, source_hash``: the inverted index of the fuzzy lookup."""
    return memory.select(F.explode(F.array_distinct(T.tokens("source_norm"))).alias("token"), "source_hash").distinct()


def missing_from_index(memory: DataFrame, index: DataFrame) -> DataFrame:
    """Entries that the index lacks."""
    return memory.join(index.select("source_hash").distinct(), "source_hash", "left_anti")


def with_metadata(rows: DataFrame, origin: str, provider: str = "", model: str = "") -> DataFrame:
    """Rows with ``meta_json``: where a translation comes from."""
    f = {"provider": F.lit(provider), "model": F.lit(model), "origin": F.lit(origin), **{c: F.col(c) for c in ("segment_id", "location", "part", "section_header") if c in rows.columns}}
    f["in_table"] = F.coalesce(F.col("in_table"), F.lit(False)) if "in_table" in rows.columns else F.lit(False)
    if "source_hash" in rows.columns:
        f["source_hash"] = F.col("source_hash")
    return rows.withColumn("meta_json", F.to_json(F.struct(*(c.alias(k) for k, c in f.items())), {"ignoreNullFields": "false"}))


def history(segments: DataFrame, origin: str, provider: str = "", model: str = "") -> DataFrame:
    """Records of translated segments: both texts without masks and markers, and where they come from."""
    plain = lambda c: T.strip_markers(unshield(F.coalesce(F.col(c), F.lit("")), F.coalesce("token_map", F.create_map().cast("map<string,string>"))))
    keep = [F.col(c) for c in ("source_hash", "segment_id", "location", "part", "section_header") if c in segments.columns]
    return segments.select(F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(origin).alias("origin"), *keep, F.coalesce("in_table", F.lit(False)).alias("in_table"), plain("shielded_tagged").alias("source_text"), plain("target_shielded_tagged").alias("target_text"))


#: The settings that a profile's key is made of, in order, each with its form.
PROFILE_FIELDS = (
    ("provider", "lower"), ("model", "strip"), ("source_lang", "lower"), ("target_lang", "lower"), ("hard_glossary", "flag"), ("glossary_in_prompt", "flag"), ("glossary_prompt_mode", "lower"), ("glossary_match_limit", "int"),
    ("structured_output_mode", "lower"), ("batch_segments", "int"), ("batch_skip_on_brline", "flag"), ("batch_max_style_tokens", "int"), ("context_window_chars", "int"), ("fuzzy_enabled", "flag"), ("fuzzy_top_k", "int"),
    ("fuzzy_min_similarity", ".4f"), ("fuzzy_prompt_max_chars", "int"), ("fuzzy_token_regex", "str"), ("fuzzy_rank_mode", "lower"), ("abbyy_profile", "lower"), ("glossary_lemma_check", "lower"), ("layout_check", "flag"),
    ("layout_expansion_warn_ratio", ".3f"), ("layout_auto_fix", "flag"), ("layout_font_reduction_pt", ".3f"), ("layout_spacing_factor", ".3f"), ("reasoning_effort", "lower"),
)


def profile_key(settings: dict, prompt: str | None = None, glossary: str | None = None) -> str:
    """The key of a configuration: all settings that change a translation, with fingerprints of the prompt and the glossary. A missing effort is ``default``."""
    form = {"lower": lambda x: str(x or "").strip().lower(), "strip": lambda x: str(x or "").strip(), "flag": lambda x: str(int(bool(x))), "int": lambda x: str(int(x or 0)), "str": lambda x: str(x or "")}
    value = lambda k, how: form[how](settings.get(k)) if how in form else format(float(settings.get(k) or 0), how)
    parts = [f"{k}={value(k, how) or ('default' if k == 'reasoning_effort' else '')}" for k, how in PROFILE_FIELDS]
    return "|".join([*parts, f"system_prompt_sha={fingerprint(prompt)}", f"glossary_sha={fingerprint(glossary)}"])


def fingerprint(text: str | None) -> str:
    if not text:
        return "none"
    lines = (" ".join(x.split()) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    return hashlib.sha256("\n".join(lines).strip().encode()).hexdigest()
