"""Usage, cost, sizing and quality rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Profiles in their order (provider, prefix, input and output context, tier).
PROFILES = (
    ("openai", "gpt-5.2", 400000, 128000, "turbo"), ("openai", "gpt-5-mini", 400000, 128000, "turbo"), ("openai", "gpt-5-nano", 400000, 128000, "economy"),
    ("openai", "gpt-5", 400000, 128000, "turbo"), ("openai", "gpt-4.1-mini", 1047576, 32768, "balanced"), ("openai", "gpt-4o-mini", 128000, 16384, "economy"),
)
#: Limits of the tiers (batch characters and segments, output, review segments and output, review pages).
TIERS = {"economy": (12000, 6, 6000, 80, 2200, 2), "balanced": (18000, 10, 9000, 120, 3000, 3), "premium": (24000, 12, 12000, 140, 3600, 4), "turbo": (60000, 24, 64000, 120, 8000, 4)}


def totals(usage: DataFrame) -> DataFrame:
    """``phase, requests, input_tokens, output_tokens, total_tokens, cost, cost_records``: overall (phase null) and per phase. Negative tokens count 0; cost is null if none is known.

    Where the rows have a ``currency`` (and ``seq``), the last non-blank one by ``seq`` of each group comes too.
    """
    u = usage.withColumn("phase", F.coalesce(F.nullif(F.lower(F.trim("phase")), F.lit("")), F.lit("unknown")))
    pos = lambda c: F.sum(F.greatest(F.lit(0), F.coalesce(c, F.lit(0))))
    agg = [F.count("*").alias("requests"), pos("input_tokens").alias("input_tokens"), pos("output_tokens").alias("output_tokens"), pos("total_tokens").alias("total_tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.count("cost").alias("cost_records")]
    if {"currency", "seq"} <= set(usage.columns):
        agg.append(F.max_by("currency", F.when(F.length(F.trim("currency")) > 0, F.col("seq"))).alias("currency"))
    return u.rollup("phase").agg(*agg)


def with_cost(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """``cost`` by lower-cased provider and model; null without a price."""
    p = pricing.select(F.lower(F.trim("provider")).alias("_p"), F.lower(F.trim("model")).alias("_m"), "input_per_million", "output_per_million")
    j = usage.join(p, (F.lower(F.trim("provider")) == F.col("_p")) & (F.lower(F.trim("model")) == F.col("_m")), "left")
    t = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    return j.withColumn("cost", t("input_tokens") / 1e6 * F.col("input_per_million") + t("output_tokens") / 1e6 * F.col("output_per_million")).drop("_p", "_m", "input_per_million", "output_per_million")


def profiles(spark: SparkSession) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(PROFILES)]
    return spark.createDataFrame(rows, "pos int, profile_provider string, prefix string, input_context int, output_context int, tier string")


def with_profile(rows: DataFrame, spark: SparkSession, prefix: str = "") -> DataFrame:
    """Rows with the first profile (in list order) of their provider whose prefix is the model or starts it before a hyphen. Repeated rows stay.

    The fixed list of profiles is one expression, so nothing is joined. ``prefix`` is that of the two columns read and of those added.
    """
    m, p = F.lower(F.trim(f"{prefix}model")), F.lower(F.trim(f"{prefix}provider"))
    out = F.lit(None).cast("struct<profile: string, input_context: int, output_context: int, tier: string>")
    for provider, start, inp, outp, tier in reversed(PROFILES):
        this = F.struct(F.lit(start).alias("profile"), F.lit(inp).alias("input_context"), F.lit(outp).alias("output_context"), F.lit(tier).alias("tier"))
        out = F.when((p == provider) & ((m == start) | m.startswith(f"{start}-")), this).otherwise(out)
    j = rows.withColumn("_p", out)
    return j.select(*rows.columns, *(F.col(f"_p.{c}").alias(f"{prefix}{c}") for c in ("profile", "input_context", "output_context", "tier")))


#: Characters a token of the input and of the output, growth of a text by translation, shares of the context that are used (large, middle, small contexts) and of the reviewer's.
CHARS_IN, CHARS_OUT, GROWTH = 3.2, 2.2, 1.35
UTILISATION, REVIEW_UTILISATION = ((200_000, 0.15), (100_000, 0.10), (0, 0.08)), 0.14
TIER_FIELDS = ("batch_chars", "batch_segments", "output", "review_segments", "review_output", "review_pages")


def _tier(tier: Column, field: str) -> Column:
    k, out = TIER_FIELDS.index(field), F.lit(TIERS["balanced"][TIER_FIELDS.index(field)])
    for name, limits in TIERS.items():
        out = F.when(tier == name, limits[k]).otherwise(out)
    return out


def utilisation(context: Column) -> Column:
    out = F.lit(None).cast("double")
    for least, share in reversed(UTILISATION):
        out = F.when(context >= least, F.lit(share)).otherwise(out)
    return out


def _clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if isinstance(low, (int, float)) else low, F.least(F.lit(high) if isinstance(high, (int, float)) else high, x))


def sized(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows with the sizes that fit their models: ``out_batch_segments, out_batch_chars, out_output_tokens, out_review_pages, out_review_segments, out_review_output``.

    Rows have ``provider, model, review_provider, review_model, median_chars, prompt_chars, batch_segments,
    batch_max_chars, max_output_tokens, context_chars, review_pages, review_segments, review_output``. Without a known
    model the given sizes stay, but for their least values; a reviewer without one takes the translator's.
    """
    int_ = lambda c: c.cast("int")
    r = with_profile(with_profile(rows, spark), spark, "review_")
    for c in ("input_context", "output_context", "tier"):
        r = r.withColumn(f"review_{c}", F.coalesce(f"review_{c}", c))
    known, known_review = F.col("profile").isNotNull(), F.coalesce("review_profile", "profile").isNotNull()
    median = F.col("median_chars")
    segs, chars, tokens = F.greatest(F.lit(1), "batch_segments"), F.greatest(F.lit(1000), "batch_max_chars"), F.greatest(F.lit(256), "max_output_tokens")
    auto = known & (F.col("context_chars") <= 0) & (segs > 1)
    budget = int_(F.col("input_context") * utilisation(F.col("input_context")))
    usable = F.greatest(F.lit(900), budget - int_((F.greatest(F.lit(0), "prompt_chars") + 1200) / F.lit(CHARS_IN)))
    auto_chars = _clamp(int_(usable * F.lit(CHARS_IN)), 6000, _tier(F.col("tier"), "batch_chars"))
    r = r.withColumn("out_batch_chars", F.when(auto, auto_chars).otherwise(chars))
    auto_segs = _clamp(int_(F.col("out_batch_chars") / F.greatest(F.lit(320), median + 180)), 2, _tier(F.col("tier"), "batch_segments"))
    r = r.withColumn("out_batch_segments", F.when(auto, auto_segs).otherwise(segs))
    effective = F.when(F.col("out_batch_segments") <= 1, F.greatest(F.lit(1200), int_(median * F.lit(1.8)))).otherwise(F.col("out_batch_chars"))
    estimate = int_(effective * F.lit(GROWTH) / F.lit(CHARS_OUT)) + 420
    cap = F.least(_tier(F.col("tier"), "output"), F.greatest(F.lit(1024), int_(F.col("output_context") * F.lit(0.55))))
    r = r.withColumn("out_output_tokens", F.when(known, F.greatest(tokens, _clamp(estimate, 1400, cap))).otherwise(tokens))
    room = F.greatest(F.lit(700), int_(F.col("review_input_context") * F.lit(REVIEW_UTILISATION)) - int(1400 / CHARS_IN))
    review = _clamp(int_(int_(room * F.lit(CHARS_IN)) / F.greatest(F.lit(260), int_(median * F.lit(2.4)))), 24, _tier(F.col("review_tier"), "review_segments"))
    r = r.withColumn("out_review_segments", F.when(known_review, review).otherwise(F.greatest(F.lit(1), "review_segments")))
    r = r.withColumn("out_review_pages", F.when(known_review, _tier(F.col("review_tier"), "review_pages")).otherwise(F.greatest(F.lit(1), "review_pages")))
    edits = 500 + F.greatest(F.lit(4), F.floor(F.col("out_review_segments") / 8)) * 55
    most = F.least(_tier(F.col("review_tier"), "review_output"), F.greatest(F.lit(1000), int_(F.col("review_output_context") * F.lit(0.2))))
    given = F.greatest(F.lit(256), "review_output")
    return r.withColumn("out_review_output", int_(F.when(known_review, F.greatest(given, _clamp(edits, 900, most))).otherwise(given)))


#: Modes of grouping, each with segments and characters a request, characters of context, and the share of single fallbacks that is warned of; the last is the default.
GROUPING = {"sequential_context": (1, 12000, 900, 0.03), "grouped_aggressive": (20, 36000, 0, 0.12), "grouped_turbo": (24, 60000, 0, 0.20), "grouped_fast": (6, 14000, 0, 0.08)}


def grouping(mode: Column) -> Column:
    """``mode, batch_segments, batch_max_chars, context_chars, warn_ratio`` of a grouping mode; unknown ones are the default."""
    key, out = F.lower(F.trim(F.coalesce(mode, F.lit("")))), None
    for name, (segs, chars, context, warn) in reversed(GROUPING.items()):
        this = F.struct(F.lit(name).alias("mode"), F.lit(segs).alias("batch_segments"), F.lit(chars).alias("batch_max_chars"), F.lit(context).alias("context_chars"), F.lit(warn).alias("warn_ratio"))
        out = this if out is None else F.when(key == name, this).otherwise(out)
    return out


def latency(provider: Column, model: Column, grouped: Column, chars: Column) -> Column:
    """``low, high`` seconds a request takes; grouped requests of more than 36,000 characters take up to four times as long."""
    p, m = F.lower(F.trim(F.coalesce(provider, F.lit("")))), F.lower(F.trim(F.coalesce(model, F.lit(""))))
    more = F.when(m.startswith("gpt-5"), 1.0).otherwise(0.0)
    scale = F.when(grouped & (chars > 36000), F.least(F.lit(4.0), chars / 36000.0)).otherwise(1.0)
    pair = lambda a, b: F.struct(a.cast("double").alias("low"), b.cast("double").alias("high"))
    either = lambda a, b: F.when(grouped, F.lit(a)).otherwise(F.lit(b))
    fixed = F.when(p == "mock", pair(F.lit(0.01), F.lit(0.03))).when(p == "google", pair(F.lit(1.8), F.lit(5.0))).when(p == "ollama", pair(either(3.0, 2.0), either(18.0, 10.0)))
    openai = pair((either(10.0, 9.0) + more) * scale, (either(24.0, 17.0) + 3 * more) * scale)
    return fixed.when(p == "openai", openai).otherwise(pair(either(6.0, 4.0) * scale, either(16.0, 12.0) * scale))


def estimates(segments: DataFrame, configs: DataFrame, spark: SparkSession) -> DataFrame:
    """Per document before a run: ``segments, skipped, toc, complex, requests, prepare_s, eta_low, eta_high`` and the median length.

    Skipped are texts that need no translation, then contents, then (``complex``) what only a run in place can do; the
    rest is packed into requests where the mode groups. ``segments`` has ``doc_id, seq, segment_id, source_plain, is_toc_entry, complex``,
    ``configs`` one row a document: ``doc_id, provider, model, grouped, batch_segments, batch_max_chars``.
    """
    from .ordered import greedy_groups_by

    toc, hard = F.coalesce(F.col("is_toc_entry"), F.lit(False)), F.coalesce(F.col("complex"), F.lit(False))
    s = segments.withColumn("kind", F.when(~F.coalesce(T.needs_translation("source_plain"), F.lit(False)), "skipped").when(toc, "toc").when(hard, "complex").otherwise("todo"))
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    g = s.groupBy("doc_id").agg(F.count("*").alias("segments"), n("skipped"), n("toc"), n("complex"), n("todo"), median_chars(F.when(F.col("kind") == "todo", F.length("source_plain"))).alias("median_chars"))
    todo = s.where("kind = 'todo'").join(configs.select("doc_id", F.col("batch_segments").alias("most"), F.col("batch_max_chars").alias("limit")).where("most > 1"), "doc_id")
    packed = greedy_groups_by(todo, "doc_id", "seq", "source_plain").groupBy("doc_id").agg((F.max("group_no") + 1).alias("packed"))
    j = g.join(configs, "doc_id", "left").join(packed, "doc_id", "left").withColumn("grouped", F.coalesce("grouped", F.lit(False)) & (F.col("batch_segments") > 1))
    j = j.withColumn("requests", F.when(F.col("grouped"), F.coalesce("packed", F.lit(0))).otherwise(F.col("todo"))).withColumn("prepare_s", F.greatest(F.lit(2.0), F.col("segments") / 155.0))
    each = latency(F.col("provider"), F.col("model"), F.col("grouped"), F.col("batch_max_chars"))
    eta_ = lambda side: F.round(F.col("prepare_s") + F.col("requests") * each[side], 4)
    return j.select("doc_id", "segments", "skipped", "toc", "complex", F.col("requests").cast("bigint").alias("requests"), "median_chars", F.round("prepare_s", 4).alias("prepare_s"), eta_("low").alias("eta_low"), eta_("high").alias("eta_high"))


def median_chars(length: Column) -> Column:
    """Aggregate: the median of the lengths above 0, truncated; 420 without any."""
    return F.coalesce(F.median(F.when(length > 0, length)), F.lit(420.0)).cast("int")


def fallback_ratio(attempted: Column, fallback: Column, most: Column) -> Column:
    """``ratio, warn``: the share of requests that fell back to single texts; warned of above ``most`` from 20 requests on."""
    r = F.when(attempted > 0, fallback / attempted).otherwise(0.0)
    return F.struct(r.alias("ratio"), ((attempted >= 20) & (r > most)).alias("warn"))


def run_status(returncode: Column, phase: Column, stopping: Column, cancelled: Column) -> Column:
    """``cancelled``, ``stopping``, ``running``, ``completed`` or ``failed`` of a run by what is known of it; a phase ``done`` stands for the return code 0."""
    code = F.coalesce(returncode, F.when(F.lower(phase) == "done", 0))
    return F.when(F.coalesce(cancelled, F.lit(False)), "cancelled").when(code.isNull() & F.coalesce(stopping, F.lit(False)), "stopping").when(code.isNull(), "running").when(code == 0, "completed").otherwise("failed")


def grouped_timeout(timeout: Column, segments: Column, chars: Column) -> Column:
    t = F.greatest(F.lit(30.0), timeout)
    step = F.when(chars >= 100000, 360.0).when(chars >= 60000, 300.0).when(chars >= 36000, 180.0).otherwise(0.0)
    return F.when(segments <= 1, t).otherwise(F.greatest(t, step))


def review_timeout(timeout: Column, segments: Column) -> Column:
    n = F.greatest(F.lit(1), segments)
    return F.greatest(F.lit(30.0), timeout, F.when(n >= 160, 300.0).when(n >= 120, 240.0).when(n >= 80, 180.0).when(n >= 40, 120.0).otherwise(0.0))


def output_tokens(chars: Column) -> Column:
    """Estimate for a text of so many characters, truncated twice."""
    return ((chars * 1.35).cast("int") / 2.2).cast("int") + 420


def workers(concurrency: Column, jobs: Column, chars: Column) -> Column:
    most = F.when(chars >= 60000, 2).when(chars >= 36000, 3).otherwise(1 << 30)
    return F.greatest(F.lit(1), F.least(concurrency, jobs, most))


def document_quality(segments: DataFrame, issues: DataFrame, terms_checked: bool = True) -> DataFrame:
    """Per document: segments, issues by severity, segments with missing terms, compliance (null if terms aren't checked), layout issues, fixes."""
    place = segments.select("segment_id", "doc_id").distinct()
    n = place.groupBy("doc_id").agg(F.count("*").alias("segments"))
    j = issues.join(place.withColumnRenamed("segment_id", "key"), "key")
    severity = lambda x: F.count_if(F.col("severity") == x)
    q = j.groupBy("doc_id").agg(
        F.count("*").alias("issues"), severity("error").alias("errors"), severity("warn").alias("warnings"), severity("info").alias("infos"),
        F.count_distinct(F.when(F.col("code") == "glossary_lemma_mismatch", F.col("key"))).alias("mismatched"), F.count_if(F.col("code").contains("layout") | F.col("code").contains("overflow") | (F.col("code") == "length_ratio_high")).alias("layout_issues"),
        F.count_if(F.col("code") == "layout_auto_fix_applied").alias("fixes"),
    )
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rate = F.round(F.greatest(F.lit(0.0), 1 - F.coalesce("mismatched", F.lit(0)) / F.col("segments")), 6) if terms_checked else F.lit(None).cast("double")
    return n.join(q, "doc_id", "left").select("doc_id", "segments", *(z(c) for c in ("issues", "errors", "warnings", "infos", "mismatched", "layout_issues", "fixes")), rate.alias("compliance"))


def expansion(before: DataFrame, after: DataFrame, warn: float = 1.5) -> DataFrame:
    """Per document: ``avg_ratio, max_ratio, over`` of the lengths of the n-th texts of both lists, by ``seq`` and id, as far as both go; blank sources don't count.

    Both have ``doc_id, seq, segment_id, text``.
    """
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "segment_id"))
    side = lambda df, c: df.select("doc_id", place.alias("_n"), F.length(T.strip("text")).alias(c))
    r = side(before, "_a").join(side(after, "_b"), ["doc_id", "_n"]).where("_a > 0").withColumn("r", F.coalesce("_b", F.lit(0)) / F.col("_a"))
    return r.groupBy("doc_id").agg(F.round(F.avg("r"), 6).alias("avg_ratio"), F.round(F.max("r"), 6).alias("max_ratio"), F.count_if(F.col("r") > warn).alias("over"))


def quality_summary(quality: DataFrame) -> DataFrame:
    """Over all documents; averages skip nulls, of nothing they are null. With ``success`` and ``duration_s`` also how many succeeded and how long they took on average (0 of none)."""
    total = lambda c: F.sum(c).alias(c)
    agg = [F.count("*").alias("documents"), *(total(c) for c in ("segments", "issues", "errors", "warnings", "infos", "layout_issues", "fixes")), F.count_if(F.col("errors") == 0).alias("clean_documents"), F.round(F.avg("compliance"), 6).alias("avg_compliance")]
    if "success" in quality.columns:
        agg += [F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.round(F.coalesce(F.avg("duration_s"), F.lit(0.0)), 6).alias("avg_duration_s")]
    return quality.agg(*agg)


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the rate so far; null when there is none."""
    return F.when((done > 0) & (total > 0) & (elapsed > 0), F.greatest(F.lit(0), total - done) / (done / elapsed))
