"""The review loop: issue filters, edits, their evaluation and application, and the replay of the trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

REASONS = ("missing_suggested_target", "missing_instruction", "no_op", "nochange_instruction", "low_confidence", "style_tags_mismatch", "placeholders_mismatch")


def filtered(rows: DataFrame, issues: DataFrame, key: str, chunk: str, codes: tuple[str, ...] = (), severities: tuple[str, ...] = ()) -> DataFrame:
    """Rows with an issue that passes both filters (an empty one passes all); a chunk without any such row keeps all its rows."""
    hit = issues
    if codes:
        hit = hit.where(F.col("code").isin(*codes))
    if severities:
        hit = hit.where(F.col("severity").isin(*severities))
    if not codes and not severities:
        return rows
    marked = rows.join(hit.select(F.col("key").alias(key)).distinct().withColumn("_hit", F.lit(1)), key, "left")
    any_hit = marked.groupBy(chunk).agg(F.max("_hit").alias("_any"))
    return marked.join(any_hit, chunk).where(F.col("_hit").isNotNull() | F.col("_any").isNull()).drop("_hit", "_any")


#: Fixed value: instructions that ask for nothing.
NO_CHANGE = r"(?iU)\bno\s+change\s+needed\b|без\s+изменени"


def reasons(current: Column, suggested: Column, instruction: Column, confidence: Column, least: float = 0.0, safe_only: bool = True) -> Column:
    """Why an edit is not safe, in a fixed order; empty for a safe one. Texts compare with white space collapsed; with an empty current one nothing is compared."""
    s, c = T.flat(suggested), T.flat(current)
    i = T.strip(F.coalesce(instruction, F.lit("")))
    both = (s != "") & (c != "")
    rule = lambda cond, k: F.when(cond, REASONS[k])
    safe = F.lit(safe_only)
    all_ = F.array(
        rule(s == "", 0), rule(i == "", 1), rule(both & (s == c), 2), rule(i.rlike(NO_CHANGE), 3), rule(T.confidence(confidence) < max(0.0, min(1.0, least)), 4),
        rule(safe & both & (T.style_tokens(s) != T.style_tokens(c)), 5), rule(safe & both & (F.array_sort(T.placeholders(s)) != F.array_sort(T.placeholders(c))), 6),
    )
    return F.filter(all_, lambda x: x.isNotNull())


def filter_edits(edits: DataFrame, least: float = 0.0, safe_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Safe edits, and those skipped with their ``reasons``, judged by the target they were made for."""
    e = edits.withColumn("reasons", reasons(F.col("current_target"), F.col("suggested_target"), F.col("instruction"), F.col("confidence"), least, safe_only))
    return e.where(F.size("reasons") == 0).drop("reasons"), e.where(F.size("reasons") > 0)


def parse_edits(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Edits of recovered answers (``chunk_id, payload``, JSON texts) on known segments (``chunk_id, segment_id``).

    Edits without a known id, a suggestion or an instruction are left out; types are in lower case, ``other`` if missing. ``edit_no``
    counts from 1 within a chunk as the answer lists them.
    """
    item = "struct<segment_id: string, location: string, severity: string, issue_type: string, source_excerpt: string, current_target: string, suggested_target: string, instruction: string, confidence: string>"
    # Each item is parsed on its own, so that one that is no object does not spoil the list.
    e = answers.select("chunk_id", F.posexplode(F.from_json(F.get_json_object("payload", "$.edits"), "array<string>")).alias("pos", "x")).select("chunk_id", "pos", F.from_json("x", item).alias("e")).where(F.col("e").isNotNull())
    text = lambda c: T.strip(F.coalesce(F.col(f"e.{c}"), F.lit(""))).alias(c)
    kind = F.lower(T.strip(F.coalesce(F.col("e.issue_type"), F.lit(""))))
    rows = e.select(
        "chunk_id", (F.col("pos") + 1).alias("edit_no"), text("segment_id"), text("location"), T.severity(F.coalesce(F.col("e.severity"), F.lit(""))).alias("severity"), F.when(kind == "", "other").otherwise(kind).alias("issue_type"),
        text("source_excerpt"), text("current_target"), text("suggested_target"), text("instruction"), T.confidence("e.confidence").alias("confidence"),
    )
    return rows.where("suggested_target != '' and instruction != ''").join(known.select("chunk_id", "segment_id").distinct(), ["chunk_id", "segment_id"], "left_semi")


def first_edits(edits: DataFrame) -> DataFrame:
    """Edits without repeats of one chunk, segment, type, suggestion and instruction; the first of each by ``edit_no``."""
    w = Window.partitionBy("chunk_id", "segment_id", "issue_type", T.normalize("suggested_target"), T.normalize("instruction")).orderBy("edit_no")
    return edits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def attach_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """The first edits on known segments, types normalised; a known segment's edits keep their order."""
    e = edits.withColumn("issue_type", F.coalesce(F.nullif(F.lower(T.strip("issue_type")), F.lit("")), F.lit("other")))
    return first_edits(e.join(segments.select("segment_id").distinct(), "segment_id", "left_semi"))


def apply_edits(segments: DataFrame, edits: DataFrame, least: float = 0.0, safe_only: bool = True, match_current: bool = True) -> DataFrame:
    """``edit_no, segment_id, applied, reasons, target``: edits applied one after the other, each to what the ones before left.

    Edits find their segment by id, else by location (the last segment of a location); an edit whose target was made
    for another current text is skipped, as are those with a reason against them. ``target`` is the segment's text after
    the edit. Edits of no segment have the reason ``segment_not_found`` and no id. A segment's few edits are folded in order.
    """
    known = segments.select("segment_id").distinct()
    by_id = edits.join(known, "segment_id")
    rest = edits.join(known, "segment_id", "left_anti").drop("segment_id")
    at = segments.where(F.length("location") > 0).groupBy("location").agg(F.max_by("segment_id", "seq").alias("segment_id"))
    rest = rest.join(at, "location", "left")
    found = by_id.unionByName(rest.where(F.col("segment_id").isNotNull()), allowMissingColumns=True)
    lost = rest.where(F.col("segment_id").isNull()).select("edit_no", F.lit(None).cast("string").alias("segment_id"), F.lit(False).alias("applied"), F.array(F.lit("segment_not_found")).alias("reasons"), F.lit(None).cast("string").alias("target"))
    e = F.struct("edit_no", "current_target", "suggested_target", "instruction", "confidence")
    per = found.groupBy("segment_id").agg(F.array_sort(F.collect_list(e)).alias("edits"))
    done = F.struct(F.lit(0).cast("bigint").alias("edit_no"), F.lit(False).alias("applied"), F.array().cast("array<string>").alias("reasons"), F.coalesce("target_tagged", F.lit("")).alias("target"))

    def step(acc, x):
        now = F.element_at(acc, -1)["target"]
        made, current = T.flat(x["current_target"]), T.flat(now)
        other = F.lit(match_current) & (made != "") & (current != "") & (made != current)
        why = F.when(other, F.array(F.lit("current_target_mismatch"))).otherwise(reasons(now, x["suggested_target"], x["instruction"], x["confidence"], least, safe_only))
        ok = F.size(why) == 0
        return F.concat(acc, F.array(F.struct(x["edit_no"].cast("bigint").alias("edit_no"), ok.alias("applied"), why.alias("reasons"), F.when(ok, x["suggested_target"]).otherwise(now).alias("target"))))

    one = segments.dropDuplicates(["segment_id"]).join(per, "segment_id").select("segment_id", F.aggregate("edits", F.array(done), step).alias("steps"))
    out = one.select("segment_id", F.explode(F.slice("steps", 2, 1 << 30)).alias("x")).select(F.col("x.edit_no").alias("edit_no"), "segment_id", F.col("x.applied").alias("applied"), F.col("x.reasons").alias("reasons"), F.col("x.target").alias("target"))
    return out.unionByName(lost.withColumn("edit_no", F.col("edit_no").cast("bigint")))


def applied_targets(steps: DataFrame) -> DataFrame:
    """``segment_id, target, applied, skipped`` of the steps of apply_edits: each segment's text after its last edit."""
    n = lambda c: F.count_if(c)
    return steps.where(F.col("segment_id").isNotNull()).groupBy("segment_id").agg(F.max_by("target", "edit_no").alias("target"), n(F.col("applied")).alias("applied"), n(~F.col("applied")).alias("skipped"))


def skipped_reasons(steps: DataFrame) -> DataFrame:
    """``reason, n`` over all skipped edits."""
    return steps.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def align_by_location(output: DataFrame, source: DataFrame) -> DataFrame:
    """Counts of an output held against its source by location (of repeated locations the last row counts): candidates, equal, missing either way."""
    last = lambda df, c: df.groupBy("location").agg(F.max_by(c, "seq").alias(c))
    o, s = last(output, "target"), last(source, "source")
    j = o.join(s, "location", "full")
    same = T.normalize("target") == T.normalize("source")
    return j.agg(
        F.count_if(F.col("target").isNotNull() & F.col("source").isNotNull() & ~same).alias("candidates"), F.count_if(same).alias("equal"),
        F.count_if(F.col("source").isNull() & F.col("target").isNotNull()).alias("missing_source"), F.count_if(F.col("target").isNull() & F.col("source").isNotNull()).alias("missing_output"),
    )


#: Counters of the trace, each with the event that raises it; the first three come from summaries alone.
COUNTERS = {
    "chunks_total": None, "segments_checked": None, "translatable_segments": None, "requests_total": "request", "requests_succeeded": "response", "requests_failed": "error", "chunks_failed": "failed_chunk",
    "split_events": "split", "suggestions_total": "response",
}


def replay(trace: DataFrame) -> DataFrame:
    """One row of counters. ``trace`` has ``line_no, event, edits_count`` and, of summaries, the counters they carry (missing columns count as null).

    A summary's counter takes the place of what was counted before it, and later events add to it; a counter that no
    summary carries counts all events. Of each counter the last summary that carries it is found first, so that both
    passes are aggregations.
    """
    t = trace.select("line_no", "event", "edits_count", *(F.col(c).cast("long").alias(c) if c in trace.columns else F.lit(None).cast("long").alias(c) for c in COUNTERS))
    carried = lambda c: (F.col("event") == "summary") & F.col(c).isNotNull()
    base = t.agg(F.coalesce(F.max(F.col("event") == "summary"), F.lit(False)).alias("summary_present"), *(F.max(F.when(carried(c), F.struct("line_no", c))).alias(f"_{c}") for c in COUNTERS))
    gain = lambda c, e: F.when(F.col("event") == e, F.greatest(F.lit(0), F.coalesce("edits_count", F.lit(0))) if c == "suggestions_total" else F.lit(1))
    after = lambda c: F.col(f"_{c}").isNull() | (F.col("line_no") > F.col(f"_{c}.line_no"))
    count = t.select("line_no", "event", "edits_count").join(F.broadcast(base)).agg(*(F.coalesce(F.sum(F.when(after(c), gain(c, e))), F.lit(0)).alias(f"+{c}") for c, e in COUNTERS.items() if e))
    j = base.join(F.broadcast(count))
    kept = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(f"_{c}.{c}"), F.lit(0)))
    return j.select(*((kept(c) + (F.col(f"`+{c}`") if e else F.lit(0))).cast("long").alias(c) for c, e in COUNTERS.items()), "summary_present")


def completed_roots(trace: DataFrame) -> DataFrame:
    """``chunk_id`` of requested root chunks that ended, or all whose halves did, down to any depth of splits.

    A chunk that was split and ended counts as ended; of any other split chunk both halves must be complete. So a chunk is
    complete if each of its leaves ended, and levels are folded from the deepest one up.
    """
    t = trace.where(F.length("chunk_id") > 0)
    state = t.groupBy("chunk_id").agg(F.max(F.col("event").isin("response", "failed_chunk")).alias("ended"), F.max(F.col("event") == "split").alias("split"))
    ended, split = state.where("ended").select("chunk_id"), state.where("split and not ended").select("chunk_id")
    level = F.size(F.split("chunk_id", r"\.")) - 1
    deepest = split.agg(F.max(level)).first()[0]
    done = ended
    for k in range(deepest if deepest is not None else -1, -1, -1):
        half = lambda h: done.where(F.col("chunk_id").endswith(f".{h}") & (level == k + 1)).select(F.expr("left(chunk_id, length(chunk_id) - 2)").alias("chunk_id"))  # noqa: E731, B023
        done = done.unionByName(split.where(level == k).join(half("a"), "chunk_id", "left_semi").join(half("b"), "chunk_id", "left_semi")).distinct()
    roots = trace.where((F.col("event") == "request") & ~F.contains("chunk_id", F.lit(".")) & (F.length("chunk_id") > 0)).select("chunk_id").distinct()
    return roots.join(done, "chunk_id", "left_semi")


def used_terms(terms: DataFrame, limit: int = 200) -> DataFrame:
    """``chunk_id, terms``: of each chunk the different pairs (case ignored) in order of first use, at most ``limit``.

    ``terms`` has ``chunk_id, pos, source, target``; blank sides are left out.
    """
    t = terms.select("chunk_id", "pos", T.strip("source").alias("source"), T.strip("target").alias("target")).where("source != '' and target != ''")
    first = t.groupBy("chunk_id", F.lower("source").alias("_s"), F.lower("target").alias("_t")).agg(F.min(F.struct("pos", "source", "target")).alias("x"))
    r = first.withColumn("_r", F.row_number().over(Window.partitionBy("chunk_id").orderBy("x.pos", "x.source", "x.target"))).where(F.col("_r") <= limit)
    return r.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col("x.source").alias("source"), F.col("x.target").alias("target")))), lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"))).alias("terms"))


def summary_json(edits: DataFrame, least: float = 0.0) -> DataFrame:
    """One JSON text of the safe and the skipped edits with their counts. The edits of one run are the rows of a report."""
    safe, skipped = filter_edits(edits, least)
    listed = lambda df, cols: df.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*cols))).alias("rows"))
    a, b = listed(safe, ["edit_no", "segment_id", "suggested_target", "instruction"]), listed(skipped, ["edit_no", "segment_id", "reasons"])
    both = a.select(F.col("n").alias("count"), F.col("rows").alias("safe_edits")).join(b.select(F.col("n").alias("skipped_count"), F.col("rows").alias("skipped")))
    return both.select(F.to_json(F.struct("count", (F.col("count") + F.col("skipped_count")).alias("source_count"), "skipped_count", "safe_edits", "skipped")).alias("report"))
