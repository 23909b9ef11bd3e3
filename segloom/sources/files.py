"""File sources and sinks around the operators: tolerant JSON lines, logs, glossaries, prices, lists, mappings and reports."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glossary as G
from ..operators import usage


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank, broken and non-object lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    ok = F.try_parse_json("value")
    return lines.where(ok.isNotNull() & F.col("value").rlike(r"^\s*\{")).select(F.from_json("value", schema).alias("r")).select("r.*")


def count_records(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def last_capture(spark: SparkSession, path: str, pattern: str = r"TM hits:\s*(\d+)") -> int | None:
    """The last capture of a pattern in one log file, by line order; None without a match. Lines are read as rows of one partition in their order, so the log is never one row."""
    t = spark.read.text(path).coalesce(1).select(F.monotonically_increasing_id().alias("no"), F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("m"))
    row = t.where(F.size("m") > 0).agg(F.max_by(F.element_at("m", -1), "no").cast("long").alias("v")).first()
    return row["v"]


def tail_lines(spark: SparkSession, path: str, most: int = 120) -> list[str]:
    """The last lines of a log file, at most so many, in order."""
    t = spark.read.text(path).coalesce(1).select(F.monotonically_increasing_id().alias("no"), "value")
    return [r["value"] for r in reversed(t.orderBy(F.col("no").desc()).limit(most).collect())]


def runs(spark: SparkSession, pattern: str, newest_first: bool = True) -> DataFrame:
    """``folder, status`` and the fields of each status file that a pattern finds; a run in phase ``done`` has the return code 0. Broken files are left out."""
    t = spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1).alias("folder"), F.from_json("value", "phase string, returncode int, started_at string, stopping boolean, cancelled boolean").alias("s"))
    r = t.where(F.col("s").isNotNull()).select("folder", "s.*").withColumn("status", usage.run_status(F.col("returncode"), F.col("phase"), F.col("stopping"), F.col("cancelled")))
    r = r.withColumn("returncode", F.coalesce("returncode", F.when(F.lower("phase") == "done", 0)))
    return r.orderBy(F.col("folder").desc()) if newest_first else r


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """Edits of suggestion files: the list ``edits``, or ``safe_edits`` where there is none; ``edit_no`` counts from 1 in each file."""
    item = "array<struct<segment_id: string, location: string, chunk_id: string, severity: string, issue_type: string, current_target: string, suggested_target: string, instruction: string, confidence: double>>"
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", f"edits {item}, safe_edits {item}").alias("p"))
    return t.select(F.posexplode(F.coalesce("p.edits", "p.safe_edits")).alias("edit_no", "e")).select((F.col("edit_no") + 1).alias("edit_no"), "e.*")


def write_events(events: DataFrame, folder: str) -> None:
    """Appends events to a trace, one JSON record each; what streams read."""
    events.write.mode("append").json(folder)


def load_yaml(text: str) -> dict:
    """A JSON or YAML text as a dictionary; YAML needs its package. Empty texts give an empty one."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    if data is not None and not isinstance(data, dict):
        raise ValueError("a mapping is needed")
    return data or {}


def load_config(path: str, defaults: dict, choices: dict[str, tuple[str, ...]] | None = None) -> dict:
    """The settings of a file over their defaults, section by section.

    A value takes the type of its default: lists become tuples, numbers and flags are converted; a name with fixed choices is lowered and must be one of them.
    """
    return _merged(defaults, load_yaml(Path(path).read_text(encoding="utf-8")), choices or {}, "")


def _merged(defaults: dict, given: dict, choices: dict, at: str) -> dict:
    out = {}
    for k, default in defaults.items():
        value, name = given.get(k), f"{at}{k}"
        if isinstance(default, dict):
            out[k] = _merged(default, value or {}, choices, f"{name}.")
        elif value is None:
            out[k] = default
        elif name in choices:
            out[k] = str(value).strip().lower()
            if out[k] not in choices[name]:
                raise ValueError(f"{name}: {value!r} is none of {', '.join(choices[name])}")
        elif isinstance(default, bool):
            out[k] = value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
        elif isinstance(default, (tuple, list)):
            out[k] = tuple(value) if isinstance(value, (tuple, list)) else (value,)
        else:
            out[k] = type(default)(value) if default is not None else value
    return out


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    pairs = G.parse_pairs(Path(path).read_text(encoding="utf-8"))
    return spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(pairs, 1)], "source string, target string, rank int")


def read_allowlist(path: str) -> list[str]:
    """Entries of a list file in lower case, without comments and blanks."""
    lines = (x.split("#", 1)[0].strip().lower() for x in Path(path).read_text(encoding="utf-8").splitlines())
    return sorted({x for x in lines if x})


#: Names that the two rates go by.
RATE_NAMES = (("input_per_million", "input", "prompt"), ("output_per_million", "output", "completion"))


def read_prices(spark: SparkSession, path: str, currency: str | None = None) -> DataFrame:
    """Prices of a JSON or YAML file ``provider -> model -> rates``, also below ``pricing`` or ``models``; keys in lower case, incomplete models left out. The currency is the given one, else the file's, else USD."""
    data = load_yaml(Path(path).read_text(encoding="utf-8"))
    money = (currency or data.pop("currency", None) or "USD").strip().upper()
    data = next((data[k] for k in ("pricing", "models") if isinstance(data.get(k), dict)), data)
    rows = []
    for provider, models in data.items():
        for model, rates in (models.items() if isinstance(models, dict) else ()):
            got = [next((rates[n] for n in names if n in rates), None) for names in RATE_NAMES] if isinstance(rates, dict) else [None]
            if all(isinstance(x, (int, float)) for x in got):
                rows.append((provider.strip().lower(), model.strip().lower(), *map(float, got), money))
    return spark.createDataFrame(rows, "provider string, model string, input_per_million double, output_per_million double, currency string")


def parse_pages(spec: str) -> list[int]:
    """``5,12,45-50`` as sorted distinct numbers; an error for reversed ranges and numbers below 1."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, _, b = part.partition("-")
        lo, hi = int(a), int(b or a)
        if lo < 1 or hi < lo:
            raise ValueError(f"bad page range {part!r}")
        out.update(range(lo, hi + 1))
    return sorted(out)


def read_mapping(path: str) -> dict[int, list[int]]:
    """A page mapping with or without its envelope; values are numbers or lists, without those below 1, sorted and distinct."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    data = data.get("mapping", data)
    return {int(k): sorted({int(x) for x in (v if isinstance(v, list) else [v]) if int(x) > 0}) for k, v in data.items() if str(k).lstrip("-").isdigit()}


def write_mapping(path: str, mapping: dict[int, list[int]], mode: str) -> None:
    Path(path).write_text(json.dumps({"mode": mode, "mapping": {str(k): mapping[k] for k in sorted(mapping)}}, ensure_ascii=False, indent=1), encoding="utf-8")


def write_issues(issues: DataFrame, segments: DataFrame, path: str) -> None:
    """One JSON record per segment and issue, with both texts."""
    s = segments.select(F.col("segment_id").alias("key"), "location", "source_plain", "target_tagged")
    issues.join(s, "key").write.mode("overwrite").json(path)


def write_history(rows: DataFrame, errors: DataFrame, path: str, batch: str) -> None:
    """Adds the translated rows that have no error as the part ``batch``; a batch written again takes the place of itself, so a retry adds nothing twice."""
    bad = errors.where("severity = 'error'").select(F.col("key").alias("segment_id")).distinct()
    rows.where(F.length("target_tagged") > 0).join(bad, "segment_id", "left_anti").write.mode("overwrite").json(f"{path}/batch={batch}")


def report_json(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """One JSON text of a one-row summary and the rows of a report. Rows are those of a rollup, one a document."""
    body = rows.agg(F.sort_array(F.collect_list(F.struct(*sorted(rows.columns)))).alias("rows"))
    return summary.select(F.struct("*").alias("summary")).crossJoin(body).select(F.to_json(F.struct("summary", "rows")).alias("report"))


#: The sections of a format report and the codes in them.
FORMAT_SECTIONS = {
    "shrunk": ("global_font_shrink_applied", "layout_auto_fix_applied"),
    "overflow": ("layout_table_overflow_risk", "layout_textbox_overflow_risk", "layout_frame_overflow_risk", "length_ratio_high"),
}


def of_codes(issues: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    return issues.where(F.col("code").isin(*codes))


def format_rows(issues: DataFrame) -> DataFrame:
    """Issues with the ``section`` of the format report they belong to; others are left out, one of two sections comes twice."""
    out = [of_codes(issues, codes).withColumn("section", F.lit(name)) for name, codes in FORMAT_SECTIONS.items()]
    return out[0].unionByName(out[1])


def write_html(issues: DataFrame, path: str, title: str = "Issues", columns: tuple[str, ...] = ("section", "code", "severity", "location", "details", "source_plain", "target_tagged")) -> None:
    """A page with a table of issues, written row by row in the order of the rows; texts are escaped, missing columns left out."""
    names = [c for c in columns if c in issues.columns]
    cell = lambda tag, x: f"<{tag}>{html.escape(str('' if x is None else x))}</{tag}>"
    with Path(path).open("w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{''.join(cell('th', c) for c in names)}</tr>\n")
        n = 0
        for r in issues.select(*names).toLocalIterator():
            f.write(f"<tr>{''.join(cell('td', r[c]) for c in names)}</tr>\n")
            n += 1
        f.write("</table>" if n else "</table><p>None</p>")


def status_record(phase: Column, done: Column, total: Column, elapsed: Column) -> Column:
    """A run's status as one struct: phase, counts, percent and seconds left."""
    share = F.when(total > 0, F.round(100.0 * done / total, 2)).otherwise(0.0)
    return F.struct(phase.alias("phase"), done.alias("done"), total.alias("total"), share.alias("percent"), usage.eta(done, total, elapsed).alias("eta_seconds"))
