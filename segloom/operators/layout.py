"""Page geometry: columns, tables, margins, block merging, and the risk that translations overflow their containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = ["doc_id", "page_number"]


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """One row per block key; exact copies fall together, other copies to the smallest geometry and text, then to the smallest known column."""
    cols = ["x0", "y0", "x1", "y1", "text"]
    one = blocks.groupBy(*PAGE, "block_id").agg(F.min(F.struct(*cols, F.col("column_index").isNull().alias("unknown"), "column_index")).alias("b"))
    return one.select(*PAGE, "block_id", *(F.col(f"b.{c}").alias(c) for c in (*cols, "column_index"))).where(F.length(T.strip("text")) > 0)


def distinct_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy(*PAGE).agg(F.max("width_pt").alias("width_pt"), F.max("height_pt").alias("height_pt"))


def margin_blocks(blocks: DataFrame, pages: DataFrame, share: float = 0.18, least_pages: int = 3, least_chars: int = 8) -> DataFrame:
    """``doc_id, page_number, block_id, kind, norm, pages``: the blocks in the top or bottom share of the page whose normalised text stands there on at least so many pages."""
    b = blocks.join(pages, PAGE)
    kind = F.when(F.col("y1") <= F.col("height_pt") * share, "header").when(F.col("y0") >= F.col("height_pt") * (1 - share), "footer")
    b = b.select(*PAGE, "block_id", kind.alias("kind"), T.margin_normal("text").alias("norm")).where(F.col("kind").isNotNull() & (F.length("norm") >= least_chars))
    often = b.groupBy("doc_id", "kind", "norm").agg(F.count_distinct("page_number").alias("pages")).where(F.col("pages") >= least_pages)
    return b.join(often, ["doc_id", "kind", "norm"])


def repeated_margins(blocks: DataFrame, pages: DataFrame, share: float = 0.18, least_pages: int = 3, least_chars: int = 8) -> DataFrame:
    """``doc_id, kind, norm, pages`` of the repeated texts of margin_blocks."""
    return margin_blocks(blocks, pages, share, least_pages, least_chars).select("doc_id", "kind", "norm", "pages").distinct()


def classified(blocks: DataFrame, pages: DataFrame, margins: DataFrame | None = None, tables: DataFrame | None = None, edge: float = 0.10) -> DataFrame:
    """Blocks with ``block_type`` and ``region_id``: a block of a repeated margin, else a cell of a table region, else the top or bottom edge of the page, else body.

    ``margins`` comes from margin_blocks, ``tables`` from table_regions; of several regions a block touches the first counts.
    """
    m = (margins if margins is not None else margin_blocks(blocks, pages)).select(*PAGE, "block_id", F.col("kind").alias("repeated"))
    b = blocks.join(pages, PAGE).join(m, [*PAGE, "block_id"], "left")
    if tables is None:
        b = b.withColumn("region_id", F.lit(None).cast("int"))
    else:
        r = tables.select(*PAGE, "region_id", *(F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")))
        own = blocks.select(*PAGE, "block_id", *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1"))).join(r, PAGE).where(intersects("b_", "r_"))
        b = b.join(own.groupBy(*PAGE, "block_id").agg(F.min("region_id").alias("region_id")), [*PAGE, "block_id"], "left")
    at = F.when(F.col("y1") <= F.col("height_pt") * max(0.0, edge), "header").when(F.col("y0") >= F.col("height_pt") * (1 - max(0.0, edge)), "footer").otherwise("body")
    b = b.withColumn("block_type", F.coalesce("repeated", F.when(F.col("region_id").isNotNull(), "table_cell"), at))
    return b.withColumn("region_id", F.when(F.col("block_type") == "table_cell", F.col("region_id"))).drop("repeated")


def column_regions(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, columns, x0, x1, right_x0, right_x1``: the extent of the one column of a page, or of both.

    Two where enough candidates stand on either side of the middle, apart and alike in width. Candidates have two letters, lie
    between 8 and 92 percent of the height and are wide or long enough; a page with fewer than four of them takes
    all blocks with a letter that are less wide or long.
    """
    b = blocks.join(pages, PAGE)
    w = F.col("width_pt")
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    width, chars = F.col("x1") - F.col("x0"), F.length(T.flat("text"))
    inside = (F.col("y0") >= F.col("height_pt") * 0.08) & (F.col("y1") <= F.col("height_pt") * 0.92)
    strict = (letters >= 2) & inside & ((width >= w * 0.16) | (chars >= 18))
    loose = (letters >= 1) & ((width >= w * 0.12) | (chars >= 8))
    b = b.withColumn("strict", strict).withColumn("loose", loose).withColumn("left", (F.col("x0") + F.col("x1")) / 2 <= w / 2)
    enough = F.col("n_strict") >= 4
    g = b.groupBy(*PAGE).agg(
        F.max("width_pt").alias("w"), F.count_if("strict").alias("n_strict"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        *(_side(f, left, name) for f in ("strict", "loose") for left, name in ((True, "l"), (False, "r"))),
    )
    g = g.select(*PAGE, "w", "x0", "x1", *(F.when(enough, F.col(f"strict_{n}")).otherwise(F.col(f"loose_{n}")).alias(n) for n in "lr"))
    n, few = F.col("l.n") + F.col("r.n"), F.least("l.n", "r.n")
    wl, wr = F.col("l.w"), F.col("r.w")
    two = (
        (n >= 4) & (few >= 2) & (few / n >= 0.2) & (F.col("r.x") - F.col("l.x") >= F.col("w") * 0.24) & (F.least(wl, wr) >= F.col("w") * 0.18)
        & (F.greatest(wl, wr) / F.greatest(F.lit(1.0), F.least(wl, wr)) <= 2.4) & (F.col("r.x0") - F.col("l.x1") >= F.col("w") * 0.03)
    )
    g = g.withColumn("two", F.coalesce(two, F.lit(False)))
    pick = lambda a, b: F.when(F.col("two"), a).otherwise(b)
    return g.select(*PAGE, pick(F.lit(2), F.lit(1)).alias("columns"), pick(F.col("l.x0"), F.col("x0")).alias("x0"), pick(F.col("l.x1"), F.col("x1")).alias("x1"), F.when(F.col("two"), F.col("r.x0")).alias("right_x0"), F.when(F.col("two"), F.col("r.x1")).alias("right_x1"))


def _side(flag: str, left: bool, name: str) -> Column:
    """Number, median left edge and width, and extent of the candidates on one side of the middle."""
    here = F.col(flag) & (F.col("left") == left)
    of = lambda c: F.when(here, c)
    return F.struct(
        F.count_if(here).alias("n"), F.median(of(F.col("x0"))).alias("x"), F.median(of(F.col("x1") - F.col("x0"))).alias("w"), F.min(of(F.col("x0"))).alias("x0"), F.max(of(F.col("x1"))).alias("x1"),
    ).alias(f"{flag}_{name}")


def two_columns(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, columns, split_x``: the number of columns of column_regions and the middle between two."""
    g = column_regions(blocks, pages)
    return g.select(*PAGE, "columns", F.round((F.col("x1") + F.col("right_x0")) / 2, 3).alias("split_x"))


def with_columns(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with ``column_index``, the column of the nearest centre; the left one on ties."""
    g = column_regions(blocks, pages).select(*PAGE, ((F.col("x0") + F.col("x1")) / 2).alias("_a"), ((F.col("right_x0") + F.col("right_x1")) / 2).alias("_b"))
    c = (F.col("x0") + F.col("x1")) / 2
    right = F.coalesce(F.abs(c - F.col("_b")) < F.abs(c - F.col("_a")), F.lit(False))
    return blocks.drop("column_index").join(g, PAGE, "left").withColumn("column_index", right.cast("int")).drop("_a", "_b")


def nearest_column(blocks: DataFrame, columns: DataFrame) -> DataFrame:
    """Blocks with the column of the nearest centre, the first on ties; ``columns`` has ``doc_id, page_number, column_no, x0, x1``."""
    c = columns.select(*PAGE, "column_no", ((F.col("x0") + F.col("x1")) / 2).alias("_cx"))
    d = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("_cx"))
    best = blocks.join(c, PAGE).groupBy(*PAGE, "block_id").agg(F.min_by("column_no", F.struct(d, F.col("column_no"))).alias("column_no"))
    return blocks.join(best, [*PAGE, "block_id"], "left")


def intersects(a: str, b: str) -> Column:
    """Strict intersection of two boxes given by column prefixes; touching edges don't count."""
    f = lambda p, c: F.col(f"{p}{c}")
    return (f(a, "x0") < f(b, "x1")) & (f(b, "x0") < f(a, "x1")) & (f(a, "y0") < f(b, "y1")) & (f(b, "y0") < f(a, "y1"))


def overlapping(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks of a page whose boxes intersect, smaller id first. A page bounds the join."""
    a = blocks.select(*PAGE, F.col("block_id").alias("a_id"), *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    b = blocks.select(*PAGE, F.col("block_id").alias("b_id"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    return a.join(b, PAGE).where((F.col("a_id") < F.col("b_id")) & intersects("a_", "b_")).select(*PAGE, "a_id", "b_id")


def merged_blocks(blocks: DataFrame, threshold: float = 12.0) -> DataFrame:
    """Segments of blocks merged with the one before on the page: same type and column, left edges and the gap within limits.

    Gaps and islands: the condition looks at the previous block only, so a running count of breaks numbers the segments.
    """
    order = Window.partitionBy(*PAGE).orderBy("column_index", "y0", "x0", "block_id")
    prev = lambda c: F.lag(c).over(order)
    gap = F.col("y0") - prev("y1")
    same = (F.col("block_type") == prev("block_type")) & (F.col("column_index") == prev("column_index")) & (F.abs(F.col("x0") - prev("x0")) <= max(10.0, 2 * threshold)) & (gap <= max(4.0, 1.5 * threshold))
    b = blocks.withColumn("column_index", F.coalesce("column_index", F.lit(0))).withColumn("_break", (~F.coalesce(same, F.lit(False))).cast("int"))
    b = b.withColumn("island", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = b.groupBy(*PAGE, "island").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("block_type").alias("block_type"), F.count("*").alias("blocks"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "block_id", "text"))), lambda x: x["text"]), "\n").alias("text"),
    )
    place = Window.partitionBy(*PAGE).orderBy("y0", "x0", "island")
    return g.withColumn("segment_no", F.row_number().over(place) - 1).withColumn("segment_id", F.concat(F.lit("pdf-p"), "page_number", F.lit("-s"), "segment_no")).drop("island")


def cluster_count(values: Column, tolerance: Column | float) -> Column:
    """Number of one-dimensional clusters of sorted values with an anchor that moves halfway to each value it takes in."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("anchor"))
    step = lambda acc, v: F.when(acc["anchor"].isNotNull() & (F.abs(v - acc["anchor"]) <= tolerance), F.struct(acc["n"].alias("n"), ((acc["anchor"] + v) / 2).alias("anchor"))).otherwise(F.struct((acc["n"] + 1).alias("n"), v.alias("anchor")))
    return F.aggregate(F.array_sort(values), zero, step, lambda acc: acc["n"])


def table_regions(blocks: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, region_id, x0, y0, x1, y1``: drawings that frame a table, merged where they nearly overlap.

    Big enough but no whole page, not too long, with at least three blocks whose centres form two rows and two columns and
    that fill it. ``regions`` has ``doc_id, page_number, drawing_id, x0, y0, x1, y1``.
    """
    r = regions.select(*PAGE, "drawing_id", *(F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1"))).join(pages, PAGE)
    w, h = F.col("r_x1") - F.col("r_x0"), F.col("r_y1") - F.col("r_y0")
    page = F.greatest(F.lit(1.0), F.col("width_pt") * F.col("height_pt"))
    fit = (w >= 40) & (h >= 20) & (w * h / page <= 0.68) & (F.greatest(w, h) / F.greatest(F.lit(1.0), F.least(w, h)) <= 35)
    b = blocks.select(*PAGE, "block_id", *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    area = F.greatest(F.lit(0.0), F.col("b_x1") - F.col("b_x0")) * F.greatest(F.lit(0.0), F.col("b_y1") - F.col("b_y0"))
    g = r.where(fit).join(b, PAGE).where(intersects("r_", "b_")).groupBy(*PAGE, "drawing_id", "r_x0", "r_y0", "r_x1", "r_y1").agg(
        F.count("*").alias("blocks"), F.collect_list((F.col("b_x0") + F.col("b_x1")) / 2).alias("xs"), F.collect_list((F.col("b_y0") + F.col("b_y1")) / 2).alias("ys"), F.sum(area).alias("text_area"),
    )
    several = (cluster_count(F.col("xs"), F.greatest(F.lit(14.0), w * 0.04)) >= 2) & (cluster_count(F.col("ys"), F.greatest(F.lit(10.0), h * 0.03)) >= 2)
    ok = g.where((F.col("blocks") >= 3) & several & (F.col("text_area") / F.greatest(F.lit(1.0), w * h) >= 0.035))
    box = F.struct((-(w * h)).alias("minus"), "drawing_id", *(F.col(f"r_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))
    one = ok.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(box)), lambda x: F.struct(*(x[c].alias(c) for c in ("x0", "y0", "x1", "y1")))).alias("boxes"))
    return one.select(*PAGE, F.posexplode(merged_regions(F.col("boxes"))).alias("region_id", "box")).select(*PAGE, "region_id", "box.*")


def merged_regions(boxes: Column, share: float = 0.18) -> Column:
    """Boxes, largest first, each united with the first one before that it intersects if the smaller area is at least so much of their union's."""
    size = lambda b: F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])
    union = lambda a, b: F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))
    meets = lambda a, b: (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"]) & (size(union(a, b)) > 0) & (F.least(size(a), size(b)) / size(union(a, b)) >= share)

    def step(acc, b):
        at = F.array_position(F.transform(acc, lambda a: meets(a, b)), F.lit(True))
        return F.when(at == 0, F.concat(acc, F.array(b))).otherwise(F.transform(acc, lambda a, i: F.when(i + 1 == at, union(a, b)).otherwise(a)))

    return F.aggregate(boxes, F.slice(boxes, 1, 0), step)


#: Width factors of fonts, the first whose name is held; unknown fonts have none.
FONT_FACTORS = (("arial", 0.52), ("calibri", 0.50), ("timesnewroman", 0.50), ("cambria", 0.52), ("segoeui", 0.51), ("notosans", 0.50), ("notoserif", 0.52), ("couriernew", 0.60))
#: Width and height of a character in twips where no size is known.
CHAR_WIDTH, CHAR_HEIGHT = 120, 220


def font_factor(font: Column) -> Column:
    """Width factor of a font by its name; 0 for an unknown one."""
    n = F.regexp_replace(F.lower(font), "[^a-z0-9]+", "")
    out = F.lit(None).cast("double")
    for name, factor in reversed(FONT_FACTORS):
        out = F.when(n.contains(name), factor).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def char_metrics(segments: DataFrame) -> DataFrame:
    """``segment_id, char_w, char_h``: width and height of a character in twips, averaged over the spans by their lengths, truncated; rows without spans are left out.

    A span without a size counts as the fixed values, one of an unknown font as the fixed width.
    """
    e = segments.select("segment_id", F.explode("spans").alias("s"))
    size = F.col("s.style.font_size_pt")
    factor = font_factor(F.col("s.style.font_name"))
    wide = F.when(size.isNull() | (factor <= 0), F.lit(float(CHAR_WIDTH))).otherwise(F.greatest(F.lit(40.0), size * 20 * factor))
    high = F.when(size.isNull(), F.lit(float(CHAR_HEIGHT))).otherwise(F.greatest(F.lit(100.0), size * 20 * 1.2))
    n = F.greatest(F.lit(1), F.length(F.coalesce(F.col("s.source_text"), F.lit(""))))
    mean = lambda v: (F.sum(v * n) / F.sum(n)).cast("int")
    return e.groupBy("segment_id").agg(mean(wide).alias("char_w"), mean(high).alias("char_h"))


def with_capacity(segments: DataFrame) -> DataFrame:
    """Segments with ``char_w, char_h`` and the capacities of their containers in characters: ``table_cap`` by width, ``box_cap`` (of a text box by area, by width where no height is known) and ``frame_cap`` by area, at least 1, null where unknown.

    ``capacity`` is the one that counts: a table's before a text box's before a frame's.
    """
    m = char_metrics(segments)
    j = segments.join(m, "segment_id", "left").withColumn("char_w", F.coalesce("char_w", F.lit(CHAR_WIDTH))).withColumn("char_h", F.coalesce("char_h", F.lit(CHAR_HEIGHT)))
    real = lambda c: F.when(F.col(c) > 0, F.col(c))
    w, h = real("width_twips"), real("height_twips")
    by_width = F.greatest(F.lit(1), (w / F.greatest(F.lit(1), "char_w")).cast("int"))
    by_area = F.greatest(F.lit(1), (w.cast("double") * h / F.greatest(F.lit(1), F.col("char_w") * F.col("char_h"))).cast("int"))
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    j = j.withColumn("table_cap", F.when(is_("in_table") & w.isNotNull(), by_width)).withColumn("box_cap", F.when(is_("in_textbox") & w.isNotNull(), F.when(h.isNotNull(), by_area).otherwise(by_width)))
    return j.withColumn("frame_cap", F.when(is_("in_frame") & w.isNotNull() & h.isNotNull(), by_area)).withColumn("capacity", F.coalesce("table_cap", "box_cap", "frame_cap"))


def _lengths(source: str, target: str) -> tuple[Column, Column]:
    return F.length(T.flat(T.strip_markers(F.coalesce(source, F.lit(""))))), F.length(T.flat(T.strip_markers(F.coalesce(target, F.lit("")))))


def overflow_issues(segments: DataFrame, ratio: float = 1.5) -> DataFrame:
    """``segment_id, code, target_chars, capacity``: long translations, and those that risk to overflow a cell, a text box or a frame."""
    j = with_capacity(segments)
    ls, lt = _lengths("source_plain", "target_tagged")
    j = j.withColumn("ls", ls).withColumn("lt", lt)
    ls, lt = F.col("ls"), F.col("lt")
    over = lambda cap, share: lt > (F.col(cap) * F.lit(share)).cast("int")
    rule = lambda cond, code, cap: F.when(cond, F.struct(F.lit(code).alias("code"), cap.cast("int").alias("capacity")))
    found = F.array(
        rule((ls > 0) & (lt > 0) & (lt / ls > max(1.05, ratio)), "length_ratio_high", F.lit(None)),
        rule((lt > 0) & over("table_cap", 1.15), "layout_table_overflow_risk", F.col("table_cap")),
        rule(F.coalesce(F.col("in_textbox"), F.lit(False)) & (ls > 0) & (lt > 0) & F.when(F.col("box_cap").isNotNull(), over("box_cap", 1.1)).otherwise((lt / ls > 1.6) & (lt - ls >= 20)), "layout_textbox_overflow_risk", F.col("box_cap")),
        rule((lt > 0) & over("frame_cap", 1.15), "layout_frame_overflow_risk", F.col("frame_cap")),
    )
    return j.select("segment_id", "lt", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("segment_id", "i.code", F.col("lt").alias("target_chars"), "i.capacity")


def constrained(segments: DataFrame, ratio: float = 1.5) -> DataFrame:
    """``segment_id, max_target_chars`` of contained segments whose translation will be near its container's capacity: at least 8."""
    expected = min(1.35, max(1.1, ratio))
    j = with_capacity(segments)
    n = _lengths("source_plain", "target_tagged")[0]
    near = (n > 0) & (F.greatest(n, (n * F.lit(expected)).cast("int")) >= (F.col("capacity") * F.lit(0.9)).cast("int"))
    return j.where(near).select("segment_id", F.greatest(F.lit(8), "capacity").alias("max_target_chars"))


def overflow_ratio(target_chars: Column, capacity: Column) -> Column:
    """How many times the capacity a text takes, at least 1; 1 where either is unknown or not above 0."""
    return F.when((target_chars > 0) & (capacity > 0), F.greatest(F.lit(1.0), target_chars / capacity)).otherwise(1.0)


#: Issues that a fix can act on.
FIXABLE = ("length_ratio_high", "layout_table_overflow_risk", "layout_textbox_overflow_risk", "layout_frame_overflow_risk")


def fixes(issues: DataFrame, segments: DataFrame) -> DataFrame:
    """``segment_id, code, strategy, overflow``: of each segment the first issue (by ``pos``) that a fix acts on, and the fix.

    ``issues`` has ``segment_id, pos, code, target_chars, capacity``. A long text outside of containers is left alone.
    """
    at = segments.select("segment_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_table", "in_textbox", "in_frame"))).dropDuplicates(["segment_id"])
    is_ = lambda code, flag: (F.col("code") == code) | (F.col("code") == FIXABLE[0]) & F.col(flag)
    strategy = F.when(is_(FIXABLE[1], "in_table"), "table").when(is_(FIXABLE[2], "in_textbox"), "textbox").when(is_(FIXABLE[3], "in_frame"), "frame")
    j = issues.where(F.col("code").isin(*FIXABLE)).join(at, "segment_id").withColumn("strategy", strategy).where(F.col("strategy").isNotNull())
    first = j.groupBy("segment_id").agg(F.min_by(F.struct("code", "strategy", "target_chars", "capacity"), F.struct("pos", "code")).alias("x"))
    return first.select("segment_id", "x.code", "x.strategy", overflow_ratio(F.col("x.target_chars"), F.col("x.capacity")).alias("overflow"))


def average_font_pt(segments: DataFrame) -> DataFrame:
    """``segment_id, font_pt``: mean size of the spans with text and a known size; segments without one are left out."""
    e = segments.select("segment_id", F.explode("spans").alias("s")).where((F.length(T.strip("s.source_text")) > 0) & F.col("s.style.font_size_pt").isNotNull())
    return e.groupBy("segment_id").agg(F.avg("s.style.font_size_pt").alias("font_pt"))


def reduction(overflow: Column, font_pt: Column, most: float = 3.0) -> Column:
    """Points to take off a font: none without overflow, else what makes up for it, from 0.2 to ``most``."""
    return F.when(overflow <= 1, 0.0).otherwise(F.least(F.lit(most), F.greatest(F.lit(0.2), font_pt * (1 - 1 / overflow))))


#: Parts of font names by family, in order; any other font is sans.
FAMILIES = (("mono", ("mono", "courier", "consolas", "menlo", "dejavusansmono")), ("serif", ("serif", "times", "cambria", "garamond", "georgia")), ("sans", ("sans", "arial", "helvetica", "noto", "ptsans", "ubuntu")))
#: What stands in for a family, by name and file.
REPLACEMENTS = {"sans": ("Noto Sans", "NotoSans-Regular.ttf"), "serif": ("Noto Serif", "NotoSerif-Regular.ttf"), "mono": ("Noto Sans Mono", "NotoSansMono-Regular.ttf")}


def font_key(font: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(T.col(font), F.lit("")))), "[^a-z0-9]+", "")


def font_family(font: Column | str) -> Column:
    """``mono``, ``serif`` or ``sans`` by the letters of the name."""
    k, out = font_key(font), F.lit("sans")
    for name, hints in reversed(FAMILIES):
        held = F.lit(False)
        for h in hints:
            held = held | k.contains(h)
        out = F.when(held, name).otherwise(out)
    return out


def font_file(base: Column, bold: Column, italic: Column) -> Column:
    """The file of a font's variant; a regular one is the base file itself."""
    stem, rest = F.substring_index(base, ".", 1), F.when(base.contains("."), F.regexp_extract(base, r"^[^.]*(\..*)$", 1)).otherwise("")
    plain = F.regexp_replace(stem, r"(?i)-(?:regular|roman)$", "")
    b, i = F.coalesce(bold, F.lit(False)), F.coalesce(italic, F.lit(False))
    suffix = F.when(b & i, "-BoldItalic").when(b, "-Bold").when(i, "-Italic")
    return F.when(suffix.isNull() | (base == ""), base).otherwise(F.concat(plain, suffix, rest))


def replacement_fonts(fonts: DataFrame, mapping: DataFrame) -> DataFrame:
    """``font, bold, italic`` with ``family`` and ``file``: mapped by the equal name, else by the first name it holds (by ``pos``), else by its family.

    ``mapping`` has ``pos, source, target``, a few names of one configuration.
    """
    m = mapping.select("pos", font_key("source").alias("_k"), "target").where("_k != ''")
    f = fonts.select("font", "bold", "italic").distinct().withColumn("_f", font_key("font"))
    hit = f.join(m, F.contains("_f", "_k")).groupBy("font", "bold", "italic").agg(F.min(F.struct((F.col("_f") != F.col("_k")).alias("part"), "pos", "target")).alias("m"))
    hit = hit.select(F.col("font").alias("_1"), F.col("bold").alias("_2"), F.col("italic").alias("_3"), F.col("m.target").alias("mapped"))
    j = f.join(hit, F.col("font").eqNullSafe(F.col("_1")) & F.col("bold").eqNullSafe(F.col("_2")) & F.col("italic").eqNullSafe(F.col("_3")), "left")
    pick = lambda i: F.when(font_family("font") == "serif", REPLACEMENTS["serif"][i]).when(font_family("font") == "mono", REPLACEMENTS["mono"][i]).otherwise(REPLACEMENTS["sans"][i])
    family = F.when(F.col("mapped").isNotNull(), F.regexp_replace("mapped", r"\.[^.]*$", "")).otherwise(pick(0))
    return j.select("font", "bold", "italic", family.alias("family"), font_file(F.coalesce("mapped", pick(1)), F.col("bold"), F.col("italic")).alias("file"))


def span_style(font: Column, flags: Column, color: Column, dx: Column, dy: Column) -> Column:
    """``bold, italic, red, green, blue, rotation`` of a span: by its font's name or flag bits, its colour number and the direction of its line; an unusable colour is null."""
    name, bits = F.lower(F.coalesce(font, F.lit(""))), F.coalesce(flags, F.lit(0))
    c = F.when(color.try_cast("bigint") >= 0, color.try_cast("bigint"))
    part = lambda k: F.shiftright(c, k).bitwiseAND(F.lit(255)).cast("int")
    return F.struct(
        (name.contains("bold") | name.contains("black") | (bits.bitwiseAND(F.lit(16)) != 0)).alias("bold"), (name.contains("italic") | name.contains("oblique") | (bits.bitwiseAND(F.lit(2)) != 0)).alias("italic"),
        part(16).alias("red"), part(8).alias("green"), part(0).alias("blue"), F.degrees(F.atan2(F.coalesce(dy, F.lit(0.0)), F.coalesce(dx, F.lit(0.0)))).alias("rotation"),
    )
