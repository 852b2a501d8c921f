"""How well documents cover their material: gaps, holes, and a plan for filling them.

steps: (video_id, section_idx, step_idx, timestamp_sec, ...); lines: (video_id, line_sec, ...), one for each second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import points_inside
from .material import material_bounds

GAP_LIMIT = 60
MAX_FILLS = 5


def off_grid(steps: DataFrame, lines: DataFrame) -> DataFrame:
    """Steps whose whole second has no line."""
    return steps.withColumn("line_sec", F.col("timestamp_sec").cast("bigint")).join(lines.select("video_id", "line_sec"), ["video_id", "line_sec"], "left_anti")


def unwritten(steps: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines that no step points to."""
    written = steps.select("video_id", F.col("timestamp_sec").cast("bigint").alias("line_sec"))
    return lines.join(written, ["video_id", "line_sec"], "left_anti")


def step_gaps(steps: DataFrame, lines: DataFrame) -> DataFrame:
    """(video_id, a, b): the stretches between neighbouring steps, and from the first line to the last, for videos with both."""
    bounds = material_bounds(lines).select("video_id", "first_sec", "last_sec")
    stamps = steps.select("video_id", F.col("timestamp_sec").cast("double").alias("t"), F.lit(1).alias("k")).join(bounds.select("video_id"), "video_id", "left_semi")
    ends = bounds.join(steps.select("video_id"), "video_id", "left_semi")
    # the first line stands before all steps and the last after them, wherever the steps lie
    edges = stamps.unionByName(ends.select("video_id", F.col("first_sec").cast("double").alias("t"), F.lit(0).alias("k"))).unionByName(ends.select("video_id", F.col("last_sec").cast("double").alias("t"), F.lit(2).alias("k")))
    w = Window.partitionBy("video_id").orderBy("k", "t")
    return edges.select("video_id", F.col("t").alias("a"), F.lead("t").over(w).alias("b")).where("b > a")


def backwards(steps: DataFrame) -> DataFrame:
    """(video_id, backwards): how often the time goes back from a step to the next in document order."""
    w = Window.partitionBy("video_id").orderBy("section_idx", "step_idx")
    back = steps.select("video_id", (F.col("timestamp_sec") < F.lag("timestamp_sec").over(w)).alias("back"))
    return back.groupBy("video_id").agg(F.count_if("back").alias("backwards"))


def lines_in_gaps(lines: DataFrame, gaps: DataFrame, closed: bool = False, width: int = GAP_LIMIT) -> DataFrame:
    """Lines inside any of their video's gaps (video_id, a, b), with the ends if closed; each line once, however long the gaps are."""
    found = points_inside(lines, gaps, "line_sec", closed=closed, width=width).select("video_id", "line_sec").distinct()
    return lines.join(found, ["video_id", "line_sec"], "left_semi")


def document_holes(steps: DataFrame, lines: DataFrame, limit: float = GAP_LIMIT) -> DataFrame:
    """(video_id, hole_start, hole_end) in whole seconds: gaps above the limit between the steps inside the material and its ends, with
    a line in them, ends included, that no step points to."""
    bounds = material_bounds(lines).select("video_id", "first_sec", "last_sec")
    inside = steps.join(bounds, "video_id").where(F.col("timestamp_sec").between(F.col("first_sec"), F.col("last_sec"))).select(*steps.columns)
    gaps = step_gaps(inside, lines).where(F.col("b") - F.col("a") > limit).select("video_id", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    open_lines = unwritten(steps, lines).select("video_id", "line_sec")
    has = points_inside(open_lines, gaps, "line_sec", width=GAP_LIMIT)
    return has.select("video_id", F.col("a").alias("hole_start"), F.col("b").alias("hole_end")).distinct()


def fill_plan(documents: DataFrame, holes: DataFrame, lines: DataFrame, steps: DataFrame, attempted: DataFrame | None = None, most: int = MAX_FILLS) -> DataFrame:
    """(video_id, turn, hole_start, hole_end, n_lines, token_budget): each document's largest holes first, without those attempted before and
    without logs, which aren't filled; documents: (video_id, doc_type)."""
    open_holes = holes.join(documents.where(F.col("doc_type") == "content_log"), "video_id", "left_anti")
    if attempted is not None:
        open_holes = open_holes.join(attempted, ["video_id", "hole_start", "hole_end"], "left_anti")
    w = Window.partitionBy("video_id").orderBy(F.desc(F.col("hole_end") - F.col("hole_start")), "hole_start")
    chosen = open_holes.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most)
    inside = chosen.join(unwritten(steps, lines).select("video_id", "line_sec"), "video_id", "left").where(F.col("line_sec").between(F.col("hole_start"), F.col("hole_end")))
    n = inside.groupBy("video_id", "turn", "hole_start", "hole_end").agg(F.count("*").alias("n_lines"))
    return n.withColumn("token_budget", F.least(F.lit(8000), 400 + 80 * F.col("n_lines")))


def assign_fill_section(holes: DataFrame, steps: DataFrame) -> DataFrame:
    """Adds section_idx to holes (video_id, hole_start, ...): the section of the latest step at or before the hole's start, of
    equals the first in document order; null before the first step.

    An as-of join by one sort: steps and holes in a row, and the last step so far carried along.
    """
    # of steps with one time the last to come would be carried, so they come in reverse
    s = steps.select("video_id", F.col("timestamp_sec").cast("double").alias("_t"), F.lit(0).alias("_k"), (-F.col("section_idx")).alias("_s"), (-F.col("step_idx")).alias("_i"), F.struct(F.col("section_idx").alias("v")).alias("_sec"), F.lit(None).cast(holes.drop("video_id").schema.simpleString()).alias("_h"))
    h = holes.select("video_id", F.col("hole_start").cast("double").alias("_t"), F.lit(1).alias("_k"), F.lit(0).alias("_s"), F.lit(0).alias("_i"), F.lit(None).cast("struct<v:int>").alias("_sec"), F.struct(*[c for c in holes.columns if c != "video_id"]).alias("_h"))
    w = Window.partitionBy("video_id").orderBy("_t", "_k", "_s", "_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = s.unionByName(h).withColumn("_last", F.last("_sec", ignorenulls=True).over(w)).where("_k = 1")
    return rows.select("video_id", "_h.*", F.col("_last.v").alias("section_idx"))


def document_coverage(steps: DataFrame, lines: DataFrame, videos: DataFrame, gap_limit: float = GAP_LIMIT) -> DataFrame:
    """14 figures for each of videos (video_id, duration_sec, uncovered_items): see the columns. Shares of nothing are null."""
    b = material_bounds(lines)
    gaps = step_gaps(steps, lines)
    d, t = F.col("duration_sec"), F.col("timestamp_sec")
    timed = steps.join(videos.select("video_id", "duration_sec"), "video_id")
    of_steps = timed.groupBy("video_id").agg(
        F.count("*").alias("steps"),
        F.max(t).alias("peak"),
        F.count_if((d > 0) & (t > d / 2)).alias("second_half"),
        F.count_if((d > 0) & (t > d * 0.8)).alias("tail_20"),
        F.count_if((d > 0) & (t > d)).alias("over_length"),
    )
    of_gaps = gaps.groupBy("video_id").agg(F.max(F.col("b") - F.col("a")).alias("max_gap"), F.count_if(F.col("b") - F.col("a") > gap_limit).alias("gaps_over_limit"))
    skipped = lines_in_gaps(lines, gaps.where(F.col("b") - F.col("a") > gap_limit)).groupBy("video_id").agg(F.count("*").alias("skipped"))
    off = off_grid(steps, lines).groupBy("video_id").agg(F.count("*").alias("off_grid"))
    rows = videos.select("video_id", "duration_sec", F.coalesce("uncovered_items", F.lit(0)).alias("uncovered_items"))
    for part in (of_steps, b, of_gaps, skipped, off, backwards(steps)):
        rows = rows.join(part, "video_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    peak, end = F.coalesce("peak", F.lit(0.0)), zero("last_sec")
    return rows.select(
        "video_id",
        zero("steps").alias("steps"),
        F.round(peak, 1).alias("max_timestamp_sec"),
        end.cast("double").alias("material_end_sec"),
        F.when(d > 0, F.round(peak / d, 4)).alias("coverage"),
        F.when(end > 0, F.round(peak / end, 4)).alias("material_coverage"),
        *[zero(c).alias(c) for c in ("second_half", "tail_20", "over_length", "off_grid")],
        "uncovered_items",
        F.round(F.coalesce("max_gap", F.lit(0.0)), 1).alias("max_gap_sec"),
        zero("gaps_over_limit").alias("gaps_over_limit"),
        F.when(zero("n_lines") > 0, F.round(zero("skipped") / F.col("n_lines"), 4)).alias("skipped_share"),
        zero("backwards").alias("backwards"),
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy().agg(
        F.count("*").alias("videos"),
        F.count_if(F.col("material_coverage") >= 0.9).alias("well_covered"),
        F.count_if(F.col("gaps_over_limit") == 0).alias("without_gap"),
        F.sum("over_length").alias("over_length"),
        F.sum("off_grid").alias("off_grid"),
        F.sum("steps").alias("steps"),
    )
