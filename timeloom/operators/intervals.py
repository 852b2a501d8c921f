"""Joins of time ranges by a dyadic index.

A range lies in the cells, one or two, of the level at which a cell is as long as the range or up to twice as long; cells of level l are width * 2^l seconds. What looks for it asks, at each level that
occurs, for the cells that it touches itself. So a range of hours makes as few rows as one of seconds, a probe makes as many as there are levels, and one long video
spreads over many tasks.

Where what a range overlaps is wanted together (with_overlapping), each range stays in one home cell, and only the others are copied to the homes that they reach.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A home cell is as long as so many of the longest ranges that are at home in it.
HOME = 16
#: A range that reaches more home cells of a level than this is sent only to those where a range is at home.
MOST_HOMES = 8


def _level(start: Column, end: Column, width: float) -> Column:
    return F.ceil(F.log2(F.greatest((end - start) / width, F.lit(1.0)))).cast("int")


def _cell(at: Column, level: Column, width: float) -> Column:
    return F.floor(at / (F.lit(float(width)) * F.pow(F.lit(2.0), level)))


def _cells(start: Column, end: Column, level: Column, width: float) -> Column:
    first = _cell(start, level, width)
    return F.explode(F.sequence(first, F.greatest(first, _cell(end, level, width))))


def _top(*sides: tuple[DataFrame, Column, Column], width: float) -> int:
    """The highest level of any range, in one job."""
    levels = reduce(DataFrame.unionAll, [df.select(_level(a, b, width).alias("_l")) for df, a, b in sides])
    return levels.agg(F.max("_l")).first()[0] or 0


def overlap_join(left: DataFrame, right: DataFrame, key: str = "video_id", width: float = 12.0) -> DataFrame:
    """Pairs of left and right (start_sec, end_sec each; right's are named r_start and r_end) that overlap within a key, each once: left
    begins before right ends and the other way round. Ranges of length 0 overlap what they are inside of. width: about the length of most ranges."""
    a0, b0 = F.col("start_sec"), F.col("end_sec")
    r0, r1 = F.col("r_start"), F.col("r_end")
    right = right.withColumnsRenamed({"start_sec": "r_start", "end_sec": "r_end"})
    top = _top((left, a0, b0), (right, r0, r1), width=width)
    own_a, own_b, level = _level(a0, b0, width), _level(r0, r1, width), F.col("_l")

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.withColumn("_c", _cells(a0, b0, level, width)), b.withColumn("_c", _cells(r0, r1, level, width))
        first = F.greatest(_cell(a0, level, width), _cell(r0, level, width))  # of the cells that both are in
        return a.join(b, [key, "_l", "_c"]).where((r0 < b0) & (r1 > a0) & (F.col("_c") == first)).drop("_l", "_c")

    upwards = lambda df, least: df.where(least <= top).withColumn("_l", F.explode(F.sequence(least, F.lit(top))))
    longer = joined(upwards(left, own_a), right.withColumn("_l", own_b))
    if not top:
        return longer
    return longer.unionByName(joined(left.withColumn("_l", own_a), upwards(right, own_b + 1)))


def with_overlapping(left: DataFrame, right: DataFrame, key: str = "video_id", width: float = 12.0) -> DataFrame:
    """left's rows, once for each range of right that they overlap (as overlap_join has it, and names right's), or once with nulls. Each row of left goes to
    one cell (key, _level, _home) and stays there, so that what is grouped by these columns and others is not dealt again. width: about the length of most of left's."""
    r0, r1, level = F.col("r_start"), F.col("r_end"), F.col("_level")
    right = right.withColumnsRenamed({"start_sec": "r_start", "end_sec": "r_end"})
    size, length = float(HOME * width), F.pow(F.lit(2.0), level)
    slack = 1.01 * width * length  # no range of the level is longer; a little more, since levels are rounded
    left = left.withColumn("_level", _level(F.col("start_sec"), F.col("end_sec"), width)).withColumn("_home", _cell(F.col("start_sec"), level, size))
    ends = left.select(level.alias("_l"), F.lit(None).cast("double").alias("_n")).unionAll(right.select(F.lit(None).cast("int"), (r1 - r0).cast("double")))
    levels, longest = ends.agg(F.sort_array(F.collect_set("_l")), F.max("_n")).first()
    levels = levels or [0]
    first = _cell(r0 - slack, level, size)
    last = F.greatest(first, _cell(r1, level, size))
    at = right.withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    sent = at.where(last - first < MOST_HOMES).withColumn("_home", F.explode(F.sequence(first, last)))
    least = (MOST_HOMES - 2) * size * 2.0 ** levels[0]
    if longest is not None and longest > least:  # no shorter one reaches so many
        begin, end = F.col("_home") * size * length, (F.col("_home") + 1) * size * length + slack
        homes = left.select(key, "_level", "_home").distinct().select("*", begin.alias("start_sec"), end.alias("end_sec"))
        long = right.where(r1 - r0 > least).withColumnsRenamed({"r_start": "start_sec", "r_end": "end_sec"})
        sent = sent.unionByName(overlap_join(homes, long, key, size).drop("start_sec", "end_sec").where(last - first >= MOST_HOMES))
    sent = sent.withColumnsRenamed({key: "_k", "_level": "_at", "_home": "_in"}).hint("merge")
    same = (F.col(key) == F.col("_k")) & (level == F.col("_at")) & (F.col("_home") == F.col("_in"))
    return left.join(sent, same & (r0 < F.col("end_sec")) & (r1 > F.col("start_sec")), "left").drop("_k", "_at", "_in")


def points_inside(points: DataFrame, ranges: DataFrame, at: str, key: str = "video_id", closed: bool = True, width: float = 60.0) -> DataFrame:
    """(key, at, a, b): the points, of which other columns are not taken, in ranges (key, a, b) of their key, with the ends if closed; a pair may
    come from each of its range's cells only once."""
    a, b, t = F.col("a"), F.col("b"), F.col(at)
    top = _top((ranges, a, b), width=width)
    held = ranges.select(key, "a", "b", _level(a, b, width).alias("_l")).select("*", _cells(a, b, F.col("_l"), width).alias("_c"))
    asked = points.select(key, at, F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_l")).select("*", _cell(t, F.col("_l"), width).alias("_c"))
    inside = (t >= a) & (t <= b) if closed else (t > a) & (t < b)
    return asked.join(held, [key, "_l", "_c"]).where(inside).select(key, at, "a", "b")
