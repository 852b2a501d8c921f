"""Interval joins against all pairs: long, short and empty ranges, negative times, ranges that touch."""

import random

import pytest
from pyspark.sql import functions as F

from timeloom.operators import coverage, timeline
from timeloom.operators.intervals import _cells, _level, overlap_join, points_inside, with_overlapping
from timeloom.sources import adapters
from timeloom.sources.tables import stage


def ranges(r, n, lengths):
    out = []
    for i in range(n):
        a = r.choice([float(r.randint(-40, 400)), r.uniform(0, 400), 12.0 * r.randint(0, 30)])
        out.append((r.choice([1, 1, 1, 2, None]), i, a, a + r.choice(lengths)))
    return out


@pytest.mark.parametrize(("left", "right"), [((0, 1, 11, 12), (0, 3, 12, 13)), ((1, 24, 400, 36_000), (0, 5, 48)), ((0, 2), (36_000,)), ((100_000, 7), (100_000, 12, 0))])
def test_overlap_join(spark, left, right):
    r = random.Random(sum(left))
    x, y = ranges(r, 80, left), ranges(r, 80, right)
    a, b = (stage(spark.createDataFrame(rows, f"video_id int, {n} int, start_sec double, end_sec double")) for rows, n in ((x, "i"), (y, "j")))
    want = sorted((p[1], q[1]) for p in x for q in y if p[0] is not None and p[0] == q[0] and q[2] < p[3] and q[3] > p[2])
    assert sorted((z.i, z.j) for z in overlap_join(a, b).collect()) == want and want
    assert overlap_join(a, b.limit(0)).count() == overlap_join(a.limit(0), b).count() == 0


def test_a_range_makes_few_rows(spark):
    """However long it is; and one utterance over a whole video meets all of its scenes."""
    long = spark.createDataFrame([(float(a), float(a + n)) for a in (0, 5, 1000) for n in (0, 1, 12, 13, 600, 36_000, 360_000, 10**7)], "s double, e double")
    cells = long.select("s", "e", _cells(F.col("s"), F.col("e"), _level(F.col("s"), F.col("e"), 12.0), 12.0).alias("c")).groupBy("s", "e").count()
    assert cells.agg(F.max("count")).first()[0] <= 2
    scenes = spark.range(3000).select(F.lit(1).alias("video_id"), F.col("id").alias("scene_idx"), (F.col("id") * 10.0).alias("start_sec"), (F.col("id") * 10.0 + 10).alias("end_sec"))
    u = spark.createDataFrame([(1, 0.0, 30_000.0, "all", 0.5, 0.5, 1.0), (1, 10.0, 10.0, "none", 0.5, 0.5, 1.0), (1, 15.0, 15.0, "empty", 0.1, 0.1, 2.0)], "video_id int, start_sec double, end_sec double, text string, no_speech_prob double, avg_logprob double, compression_ratio double")
    got = {x.scene_idx: x.transcript for x in timeline.align_transcript(scenes, u).collect()}
    assert len(got) == 3000 and got[1] == "all empty" and {v for k, v in got.items() if k != 1} == {"all"}


@pytest.mark.parametrize("closed", [True, False])
def test_points(spark, closed):
    r = random.Random(7)
    gaps = [(v, a, a + n) for v in (1, 2) for a in (0.0, 59.5, 60.0, 333.0) for n in (0.0, 1.0, 60.0, 7000.0)]
    lines = [(r.choice([1, 2, 3, None]), t, f"l{t}") for t in sorted({r.randint(0, 500) for _ in range(150)} | {60, 120, 393})]
    g = stage(spark.createDataFrame(gaps, "video_id int, a double, b double"))
    li = stage(spark.createDataFrame(lines, "video_id int, line_sec bigint, line string"))
    inside = lambda t, a, b: a <= t <= b if closed else a < t < b
    pairs = sorted((v, t, a, b) for v, t, _ in lines for k, a, b in gaps if k == v and inside(t, a, b))
    assert sorted(map(tuple, points_inside(li, g, "line_sec", closed=closed).collect())) == pairs
    got = coverage.lines_in_gaps(li, g, closed)
    assert got.columns == li.columns and sorted((x.video_id, x.line_sec) for x in got.collect()) == sorted({p[:2] for p in pairs})


@pytest.mark.parametrize("left", [(0, 1, 11, 12), (1, 24, 400, 36_000), (5, -3)])
@pytest.mark.parametrize("right", [(0, 3, 12, 13), (2, 191, 192, 193, 1_300, 2_000), (100_000, 7, -5)])
def test_with_overlapping(spark, left, right):
    r = random.Random(sum(left) + sum(right))
    x, y = ranges(r, 80, left), ranges(r, 80, right)
    a, b = (stage(spark.createDataFrame(rows, f"video_id int, {n} int, start_sec double, end_sec double")) for rows, n in ((x, "i"), (y, "j")))
    pairs = [(p[1], q[1]) for p in x for q in y if p[0] is not None and p[0] == q[0] and q[2] < p[3] and q[3] > p[2]]
    want = sorted(pairs + [(p[1], -1) for p in x if p[1] not in {i for i, _ in pairs}])
    got = with_overlapping(a, b).select("i", F.coalesce("j", F.lit(-1)), "_level", "_home").collect()
    assert sorted(g[:2] for g in got) == want and len({(g.i, g._level, g._home) for g in got}) == len(x)
    assert sorted(g.i for g in with_overlapping(a, b.limit(0)).collect()) == list(range(80)) and with_overlapping(a.limit(0), b).isEmpty()


def test_very_long_ranges_are_sent_to_homes_only(spark):
    """A hundred that would each reach five million cells."""
    scenes = stage(spark.range(10).select(F.lit(1).alias("video_id"), F.col("id").cast("int").alias("scene_idx"), (F.col("id") * 1e8).alias("start_sec"), (F.col("id") * 1e8 + 10).alias("end_sec")))
    long = stage(spark.range(100).select(F.lit(1).alias("video_id"), F.col("id").alias("j"), F.lit(0.0).alias("start_sec"), F.lit(1e9).alias("end_sec")))
    assert with_overlapping(scenes, long).count() == 1000


def test_alignment_deals_each_side_once(spark, capsys):
    """What finds a scene's utterances also groups them: no scene is copied to other levels, and no pair is dealt again."""
    scenes = stage(spark.range(3000).select((F.col("id") % 7).alias("video_id"), F.col("id").alias("scene_idx"), (F.col("id") * 10.0).alias("start_sec"), (F.col("id") * 10.0 + 10).alias("end_sec")))
    u = spark.range(3000).select((F.col("id") % 7).alias("video_id"), (F.col("id") * 10.0).alias("start_sec"), (F.col("id") * 10.0 + 1 + F.col("id") % 300).alias("end_sec"), F.lit("a").alias("text"), F.lit(0.5).alias("no_speech_prob"), F.lit(0.5).alias("avg_logprob"), F.lit(1.0).alias("compression_ratio"))
    found = timeline.align_transcript(scenes, stage(u))
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 2 and "Window" not in plan
    assert found.count() == 3000 and found.columns == [*scenes.columns, "transcript", "no_speech_prob", "avg_logprob", "compression_ratio"]


def test_timeline_deals_events_once(spark, data, capsys):
    capsys.readouterr()
    adapters.timeline(spark, data).explain()
    assert capsys.readouterr().out.count("Exchange") == 1
