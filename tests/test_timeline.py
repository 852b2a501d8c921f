"""Folds and interval joins against plain restatements."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timeloom.operators import coverage, material, quality, timeline
from timeloom.plans.reports import coverage_report
from timeloom.plans.segments import build_segments


def merged(scenes):
    out, start, end = [], None, None
    for a, b in scenes:
        start, end = (a if start is None else start), b
        if end - start >= 8:
            out.append((start, end))
            start = None
    if start is not None:
        out = [*out[:-1], (out[-1][0], end)] if out else [(start, end)]
    return out


def split(scenes):
    out = []
    for a, b in scenes:
        n = 1
        if b - a > 12:
            n = max(1, round((b - a) / 10))
            while n > 1 and (b - a) / n < 8:
                n -= 1
        out += [(a + i * (b - a) / n, a + (i + 1) * (b - a) / n, b - a) for i in range(n)]
    return out


def test_scenes(spark):
    r = random.Random(1)
    videos = {1: [(0, 4), (4, 8), (8, 19)], 2: [(0, 9), (9, 10)], 3: [(0, 40)], 4: [(0, 3)], 5: [(0, 25)], 6: [(0, 15)]}
    for v in range(7, 60):
        at, rows = 0.0, []
        for _ in range(r.randint(1, 25)):
            n = r.choice([r.uniform(0.2, 9), r.uniform(5, 70), 2.5, 5, 12, 15])
            rows.append((at, at + n))
            at += n
        videos[v] = rows
    df = spark.createDataFrame([(v, float(a), float(b)) for v, rows in videos.items() for a, b in rows], "video_id int, start_sec double, end_sec double").repartition(3)
    got = {}
    for x in timeline.merge_short(df).orderBy("video_id", "start_sec").collect():
        got.setdefault(x.video_id, []).append((x.start_sec, x.end_sec))
    assert got == {v: merged(rows) for v, rows in videos.items()}
    pieces = {}
    for x in timeline.normalise_scenes(df).orderBy("video_id", "scene_idx").collect():
        pieces.setdefault(x.video_id, []).append((x.start_sec, x.end_sec, x.source_raw_duration))
    for v, rows in videos.items():
        want = split(merged(rows))
        assert len(want) == len(pieces[v]) and all(abs(p - q) < 1e-9 for x, y in zip(want, pieces[v]) for p, q in zip(x, y)), v


def test_no_cut(spark):
    videos = spark.createDataFrame([(1, 30), (2, 50)], "video_id int, duration_sec int")
    cuts = spark.createDataFrame([(2, 0.0, 50.0)], "video_id int, start_sec double, end_sec double")
    assert sorted(map(tuple, timeline.scene_ranges(cuts, videos).collect())) == [(1, 0.0, 30.0), (2, 0.0, 50.0)]


def test_alignment(spark):
    r = random.Random(2)
    scenes = [(v, i, i * 9.5, (i + 1) * 9.5) for v in (1, 2) for i in range(30)]
    said = []
    for v in (1, 2):
        for k in range(60):
            a = round(r.uniform(0, 280), 1)
            said.append((v, a, a + r.choice([0.5, 4.0, 30.0]), f"u{k}", r.random(), -r.random(), r.random() * 3))
    s = spark.createDataFrame(scenes, "video_id int, scene_idx int, start_sec double, end_sec double")
    u = spark.createDataFrame(said, "video_id int, start_sec double, end_sec double, text string, no_speech_prob double, avg_logprob double, compression_ratio double")
    for x in timeline.align_transcript(s, u).collect():
        hit = sorted(y for y in said if y[0] == x.video_id and y[1] < x.end_sec and y[2] > x.start_sec)
        assert x.transcript == " ".join(y[3] for y in hit)
        if hit:
            assert abs(x.no_speech_prob - sum(y[4] for y in hit) / len(hit)) < 1e-9 and x.compression_ratio == max(y[6] for y in hit)
        else:
            assert x.no_speech_prob is None


def repetitive(texts):
    out, start, word = set(), None, None
    for i, t in enumerate(texts):
        w = re.findall(r"\S+", t.lower())
        best, n = Counter(w).most_common(1)[0] if w else (None, 0)
        if not w or n / len(w) < 0.5:
            start = word = None
            continue
        if best != word:
            start, word = i, best
        if i - start >= 2:
            out |= set(range(start, i + 1))
    return out


def test_repetition(spark):
    r = random.Random(3)
    cases = {1: ["Music…"] * 4, 2: ["大象", "大象", "獅子", "老虎"], 3: ["a b", "b a", "a", "A x"]}
    cases |= {v: [" ".join(r.choice("abc") for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 40))] for v in range(4, 40)}
    df = spark.createDataFrame([(v, i, t) for v, ts in cases.items() for i, t in enumerate(ts)], "video_id int, scene_idx int, transcript string")
    got = {}
    for x in timeline.repetitive_transcripts(df).where("is_repetitive").collect():
        got.setdefault(x.video_id, set()).add(x.scene_idx)
    assert got == {v: repetitive(ts) for v, ts in cases.items() if repetitive(ts)}


def test_ocr(spark):
    scenes = spark.createDataFrame([(1, 0, 0.0, 10.0)], "video_id int, scene_idx int, start_sec double, end_sec double")
    hits = spark.createDataFrame([(1, 0, 0.0, "ABC-1234", 0.7, None), (1, 0, 4.0, "ＡＢＣ-1234 ", 0.9, "b"), (1, 0, 6.0, "x", 0.2, None), (1, 0, 6.0, "  ", 0.9, None)], "video_id int, scene_idx int, frame_sec double, text string, confidence double, bbox string")
    (e,) = timeline.merge_ocr(hits, scenes).collect()
    assert (e.start_sec, e.end_sec, e.confidence, e.resolved_text, e.raw_text, e.bbox) == (0.0, 5.0, 0.9, "ABC-1234", "ＡＢＣ-1234 ", "b")
    order = timeline.ocr_schedule(spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 5.0, 6.0)], "video_id int, scene_idx int, start_sec double, end_sec double"), budget=2.0).orderBy("position").collect()
    assert [(x.scene_idx, x.at_sec) for x in order] == [(0, 0.0), (1, 5.0), (0, 2.0)]


def test_budget(spark):
    items = spark.createDataFrame([(1, i, 1.0) for i in range(9)], "k int, i int, cost double")
    assert [x.i for x in timeline.budget_cut(items, "k", ["i"], "cost", 4.0).orderBy("i").collect()] == [0, 1, 2, 3, 4, 5]


def test_build_segments(spark):
    cuts = spark.createDataFrame([(1, 0.0, 10.0), (1, 10.0, 20.0), (1, 20.0, 30.0)], "video_id int, start_sec double, end_sec double")
    videos = spark.createDataFrame([(1, 30)], "video_id int, duration_sec int")
    u = spark.createDataFrame([(1, 1.0, 3.0, "hi there you", 0.1, -0.1, 1.0), (1, 12.0, 13.0, "noise of music", 0.9, -0.1, 1.0)], "video_id int, start_sec double, end_sec double, text string, no_speech_prob double, avg_logprob double, compression_ratio double")
    out = spark.createDataFrame([(1, 0, "sees", None, 3)], "video_id int, scene_idx int, visual_description string, ocr_text string, vlm_frame_count int")
    rows = build_segments(cuts, videos, u, out).orderBy("scene_idx").collect()
    assert [(x.transcript, x.index_transcript, x.visual_description, x.vlm_frame_count) for x in rows] == [("hi there you", "hi there you", "sees", 3), ("noise of music", None, None, 0), (None, None, None, 0)]


def segs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, video_id int, start_sec double, transcript string, visual_description string, ocr_text string")


def test_material(spark):
    rows = [(1, i * 10.0, "Thank you" if i < 6 else f"t{i}", f"v{i}", "FRAME" if i % 2 else f"o{i}") for i in range(10)]
    rows += [(2, 65.4, "line\nbreak", "null", None), (2, 70.0, " ", None, "-")]
    s = segs(spark, rows)
    lines = {(x.video_id, x.line_sec): x.line for x in material.build_material(s, include_ocr=True).collect()}
    assert lines[1, 0] == "[00:00｜0 秒] 畫面：v0；畫面文字：o0" and lines[1, 90] == "[01:30｜90 秒] 畫面：v9"
    assert lines[2, 65] == "[01:05｜65 秒] 字幕：line break" and len(lines) == 11
    assert [x.video_id for x in material.junk_transcript_videos(s).collect()] == [1]
    b = {x.video_id: (x.n_lines, x.first_sec, x.last_sec, x.tail_sec) for x in material.material_bounds(material.material_lines(material.build_material(s))).collect()}
    assert b == {1: (10, 0, 90, 81), 2: (1, 65, 65, 58)}
    few, error = material.document_input(s, 5)
    assert {x.video_id for x in few.collect()} == {2} and error.first().video_id == 1
    assert material.summary_input(s, 3).count() == 5


def holes(stamps, lines):
    if not lines:
        return set()
    unwritten = {x for x in lines if x not in {int(t) for t in stamps}}
    inside = sorted(t for t in stamps if min(lines) <= t <= max(lines))
    if not inside:
        return set()
    edges = [min(lines), *inside, max(lines)]
    return {(int(a), int(b)) for a, b in zip(edges, edges[1:]) if b - a > 60 and any(int(a) <= s <= int(b) for s in unwritten)}


def test_coverage(spark):
    r = random.Random(4)
    steps, lines = [], []
    for v in range(40):
        lines += [(v, s) for s in sorted(r.sample(range(900), r.choice([1, 5, 40])))]
        steps += [(v, r.randint(0, 2), i, r.choice([float(r.randint(0, 1000)), r.uniform(0, 900)])) for i in range(r.choice([0, 1, 8]))]
    s = spark.createDataFrame(steps, "video_id int, section_idx int, step_idx int, timestamp_sec double")
    n = spark.createDataFrame(lines, "video_id int, line_sec bigint")
    h = coverage.document_holes(s, n)
    got = {}
    for x in h.collect():
        got.setdefault(x.video_id, set()).add((x.hole_start, x.hole_end))
    for v in range(40):
        assert got.get(v, set()) == holes([x[3] for x in steps if x[0] == v], [x[1] for x in lines if x[0] == v])
    for x in coverage.assign_fill_section(h, s).collect():
        best = None
        for y in sorted(y for y in steps if y[0] == x.video_id):
            if y[3] <= x.hole_start and (best is None or y[3] > best[3]):
                best = y
        assert x.section_idx == (best and best[1])
    plan = coverage.fill_plan(spark.createDataFrame([(v, "content_log" if v == 1 else "sop") for v in range(40)], "video_id int, doc_type string"), h, n, s)
    assert plan.where("video_id = 1").count() == 0 and plan.agg(F.max("turn")).first()[0] <= 5


def test_coverage_report(spark):
    import json

    doc = {"doc_type": "sop", "title": "t", "overview": "o", "sections": [{"heading": "a", "steps": [{"timestamp_sec": 0, "heading": "x", "detail": ""}, {"timestamp_sec": 90.5, "heading": "y", "detail": ""}]}], "uncovered": ["z"]}
    videos = spark.createDataFrame([(1, 100, json.dumps(doc)), (2, 50, None)], "id int, duration_sec int, document_json string")
    s = segs(spark, [(1, float(t), None, f"v{t}", None) for t in (0, 30, 45, 90)])
    rows, summary = coverage_report(videos, s)
    (x,) = rows.collect()
    assert (x.steps, x.max_timestamp_sec, x.coverage, x.off_grid, x.uncovered_items, x.gaps_over_limit, x.skipped_share, x.backwards) == (2, 90.5, 0.905, 0, 1, 1, 0.75, 0)
    assert summary.first().videos == 1


@pytest.mark.parametrize("groupings", [[()], [(), ("vlm_frame_count",), ("video_id",)]])
def test_quality(spark, groupings):
    df = spark.createDataFrame([(1, 1, "正在搬箱子"), (1, 2, "第一張"), (2, 2, "無"), (2, 1, None)], "video_id int, vlm_frame_count int, visual_description string")
    rows = quality.description_quality(df, groupings, rates=quality.RATES | quality.EXTRA_RATES).collect()
    total = next(x for x in rows if len(groupings) == 1 or x.grouping_level == 3)
    assert (total.n, total.avg_length, total.vague_rate, total.concrete_rate, total.meta_rate) == (3, 3.0, 0.3333, 0.3333, 0.3333)
    assert len(rows) == (1 if len(groupings) == 1 else 5)
