"""Operators with and without a hot key: the rows are the same, whichever way they are worked off."""

import random

import pytest
from pyspark.sql import functions as F

from timeloom.operators import ordered, timeline
from timeloom.sources.tables import stage
from timeloom.streaming import conversations

TURN = "conv_id bigint, turn bigint, message string, action string, query string, llm_video_ids array<int>, ui_video_ids array<int>, selected_index int, n_results int, clarification string"


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    """Small partitions aren't put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def both(monkeypatch, make):
    """The sorted rows of the plain way and of that for hot keys."""
    rows = lambda: sorted((tuple(r) for r in make().collect()), key=str)
    plain = rows()
    monkeypatch.setattr(ordered, "HOT_ROWS", 5)
    return plain, rows()


def keys(r, n):
    return [r.choice([1] * 9 + [2, 3, None]) for _ in range(n)]


@pytest.mark.parametrize(("lengths", "seed"), [((1, 2, 3), 1), ((1, 2, 9), 2), ((3, 7, 8, 20), 3), ((0.5,), 4)])
def test_merge_short(spark, monkeypatch, lengths, seed):
    """Videos that end with short scenes, begin with some, or have nothing else."""
    r = random.Random(seed)
    rows, at = [], {}
    for v in keys(r, 300) + [7, 8, 8]:
        a = at.get(v, 0.0)
        at[v] = a + r.choice(lengths)
        rows.append((v, a, at[v]))
    df = stage(spark.createDataFrame(rows, "video_id int, start_sec double, end_sec double").repartition(3))
    plain, hot = both(monkeypatch, lambda: timeline.merge_short(df))
    assert plain == hot and plain
    for v, end in at.items():
        mine = sorted((a, b) for k, a, b in plain if k == v)
        assert mine[0][0] == 0 and mine[-1][1] == end and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))
        assert len(mine) == 1 or all(b - a >= 8 for a, b in mine)


def test_runs_budgets_and_schedules(spark, monkeypatch):
    r = random.Random(5)
    rows = [(k, i, r.choice("aab"), float(r.randint(0, 4)), i * 5.0, i * 5.0 + r.choice([1, 5, 30])) for i, k in enumerate(keys(r, 300))]
    df = stage(spark.createDataFrame(rows, "video_id int, scene_idx int, word string, cost double, start_sec double, end_sec double").repartition(3))
    makers = [
        lambda: timeline.runs(df, "video_id", ["scene_idx"], F.col("word"), F.col("cost") > 0),
        lambda: timeline.budget_cut(df, "video_id", ["scene_idx"], "cost", 40.0),
        lambda: timeline.budget_cut(df, "video_id", ["scene_idx"], "cost", 41.0, batch=7),
        lambda: timeline.ocr_schedule(df, 33.0),
        lambda: timeline.ocr_schedule(df),
    ]
    for make in makers:
        with monkeypatch.context() as m:
            plain, hot = both(m, make)
            assert plain == hot and plain


def test_conversations(spark, monkeypatch):
    r = random.Random(9)
    rows = []
    for i, k in enumerate(keys(r, 260)):
        ids = lambda: [r.randint(0, 4) for _ in range(r.choice([0, 0, 2]))]
        rows.append((k, i, "m" * r.choice([1, 30, 900]) + str(i), r.choice(["new_search", "refine_search", "refine_search", "clarify", "select_result", None]), f"q{i}", ids(), ids(), r.choice([None, 1, 9]), r.choice([None, 0, 5]), r.choice([None, "which?"])))
    df = stage(spark.createDataFrame(rows, TURN).repartition(3))
    plain, hot = both(monkeypatch, lambda: conversations.conversation_scopes(df).select("conv_id", "turn", "action", "active_query", "scope", "shown_scope", "selected_index", "history"))
    assert len(plain) == len(rows) and plain == hot


def test_history(spark, monkeypatch):
    r = random.Random(10)
    df = stage(spark.createDataFrame([(k, i, r.choice([None, "", "x" * r.choice([3, 500, 2000]) + str(i)])) for i, k in enumerate(keys(r, 200))], "conv_id int, turn int, text string").repartition(3))
    plain, hot = both(monkeypatch, lambda: conversations.history(df))
    assert plain == hot and len(plain) == 4
