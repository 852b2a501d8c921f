"""Ranks, running sums and previous rows over ranges, and expressions that are evaluated once a row."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timeloom.functions.catalogue import topic
from timeloom.functions.text import clean_text, dominant_word, positive_text, strip_generic_terms
from timeloom.operators import fusion, material, ordered, timeline
from timeloom.operators.ordered import numbered, previous, ranged, running, unranged
from timeloom.sources.tables import look_up, stage


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    """Small partitions aren't put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    """Most rows have one key; some have none; many are equal in their order but for n."""
    r = random.Random(4)
    given = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.randint(0, 20), i, r.randint(-3, 9)) for i in range(600)] + [("one", 1, 700, 5)]
    return given, stage(spark.createDataFrame(given, "k string, at int, n int, v int").repartition(3))


def by_key(given):
    out: dict = {}
    for k, at, n, v in sorted(given, key=lambda x: (x[0] or "", x[1], x[2])):
        out.setdefault(k, []).append((at, n, v))
    return out


def test_running_and_previous(rows):
    given, df = rows
    parts = ranged(df, "k", ["at", "n"])
    assert parts.where("k = 'hot'").select("_p").distinct().count() > 1  # the hot key isn't in one task
    out = running(parts, "k", sums={"before": F.lit(1), "total": F.col("v")}, least={"low": F.when(F.col("v") > 0, F.col("v"))})
    out = unranged(previous(out, "k", pv=F.col("v"), pat=F.col("at")))
    got = {r.n: (r.before, r.total, r.low, r.pv, r.pat) for r in out.collect()}
    for of in by_key(given).values():
        for i, (_, n, _) in enumerate(of):
            values = [v for _, _, v in of[:i]]
            assert got[n] == (i, sum(values), min((v for v in values if v > 0), default=None), *((of[i - 1][2], of[i - 1][0]) if i else (None, None)))
    assert len(got) == len(given) and out.columns == ["k", "at", "n", "v", "before", "total", "low", "pv", "pat"]


@pytest.mark.parametrize("hot", [5, 10**6])
def test_numbered(rows, monkeypatch, hot):
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    given, df = rows
    got = {r.n: r.rank for r in numbered(df, "k", [F.desc("at"), F.col("n")], "rank").collect()}
    for of in by_key(given).values():
        assert [got[n] for n in [x[1] for x in sorted(of, key=lambda x: (-x[0], x[1]))]] == list(range(1, len(of) + 1))
    assert numbered(df.limit(0), "k", ["at"], "rank").count() == 0


@pytest.mark.parametrize("hot", [5, 10**6])
def test_ranks_of_a_query_with_all_rows(spark, monkeypatch, hot):
    """As by windows over the query, with ties across ranges; and for a hot query no window of the plan is over the query alone."""
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    from pyspark.sql import Window

    r = random.Random(6)
    scored = stage(spark.createDataFrame([(1 if i % 9 else 2, i, i % 4, float(i % 7), r.choice([0.1, 0.2, 0.3, 0.4])) for i in range(400)], "query_id int, id int, video_id int, start_sec double, similarity double"))
    found = stage(spark.createDataFrame([(1 if i % 9 else 2, i, r.choice([-1e6, -3.0, -2.5, -1.0])) for i in range(0, 400, 2)], "query_id int, id int, score double"))
    w = Window.partitionBy("query_id")
    dense = scored.select("query_id", "id", F.row_number().over(w.orderBy(F.desc("similarity"), "video_id", "start_sec", "id")).alias("d"))
    shared = found.select("query_id", "id", (F.rank().over(w.orderBy("score")) + (F.count("*").over(Window.partitionBy("query_id", "score")) - 1) / 2).alias("s"))
    want = {(x.query_id, x.id): (x.d, x.s) for x in dense.join(shared, ["query_id", "id"], "left").collect()}
    out = fusion.rrf(scored, found)
    assert {(x.query_id, x.id): (x.dense_rank, x.sparse_rank) for x in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(([a-z_]+)#\d+L?, ([a-z_]+)", plan)
    assert windows and all(a == "_p" or b == "_p" for a, b in windows) == (hot == 5), windows


@pytest.mark.parametrize("total", [10, 1_000_000])
def test_look_up_either_way(spark, total):
    """Below the size at which heavy keys are parted from others, and above it; null keys are keys."""
    left = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5)], "k string, n int")
    table = spark.createDataFrame([(None, "none", 5000), ("a", "A", 2000), ("b", "B", 1), ("z", "Z", 3)], "k string, name string, w int")
    got = {r.n: r.name for r in look_up(left, table, ["k"], "w", total).collect()}
    assert got == {1: "none", 2: "A", 3: "A", 4: "B"}
    assert {r.n: r.name for r in look_up(left, table, ["k"], "w", total, "left").collect()} == got | {5: None}


# ---- text expressions


def test_dominant_word_is_linear_and_first_of_equals(spark):
    texts = [None, "", " \t", "b a a b", "B b x", "Ä ä　q", " ".join(f"w{i}" for i in range(20_000)) + " w5"]
    got = [tuple(r.w) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", dominant_word(F.col("t")).alias("w")).orderBy("i").collect()]
    assert got == [(None, 0.0)] * 3 + [("b", 0.5), ("b", 2 / 3), ("ä", 2 / 3), ("w5", 2 / 20_001)]
    took = []
    for n in (20_000, 80_000):
        df = stage(spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)] * 4, "t string"))
        at = time.perf_counter()
        assert df.select(dominant_word(F.col("t")).alias("w")).where("w.word = 'w0'").count() == 4
        took.append(time.perf_counter() - at)
    assert took[1] < 8 * took[0] + 1


def test_each_text_is_worked_on_once(spark):
    """In the optimized plans: what a column names several times isn't written out as often."""
    df = stage(spark.createDataFrame([("a", "b", "c")], "title string, summary string, video_id string"))

    def times(out, word):
        return out._jdf.queryExecution().optimizedPlan().toString().count(word)

    assert times(df.select(topic(F.col("title"), F.col("summary")).alias("t")).where("t = 'x'").groupBy("t").count(), "topic_of(title") == 1
    assert times(df.select(positive_text(strip_generic_terms(F.concat("title", "summary"))).alias("t")), "concat(") == 1
    assert times(df.select(clean_text(F.col("title")).alias("t")), "regexp_replace(") == 1
    assert times(material.dominant_share(df, "title"), "regexp_replace(") == 1
    assert times(df.select(dominant_word(F.col("title")).alias("w")).where("w.word is not null"), "_dominant_word(title") == 1


def test_positive_text_blanks_each_negation(spark):
    cases = ["找人，不要車子。沒有貓", "不要不要x", "不要", "，不要，x", "a不是b\nc！d並非\U0001f600e", "", "沒有"]
    marks = re.compile("(?:不要|沒有|不是|並非)[^，。！？、]*")
    got = [r.p for r in spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", positive_text(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == [marks.sub(lambda m: " " * len(m[0]), c) for c in cases]


def test_repetitive_texts_of_whole_length(spark):
    texts = ["ja ja nein"] * 2 + ["JA ja x"] + ["x y z"] + ["nein nein"] * 2 + [None] + ["b b c"] * 4
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "b b")], "video_id int, scene_idx int, transcript string")
    got = {(r.video_id, r.scene_idx): r.is_repetitive for r in timeline.repetitive_transcripts(df).collect()}
    assert {k for k, v in got.items() if v} == {(1, i) for i in (0, 1, 2, 7, 8, 9, 10)} and len(got) == len(texts) + 1
    assert Counter(got.values())[True] == 7


def test_places_sort_bounded_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    from timeloom.operators import catalogue

    monkeypatch.setattr(catalogue, "RANGE_ROWS", 50)
    staged, real = [], catalogue.stage
    monkeypatch.setattr(catalogue, "stage", lambda df: staged.append(df.rdd.glom().map(len).collect()) or real(df))
    got = catalogue.places(spark.range(2_000).withColumn("x", F.col("id") % 7), F.desc("x"), F.col("id")).collect()
    assert max(staged[0]) < 200
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == sorted(range(2_000), key=lambda i: (-(i % 7), i)) and {r.place for r in got} == set(range(1, 2_001))
