"""Sources, the catalogue, the model seam, evaluation, and streams."""

import random
import tempfile

import pytest
import stand_ins
from pyspark.sql import functions as F

from timeloom.functions.catalogue import best_thumbnail, catalogue_items, chat_cost, is_video_url, topic
from timeloom.functions.times import format_timestamp, parse_timestamp, sample_times
from timeloom.operators import catalogue, evaluation, models
from timeloom.sources import schemas, tables, vectors
from timeloom.sources.golden import read_golden_set
from timeloom.sources.snapshots import read_snapshot
from timeloom.streaming import conversations, jobs
from timeloom.streaming.tables import grow_index, log_windows, swap_analyses


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_schemas(spark, folder):
    spark.range(3).select(F.col("id").cast("int"), F.lit(1).alias("video_id"), F.lit("x").alias("transcript"), F.lit(0).alias("unknown")).write.parquet(f"{folder}/s")
    df = schemas.with_content(schemas.load_table(spark, f"{folder}/s", "segments"))
    assert df.columns == [*schemas.schema_of("segments").names, "content"] and df.first().content == "x  "
    moved, report = schemas.align_columns(df, schemas.schema_of("segments").add("content", "string"), schemas.GENERATED["segments"])
    assert "content" not in moved.columns and report["lost"] == [] and report["filled"] == []
    _, report = schemas.align_columns(spark.range(1).select("id", F.lit(1).alias("old")), schemas.schema_of("search_log"))
    assert report == {"moved": ["id"], "lost": ["old"], "filled": ["query", "cost_usd", "created_at"]}


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "x", bytearray(b"\x01")), (2, None, None), (3, "y", None)], "id int, t string, b binary")
    b = spark.createDataFrame([(1, "x", bytearray(b"\x02")), (2, None, None), (4, "y", None)], "id int, t string, b binary")
    assert sorted((r.id, r.difference, r.columns) for r in schemas.reconcile(a, b, "id").collect()) == [(1, "values", ["b"]), (3, "left", None), (4, "right", None)]
    assert tuple(schemas.reconcile_counts(a, b, "id").first()) == (3, 3, 1, 1, 1)


def test_vectors(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    back = df.select(vectors.decode_vec(vectors.encode_vec("v")).alias("v"), F.hex(vectors.encode_vec("v")).alias("h")).collect()
    assert [r.v for r in back] == [[1.5, -2.0], None] and back[0].h == "0000C03F000000C0"


def test_writes(spark, folder):
    rows = lambda *x: spark.createDataFrame(list(x), "video_id int, start_sec double, transcript string, visual_description string")
    tables.write_segments(rows((1, 0.0, "", "a"), (1, 1.0, "t", ""), (2, 0.0, "u", "b")), f"{folder}/seg")
    assert read_snapshot(spark, f"{folder}/seg").where("transcript is null").count() == 1
    tables.replace_partition(rows((1, 5.0, "new", "n")), f"{folder}/seg")
    assert sorted((r.video_id, r.start_sec) for r in read_snapshot(spark, f"{folder}/seg").collect()) == [(1, 5.0), (2, 0.0)]
    tables.append_search_log(spark.createDataFrame([("q", 0.001)], "query string, cost_usd double"), f"{folder}/log")
    tables.append_search_log(spark.createDataFrame([("q2", 0.0)], "query string, cost_usd double"), f"{folder}/log")
    assert spark.read.parquet(f"{folder}/log").count() == 2
    tables.write_report(spark.range(2), f"{folder}/rep", "a")
    tables.write_report(spark.range(3), f"{folder}/rep", "b")
    assert tables.read_reports(spark, f"{folder}/rep").groupBy("run").count().count() == 2
    df = rows((2, 1.0, "", ""), (1, 2.0, "", ""), (1, 1.0, "", ""))
    assert [(r.video_id, r.start_sec) for r in tables.scan_segments(df).collect()] == [(1, 1.0), (1, 2.0), (2, 1.0)]
    assert tables.scan_segments(df, []).collect() == [] and tables.scan_segments(df, [2]).count() == 1


def test_golden_set(spark, folder):
    head = "id,query,query_type,is_answerable,expected_video_id,expected_start,expected_end,confirmed,notes\n"
    with open(f"{folder}/g.csv", "w") as f:
        f.write(head + "g1,q one,a,TRUE,1,00:10.0,01:20.5,x,n\ng1,q one,a,TRUE,1,03:00.0,03:10.0,x,n\ng2,q two,b,FALSE,,,,x,\n")
    queries, answers = read_golden_set(spark, f"file://{folder}/g.csv")
    assert sorted((r.id, r.is_answerable) for r in queries.collect()) == [("g1", True), ("g2", False)]
    assert sorted((r.start_sec, r.end_sec) for r in answers.collect()) == [(10.0, 80.5), (180.0, 190.0)]


def test_times(spark):
    r = spark.range(1).select(parse_timestamp(F.lit("bad")), format_timestamp(F.lit(6125.7)), sample_times(F.lit(0.0), F.lit(7.0)), sample_times(F.lit(5.0), F.lit(5.0)), sample_times(F.lit(0.0), F.lit(99.0))).first()
    assert tuple(r) == (None, "102:05", [0.0, 2.0, 4.0, 6.0], [5.0], [0.0, 2.0, 4.0, 6.0, 8.0])


def test_evaluation(spark):
    queries = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "query_id int, is_answerable boolean")
    answers = spark.createDataFrame([(1, 7, 0.0, 10.0), (2, 7, 0.0, 10.0)], "query_id int, video_id int, start_sec double, end_sec double")
    results = spark.createDataFrame([(1, 1, 8, 0.0, 10.0, 0.9), (1, 2, 7, 5.0, 20.0, 0.8), (2, 1, 7, 10.0, 20.0, 0.7)], "query_id int, rank int, video_id int, start_sec double, end_sec double, similarity double")
    summary = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True)], "query_id int, is_confident boolean")
    rows = evaluation.evaluate(queries, answers, results, summary)
    x = rows.where("query_id = 1").first()
    assert (x.recall_at_1, x.recall_at_5, x.reciprocal_rank, x.best_iou, x.top1_similarity) == (False, True, 0.5, 0.25, 0.9) and abs(x.ndcg_at_5 - 0.63093) < 1e-5
    assert rows.where("query_id = 3").first().recall_at_1 is None
    total = evaluation.aggregate_eval(rows).first().asDict()
    assert total["recall_at_5"] == 0.5 and total["mean_timestamp_iou"] == 0.25 and (total["no_answer_precision"], total["no_answer_recall"], total["no_answer_f1"]) == (0.5, 0.5, 0.5)


VIDEO = "id int, title string, summary string, status string, created_at string, analyzed_at string, segment_count int, cost_usd double, source_url string, file_path string, pipeline_stage string"


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [
        (1, "世界盃 足球", None, "analyzed", "2026-01-01", "2026-01-05", 3, 0.5, "u1", "p", None),
        (2, "Python 教學", "足球", "analyzing", "2026-01-02", None, None, None, "u2", "p", None),
        (3, "x", None, "analyzing", "2026-01-03", "2026-01-04", 2, 0.25, "u3", "p", "s"),
        (4, "MV", None, "failed", "2026-01-04", None, None, None, "u4", "p", None),
        (5, "y", None, "pending", "2026-01-05", None, None, None, None, "p", None),
    ]
    return spark.createDataFrame(rows, VIDEO)


def test_catalogue(spark, catalog):
    assert [r.id for r in catalogue.unanalyzed(catalog).collect()] == [5, 2]
    assert [r.id for r in catalogue.library(catalog).collect()] == [4, 1, 3]
    assert tuple(catalogue.header_stats(catalog).first()) == (2, 1, 5, 0.75)
    assert [r.id for r in catalogue.library_sort(catalog, "cost_usd").collect()] == [1, 3, 2, 4, 5]
    assert [r.t for r in catalog.orderBy("id").select(topic(F.col("title"), F.col("summary")).alias("t")).collect()] == ["運動賽事", "教學課程", "其他", "音樂", "其他"]
    assert {r.category: r.n for r in catalogue.category_counts(catalog, "failed").collect()} == {"音樂": 1}
    assert catalogue.matches_library(catalog, " 足球 ").count() == 2 and catalogue.matches_library(catalog, "  ").count() == 5
    flags = catalogue.modality_flags(spark.createDataFrame([(1, None, "", "o"), (1, "t", None, "")], "video_id int, transcript string, visual_description string, ocr_text string"))
    view = {r.id: r for r in catalogue.video_view(catalog, flags).collect()}
    assert (view[1].has_transcript, view[1].has_visual, view[1].has_ocr, view[2].has_ocr) == (True, False, True, False) and "file_path" not in catalogue.video_view(catalog, flags).columns
    ids = spark.createDataFrame([(1,), (9,)], "video_id int")
    assert {r.video_id for r in catalogue.valid_scope(ids, catalog).collect()} == {1}
    left = catalogue.cascade_delete({"videos": catalog, "segments": ids}, ids)
    assert left["videos"].count() == 4 and left["segments"].count() == 0
    back = {r.id: (r.status, r.analyzed_at) for r in catalogue.reset_videos(catalog, ids).collect()}
    assert back[1] == ("pending", None) and back[4] == ("failed", None)


def test_outcomes(spark, catalog):
    videos = catalog.withColumns({c: F.lit("old") for c in ("summary_model", "document_json", "document_type", "document_model")})
    o = spark.createDataFrame([(2, "analyzed", "t", 4, 0.1, None, None, "new", "sop", "m", True, 2)], "id int, status string, analyzed_at string, segment_count int, cost_usd double, summary string, summary_model string, document_json string, document_type string, document_model string, stopped_by_budget boolean, failed_scenes int")
    rows = {r.id: r for r in catalogue.apply_outcomes(videos, o).collect()}
    assert (rows[2].status, rows[2].summary, rows[2].document_json, rows[2].pipeline_stage) == ("analyzed", "足球", "new", "stopped by budget; 2 failed scenes")
    assert (rows[3].status, rows[3].pipeline_stage, rows[3].document_json) == ("analyzing", "s", "old")


def test_admission(spark, catalog):
    j = "job_type string, video_id int, source_url string, status string"
    active = spark.createDataFrame([("analysis", 1, None, "queued"), ("analysis", 2, None, "failed"), ("download", None, "a", "running")], j)
    wanted = spark.createDataFrame([("analysis", 1, None), ("analysis", 2, None), ("analysis", 2, None), ("download", None, "a"), ("download", None, "u1"), ("download", None, "b")], "job_type string, video_id int, source_url string")
    assert sorted((r.job_type, r.video_id or 0, r.source_url or "") for r in catalogue.admit_jobs(wanted, active, catalog).collect()) == [("analysis", 2, ""), ("download", 0, "b")]


def test_small_functions(spark):
    usage = spark.createDataFrame([("gpt-4o-mini", 1_000_000, None), ("other", 5, 5)], "model string, prompt_tokens int, completion_tokens int")
    assert {r.model: (r.cost_usd, r.error) for r in chat_cost(usage).collect()} == {"gpt-4o-mini": (0.15, None), "other": (None, "no price for other")}
    urls = spark.createDataFrame([(" https://youtu.be/x ", True), ("https://youtube.com/watch?v=1", True), ("http://example.com", False), (None, False)], "u string, want boolean")
    assert all(r.got == r.want for r in urls.withColumn("got", is_video_url(F.col("u"))).collect())
    items = spark.createDataFrame([("a", [("s", 10, 10), ("", 99, 99), ("l", 20, 20)]), ("b", [])], "id string, thumbnails array<struct<url:string,width:int,height:int>>")
    assert {r.id: r.url for r in best_thumbnail(items).collect()} == {"a": "l", "b": "https://i.ytimg.com/vi/b/hqdefault.jpg"}
    none = spark.createDataFrame([("", None), ("x", [("p", None, None), ("q", 0, 5)])], items.schema)
    assert {r.id: r.url for r in best_thumbnail(none).collect()} == {"": None, "x": "p"}
    raw = spark.createDataFrame([("a", None, None, None, 61.7, None, "up", 5), ("b", "t", "u", "d", 0.0, "c", "up", None)], "id string, title string, url string, description string, duration double, channel string, uploader string, view_count bigint")
    assert sorted(map(tuple, catalogue_items(raw).collect())) == [("a", "（無標題）", "https://www.youtube.com/watch?v=a", "", 61, "up", 5), ("b", "t", "u", "d", None, "c", None)]
    turns = spark.createDataFrame([(1, i) for i in range(9)], "frame_id int, turn int")
    assert sorted(r.turn for r in catalogue.recent_turns(turns).collect()) == [3, 4, 5, 6, 7, 8]


def test_model_seam(spark):
    def fn(rows):
        if any(r["t"] == "bad" for r in rows):
            raise ValueError("no")
        return [{"n": len(r["t"]), "cost_usd": 0.5} for r in rows]

    df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, "abc")], "id int, t string").coalesce(1)
    rows = {r.id: (r.n, r.cost_usd, r.error) for r in models.apply_model(df, ["t"], fn, "n int", wait=0).collect()}
    assert rows == {1: (2, 0.5, None), 2: (None, 0.0, "ValueError: no"), 3: (3, 0.5, None)}
    seg = spark.createDataFrame([(1, "x", "y"), (2, "x", ""), (3, None, "x")], "id int, transcript string, ocr_text string")
    out, ledger = models.embed_columns(seg, {"transcript": "tv", "ocr_text": "ov"}, stand_ins.hash_embedding())
    got = {r.id: r for r in out.collect()}
    assert got[1].tv == got[2].tv == got[3].ov and got[2].ov is None and got[3].tv is None and ledger.count() == 2
    q = spark.createDataFrame([(1, "ab")], "query_id int, query string")
    vec, cost = models.prepare_queries(q, lambda rows: [{"zh": r["query"], "en": "en", "cost_usd": 0.001} for r in rows], stand_ins.hash_embedding())
    assert {r.variant for r in vec.collect()} == {"ab", "en"} and cost.first().cost_usd > 0.001
    answers = spark.createDataFrame([("m1", '{"action":"refine_search","standalone_query":" ","filters_video_ids":[3]}'), ("m2", "junk"), ("m3", '{"action":"dance"}')], "message string, answer string")
    assert [(r.action, r.standalone_query, r.llm_video_ids) for r in models.parse_intents(answers).collect()] == [("refine_search", "m1", [3]), ("new_search", "m2", []), ("new_search", "m3", [])]

    def broken(rows):
        raise RuntimeError("down")

    material = models.collect_material(spark.createDataFrame([(1, 5.0, "b"), (1, 1.0, "a")], "video_id int, start_sec double, line string"))
    assert material.first().material == "a\nb"
    made = models.write_documents(material, broken, lambda rows: [{"summary": "s", "cost_usd": 0.1} for _ in rows]).first()
    assert made.summary == "s" and made.document_json is None
    assert models.write_documents(material, stand_ins.echo_json, broken).first().document_type == "sop"


def run_stream(df, folder, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert not q.isActive and q.exception() is None


def test_job_stream(spark, folder):
    r = random.Random(1)
    rows = [(j, s, 1_700_000_000 + s, r.choice(["progress"] * 6 + ["result", "error"]), f"st{s}", s, f"m{s}", 0.5) for s in range(60) for j in [r.randint(0, 9)]]
    cols = "job_id bigint, seq bigint, at bigint, event_type string, stage string, percent int, message string, cost_usd double"
    events = spark.createDataFrame(rows, cols).withColumn("event_time", F.timestamp_seconds("at")).drop("at")
    batch = {x.job_id: x for x in jobs.job_state(events).collect()}
    for n in range(3):
        events.where((F.col("seq") >= 20 * n) & (F.col("seq") < 20 * n + 20)).coalesce(1).write.mode("append").parquet(f"{folder}/ev")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/ev")
    run_stream(jobs.job_state_stream(stream), folder, "update", "job_rows")
    last = spark.table("job_rows").collect()
    final = {}
    for x in last:  # rows come in the order of their batches
        final[x.job_id] = x
    assert final.keys() == batch.keys()
    for j, x in batch.items():
        assert (x.status, x.stage, x.progress_percent, x.error_message, x.cost_usd, x.completed_at) == (final[j].status, final[j].stage, final[j].progress_percent, final[j].error_message, final[j].cost_usd, final[j].completed_at)


def test_stored_jobs_begin_another_stream(spark, folder):
    """What is under way when a stream stops is read from its state, fails after a restart, or goes on in another stream."""
    kind = "job_id bigint, seq bigint, event_time timestamp, event_type string, stage string, percent int, message string, cost_usd double"
    event = "select {0} as job_id, {1} as seq, timestamp_seconds({1}) as event_time, '{2}' as event_type, '{3}' as stage, {4} as percent, '{3}' as message, 0.5D as cost_usd"
    events = lambda *rows: spark.sql(" union all ".join(event.format(*x) for x in rows)).selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in kind.split(", ")])
    events((1, 1, "progress", "a", 10), (2, 1, "progress", "a", 20), (2, 2, "result", "b", 0), (3, 1, "error", "boom", 0)).coalesce(1).write.parquet(f"{folder}/first")
    run_stream(jobs.job_state_stream(spark.readStream.schema(kind).parquet(f"{folder}/first")), folder, "update", "first_jobs")
    left = jobs.stored_jobs(spark, f"{folder}/ck-first_jobs")
    assert [(r.job_id, r.status, r.stage, r.progress_percent) for r in left.collect()] == [(1, "running", "a", 10)]
    failed, _ = jobs.reconcile_after_restart(left, spark.createDataFrame([], "id int, status string, analyzed_at string, pipeline_stage string"))
    assert [(r.job_id, r.status, r.error_message) for r in failed.collect()] == [(1, "failed", jobs.INTERRUPTED)]
    events((1, 5, "progress", "c", 50), (2, 6, "progress", "late", 1), (3, 7, "result", "late", 1), (1, 8, "result", "d", 0)).coalesce(1).write.parquet(f"{folder}/second")
    known = spark.table("first_jobs").where("status <> 'running'").unionByName(left)
    run_stream(jobs.job_state_stream(spark.readStream.schema(kind).parquet(f"{folder}/second"), initial=known), folder, "update", "second_jobs")
    assert [(r.job_id, r.status, r.stage, r.progress_percent) for r in spark.table("second_jobs").collect()] == [(1, "completed", "c", 100)]


def test_silent_and_ended_jobs(spark, folder):
    """With a clock: a silent job fails, and the state of an ended one goes after its time."""
    import time

    kind = "job_id bigint, seq bigint, event_time timestamp, event_type string, stage string, percent int, message string, cost_usd double"
    rows = lambda *x: spark.createDataFrame(list(x), "job_id bigint, seq bigint, event_type string").selectExpr("job_id", "seq", "timestamp_seconds(seq) as event_time", "event_type", "'s' as stage", "1 as percent", "'m' as message", "0.5D as cost_usd").coalesce(1).write.mode("append").parquet(f"{folder}/ev2")
    rows((1, 1, "progress"), (2, 1, "result"))
    q = jobs.job_state_stream(spark.readStream.schema(kind).parquet(f"{folder}/ev2"), silence_ms=3000, keep_ms=1000).writeStream.format("memory").queryName("clock_jobs").outputMode("update").option("checkpointLocation", f"{folder}/ck-clock").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and not spark.sql("select * from clock_jobs where status = 'failed'").count():
            time.sleep(1)
    finally:
        q.stop()
    assert [(r.job_id, r.error_message) for r in spark.sql("select * from clock_jobs where status = 'failed'").collect()] == [(1, jobs.INTERRUPTED)]
    assert jobs.stored_jobs(spark, f"{folder}/ck-clock").count() == 0  # no job is under way any more


def test_restart(spark, catalog):
    j = spark.createDataFrame([(1, "running", None), (2, "completed", None)], "id int, status string, error_message string")
    a, b = jobs.reconcile_after_restart(j, catalog)
    assert {r.id: r.status for r in a.collect()} == {1: "failed", 2: "completed"}
    assert {r.id: r.status for r in b.collect()} == {1: "analyzed", 2: "pending", 3: "analyzed", 4: "failed", 5: "pending"}


TURN = "conv_id bigint, turn bigint, message string, action string, query string, llm_video_ids array<int>, ui_video_ids array<int>, selected_index int, n_results int, clarification string"


def some_turns(seed=1):
    r = random.Random(seed)
    rows = []
    for c in range(8):
        for t in range(12):
            action = r.choice(["new_search", "refine_search", "refine_search", "select_result", "clarify"])
            ids = lambda: r.choice([[], [], r.sample(range(6), r.randint(1, 3))])
            rows.append((c, t, f"message {t}" * r.randint(1, 9), action, f"q{c}-{t}", ids(), ids(), r.choice([None, 0, 1, 3, 9]), r.randint(0, 5), r.choice([None, "which?"])))
    return rows


def folded(rows):
    out, state = [], {}
    for row in sorted(rows, key=lambda x: (x[0], x[1])):
        turn = dict(zip([f.split()[0] for f in TURN.split(", ")], row))
        now, shown, action = conversations.next_state(state.get(row[0], (None, [], None, "", 0)), turn)
        state[row[0]] = now
        out.append((row[0], row[1], action, now[0], now[1], shown, now[2], now[3]))
    return out


def test_conversations(spark, folder):
    rows = some_turns()
    df = spark.createDataFrame(rows, TURN)
    want = folded(rows)
    assert sorted(map(tuple, conversations.conversation_scopes(df.repartition(3)).collect())) == want
    assert all(len(x[7]) <= 800 for x in want) and any(len(x[7]) == 800 for x in want)
    for n in range(3):
        df.where((F.col("turn") >= 4 * n) & (F.col("turn") < 4 * n + 4)).coalesce(1).write.mode("append").parquet(f"{folder}/turns")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/turns")
    run_stream(conversations.conversation_stream(stream), folder, "append", "turn_rows")
    got = sorted(map(tuple, spark.table("turn_rows").collect()))
    assert got == want


def test_scope_rules(spark):
    rows = [(1, 0, "m", "new_search", "q", [1, 2], [], None, 3, None), (1, 1, "m", "refine_search", "q", [], [2, 3], None, 3, None), (1, 2, "m", "refine_search", "q", [9], [2, 3], None, 3, None), (1, 3, "m", "select_result", "q", [], [], 7, 0, None), (1, 4, "m", "new_search", "q", [], [], None, 3, None)]
    out = conversations.conversation_scopes(spark.createDataFrame(rows, TURN)).orderBy("turn").collect()
    assert [x.scope for x in out] == [[1, 2], [2], [2, 3], [2, 3], []] and out[3].shown_scope == []
    chosen = conversations.select_result(spark.createDataFrame([(1, 1, 2), (1, 2, 9)], "conv_id bigint, turn bigint, selected_index int"), spark.createDataFrame([(1, 2, 77)], "conv_id bigint, rank int, segment_id int"))
    assert sorted((x.turn, x.segment_id, x.is_valid) for x in chosen.collect()) == [(1, 77, True), (2, None, False)]
    r = spark.range(1).select(conversations.reply_text(F.lit(0), F.lit(True)), conversations.reply_text(F.lit(2), F.lit(False)), conversations.reply_text(F.lit(2), F.lit(True))).first()
    assert r[0] == conversations.NOTHING_FOUND and r[1] == conversations.UNSURE + r[2] and "2" in r[2]


def test_table_streams(spark, folder):
    rows = spark.createDataFrame([(1, 1, 0.0, "abcd", "", ""), (2, 2, 0.0, "bcd", "", "")], "id int, video_id int, start_sec double, transcript string, visual_description string, ocr_text string")
    content = schemas.with_content(rows)
    content.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(content.schema).parquet(f"{folder}/in")
    grow_index(stream, f"{folder}/idx", f"{folder}/ck1").awaitTermination(120)
    assert {r.gram for r in spark.read.parquet(f"{folder}/idx").where("array_contains(ids, 1)").collect()} >= {"abc", "bcd"}
    tables.write_segments(content.withColumn("transcript", F.lit("old")), f"{folder}/seg")
    swap_analyses(stream.where("video_id = 1"), f"{folder}/seg", f"{folder}/ck2").awaitTermination(120)
    assert {r.video_id: r.transcript for r in read_snapshot(spark, f"{folder}/seg").collect()} == {1: "abcd", 2: "old"}
    log = spark.createDataFrame([("2026-01-01T10:00:00", 0.5), ("2026-01-01T12:00:00", None), ("2026-01-03T00:00:00", 1.0)], "created_at string, cost_usd double")
    assert sorted((r.searches, r.cost_usd) for r in log_windows(log).collect()) == [(1, 1.0), (2, 0.5)]
    log.coalesce(1).write.parquet(f"{folder}/log")
    run_stream(log_windows(spark.readStream.schema(log.schema).parquet(f"{folder}/log")), folder, "append", "log_rows")
    assert [(r.searches, r.cost_usd) for r in spark.table("log_rows").collect()] == [(2, 0.5)]


def test_each_row_is_asked_once(spark, tmp_path):
    """Models that answer differently each time: no row is lost, doubled or asked again by another reader of the result."""
    import uuid

    def asked(kind):
        return len(list(tmp_path.glob(f"{kind}-*")))

    def note(kind, rows):
        for _ in rows:
            (tmp_path / f"{kind}-{uuid.uuid4().hex}").touch()

    def flaky(rows):
        note("document", rows)
        if len(rows) == 1 and asked("document") % 2:
            raise ValueError("no")
        if len(rows) > 1:
            raise ValueError("one by one")
        return [{"document_json": '{"doc_type": "sop", "overview": "o"}', "cost_usd": 0.5}]

    def short(rows):
        note("summary", rows)
        return [{"summary": "s", "cost_usd": 0.25} for _ in rows]

    material = spark.createDataFrame([(i, f"m{i}") for i in range(10)], "video_id int, material string").coalesce(1)
    made = models.write_documents(material, flaky, short)
    for _ in range(2):
        rows = made.collect()
        assert sorted(r.video_id for r in rows) == list(range(10))
    documents, before = sum(r.document_json is not None for r in rows), asked("summary")
    assert asked("document") == 20 and before == 10 - documents and all(r.summary in ("s", "o") for r in rows)

    def embed(rows):
        note("vector", rows)
        return [{"vector": [float(asked("vector"))], "cost_usd": 1.0} for _ in rows]

    seg = spark.createDataFrame([(1, "a", "b"), (2, "a", None)], "id int, transcript string, ocr_text string")
    out, ledger = models.embed_columns(seg, {"transcript": "tv", "ocr_text": "ov"}, embed)
    assert out.count() == 2 and ledger.count() == 2 and {tuple(r.tv) for r in out.collect()} == {tuple(out.first().tv)} and asked("vector") == 2
    q = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, query string")
    vectors, cost = models.prepare_queries(q, lambda rows: [note("translation", rows) or {"zh": None, "en": None, "cost_usd": 1.0} for r in rows][:len(rows)], embed)
    assert vectors.count() == 2 and cost.count() == 2 and asked("vector") == 4


def test_a_required_clarification_overrides_the_action(spark):
    rows = [(1, '{"action": "new_search", "standalone_query": "q", "requires_clarification": true, "clarification_question": "which?"}'), (2, '{"action": "new_search", "standalone_query": "q", "requires_clarification": false}'), (3, '{"action": "refine_search"}')]
    got = models.parse_intents(spark.createDataFrame(rows, "id int, answer string").withColumn("message", F.lit("m"))).collect()
    assert {r.id: (r.action, r.clarification_question) for r in got} == {1: ("clarify", "which?"), 2: ("new_search", None), 3: ("refine_search", None)}


def test_outcomes_set_the_models(spark):
    from timeloom.sources.schemas import fit, schema_of

    videos = fit(spark.createDataFrame([(1, "old", "s"), (2, "old", "t")], "id int, asr_model string, summary string"), schema_of("videos"))
    outcome = spark.createDataFrame([(1, "analyzed", "2024-01-01", 3, 0.5, "a", "v", "e", None)], "id int, status string, analyzed_at string, segment_count int, cost_usd double, asr_model string, vlm_model string, embedding_model string, summary string")
    outcome = outcome.withColumns({c: F.lit(None).cast("string") for c in ("summary_model", "document_json", "document_type", "document_model")} | {"stopped_by_budget": F.lit(False), "failed_scenes": F.lit(0)})
    got = {r.id: (r.asr_model, r.vlm_model, r.embedding_model, r.summary) for r in catalogue.apply_outcomes(videos, outcome).collect()}
    assert got == {1: ("a", "v", "e", "s"), 2: ("old", None, None, "t")}
