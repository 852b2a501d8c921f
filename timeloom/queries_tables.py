"""More queries over whole tables: reading and writing, catalogue, models, streams and plans. `queries` registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.catalogue import OTHER_TOPIC, TOPICS, best_thumbnail, catalogue_items, chat_cost, embedding_cost, is_video_url, speech_cost
from .functions.text import dominant_word
from .operators import catalogue, coverage, dense, evaluation, material, models, quality, sparse, timeline
from .operators.trigrams import read_index
from .plans.hybrid import hybrid_search
from .plans.segments import build_segments
from .queries import EVAL, HITS, HYBRID, LINE, ORACLE, PAIRS, SEG, SPLIT, STATS, STEPS, VID, _document, _fusion_inputs, _round, _scaled, query, turns_of
from .sources import adapters
from .sources.adapters import segments, table, vectors, videos
from .sources.golden import read_golden_set
from .sources.schemas import align_columns, schema_of
from .sources.snapshots import commit, compact, read_snapshot
from .sources.tables import append_search_log, read_reports, replace_partition, scan_ocr_events, scan_segments, shared_path, stage, write_report, write_segments
from .sources.vectors import decode_vec, encode_vec, read_documents, uncovered_items
from .streaming.conversations import ASK_WHICH, conversation_scopes, reply_text, select_result
from .streaming.jobs import reconcile_after_restart
from .streaming.tables import compact_index, grow_index, swap_analyses

# ---- reading and writing


@query(f"WITH {VID} SELECT id, title, NULL::VARCHAR AS source_url, CAST(duration_sec AS INT) AS duration_sec, status, round(cost_usd, 2) AS cost_usd, NULL::VARCHAR AS asr_model FROM vi")
def aligned_videos(spark, d):
    """Videos in the schema of their table: columns that it lacks go, and missing ones are null."""
    found, _ = align_columns(videos(spark, d).withColumn("extra", F.lit(1)), schema_of("videos"))
    return _round(found.select("id", "title", "source_url", "duration_sec", "status", "cost_usd", "asr_model"), "cost_usd", digits=2)


@query(f"WITH {SEG} SELECT id, video_id, start_sec::DOUBLE AS start_sec FROM seg WHERE video_id IN (1, 3)")
def segments_in_scope(spark, d):
    return scan_segments(segments(spark, d), [1, 3]).select("id", "video_id", F.col("start_sec").cast("double").alias("start_sec"))


@query(f"WITH {LINE} SELECT event_id AS id, video_id FROM tl WHERE video_id % 3 = 0")
def text_events_in_scope(spark, d):
    """Events of every third user, as text events; None as scope is all of them."""
    t = adapters.timeline(spark, d).select(F.col("event_id").alias("id"), "video_id", "start_sec")
    return scan_ocr_events(t.where("video_id % 3 = 0")).select("id", "video_id")


@query("SELECT md5(text) AS query, round(length(text) / 100.0, 4) AS cost_usd FROM conversations WHERE role = 'user'")
def logged_searches(spark, d):
    """Users' turns as searches, appended to a log in two parts."""
    path = shared_path(spark, "log")
    c = table(spark, d, "conversations").where("role = 'user'").select("turn", F.md5("text").alias("query"), (F.length("text") / 100.0).alias("cost_usd"))
    for part in ("turn % 2 = 0", "turn % 2 <> 0"):
        append_search_log(c.where(part), path)
    return _round(spark.read.parquet(path).where("created_at is not null").select("query", "cost_usd"), "cost_usd", digits=4)


@query(
    """SELECT 'b' || item_id AS id, item_id % 3 <> 0 AS is_answerable, CASE WHEN item_id % 3 <> 0 THEN CAST(item_id % 7 AS INT) END AS video_id,
 CASE WHEN item_id % 3 <> 0 THEN (item_id % 60) * 60 + item_id % 50 + 0.5 END::DOUBLE AS start_sec, CASE WHEN item_id % 3 <> 0 THEN (item_id % 60) * 60 + item_id % 50 + 7.5 END::DOUBLE AS end_sec FROM benchmark"""
)
def golden_set(spark, d):
    """benchmark as a golden set: written as CSV, and read as queries and answers with their times."""
    i = F.col("item_id")
    stamp = lambda more: F.format_string("%02d:%s", i % 60, (i % 50 + more).cast("string"))
    has = i % 3 != 0
    rows = table(spark, d, "benchmark").select(
        F.concat(F.lit("b"), i.cast("string")).alias("id"),
        F.md5("text").alias("query"),
        F.lit("kind").alias("query_type"),
        F.when(has, " TRUE ").otherwise("false").alias("is_answerable"),
        F.when(has, (i % 7).cast("string")).alias("expected_video_id"),
        F.when(has, stamp(0.5)).alias("expected_start"),
        F.when(has, stamp(7.5)).alias("expected_end"),
        F.lit("y").alias("confirmed"),
        F.lit(None).cast("string").alias("notes"),
    )
    path = shared_path(spark, "golden")
    rows.write.csv(path, header=True)
    queries, answers = read_golden_set(spark, path)
    return queries.select("id", "is_answerable").join(answers, "id", "left").select("id", "is_answerable", "video_id", "start_sec", "end_sec")


DOCUMENTS = """dq AS (SELECT conv_id AS video_id, turn // 3 AS s, turn, (length(text) % 500)::DOUBLE AS t, role FROM conversations)"""


def _documents(spark, d):
    """conversations as document JSON: three turns are a section."""
    c = table(spark, d, "conversations")
    step = F.struct((F.length("text") % 500).cast("double").alias("timestamp_sec"), F.col("role").alias("heading"), F.lit("x").alias("detail"))
    steps = c.groupBy("conv_id", F.floor(F.col("turn") / 3).alias("s")).agg(F.array_sort(F.collect_list(F.struct("turn", step.alias("v")))).alias("x"))
    section = F.struct(F.lit("h").alias("heading"), F.transform("x", lambda x: x["v"]).alias("steps"))
    docs = steps.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("s", section.alias("v")))).alias("y"))
    whole = F.struct(F.lit("sop").alias("doc_type"), F.transform("y", lambda x: x["v"]).alias("sections"), F.array(F.lit("a"), F.lit("b")).alias("uncovered"))
    return docs.select(F.col("conv_id").alias("id"), F.to_json(whole).alias("document_json"))


@query(f"WITH {DOCUMENTS} SELECT video_id, dense_rank() OVER (PARTITION BY video_id ORDER BY s) - 1 AS section_idx, row_number() OVER (PARTITION BY video_id, s ORDER BY turn) - 1 AS step_idx, t AS timestamp_sec, role AS heading, 2 AS uncovered_items FROM dq")
def document_steps(spark, d):
    v = _documents(spark, d)
    found = read_documents(v).join(uncovered_items(v), "video_id")
    return found.select("video_id", F.col("section_idx").cast("bigint").alias("section_idx"), F.col("step_idx").cast("bigint").alias("step_idx"), "timestamp_sec", "heading", "uncovered_items")


@query("SELECT vec_id AS id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def packed_vectors(spark, d):
    """Vectors packed as bytes and unpacked again."""
    packed = vectors(spark, d).select("id", encode_vec("vector").alias("p"))
    v = packed.select("id", decode_vec("p").alias("v"))
    return v.select("id", F.size("v").cast("bigint").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(
    f"""WITH {SEG}, r AS (SELECT id, video_id, CASE WHEN video_id IN (0, 2) THEN 'new' WHEN id % 5 = 0 THEN NULL ELSE nullif(transcript, '') END AS transcript FROM seg WHERE video_id NOT IN (0, 2) OR id % 2 = 0)
SELECT video_id, count(*) AS n, count(transcript) AS texts, count(*) FILTER (transcript = 'new') AS new FROM r GROUP BY 1"""
)
def replaced_segments(spark, d):
    """Segments written by video; those of two videos give way to every second one of them with another text."""
    path = shared_path(spark, "segments")
    s = segments(spark, d).select("id", "video_id", "transcript", F.lit("").alias("visual_description"))
    write_segments(s.withColumn("transcript", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("transcript"))), path)
    replace_partition(s.where("video_id in (0, 2) and id % 2 = 0").withColumn("transcript", F.lit("new")), path)
    return read_snapshot(spark, path).groupBy("video_id").agg(F.count("*").alias("n"), F.count("transcript").alias("texts"), F.count_if(F.col("transcript") == "new").alias("new"))


@query(f"WITH {SEG} SELECT 1 AS version, video_id, count(*) AS n FROM seg GROUP BY 2 UNION ALL SELECT 3, video_id, count(*) FILTER (video_id <> 3 OR id % 2 = 0) + count(*) FILTER (video_id = 4) FROM seg WHERE video_id <> 1 GROUP BY 2 HAVING count(*) FILTER (video_id <> 3 OR id % 2 = 0) > 0")
def segment_versions(spark, d):
    """A table of segments before and after two steps, put together: one source has a new analysis without segments, another one with half of them; a third one
    gets all of its segments once more, twice asked for. The old version can still be read."""
    path = shared_path(spark, "segments")
    s = segments(spark, d).select("id", "video_id", "transcript")
    write_segments(s, path)
    replace_partition(s.where("video_id = 3 and id % 2 = 0"), path, keys=s.where("video_id in (1, 3)"))
    for _ in range(2):
        commit(s.where("video_id = 4"), path, "video_id", batch="once")
    compact(spark, path)
    n = lambda v, name: read_snapshot(spark, path, v).groupBy("video_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("version"), "video_id", "n")
    return n(1, 1).unionByName(n(None, 3))


@query("SELECT 'by_lang' AS run, lang AS name, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'by_source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY 2")
def kept_reports(spark, d):
    """Two reports, each in a folder of its own, read together."""
    path = shared_path(spark, "reports")
    for c in ("lang", "source"):
        write_report(table(spark, d, "documents").where(f"{c} is not null").groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")), path, f"by_{c}")
    return read_reports(spark, path).select("run", "name", "n")


# ---- catalogue and jobs


@query(f"WITH {VID} SELECT id, status FROM vi WHERE status IN ('failed', 'analyzed')")
def videos_by_status(spark, d):
    v = videos(spark, d)
    return catalogue.by_status(v, "failed").select("id", "status").union(catalogue.analyzed(v).select("id", "status"))


JOB = """jo AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'download' ELSE 'analysis' END AS job_type, o_custkey AS video_id, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'queued' ELSE 'completed' END AS status FROM orders)"""


def _jobs(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("completed")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "download").otherwise("analysis")
    return o.select(F.col("o_orderkey").alias("id"), kind.alias("job_type"), F.col("o_custkey").alias("video_id"), status.alias("status"), F.lit(None).cast("string").alias("error_message"), F.col("o_orderdate").cast("string").alias("created_at"))


@query(f"WITH {JOB} SELECT 'listed' AS list, id FROM jo WHERE job_type = 'download' AND status = 'running' UNION ALL SELECT 'active', id FROM jo WHERE status IN ('queued', 'running')")
def listed_jobs(spark, d):
    j = _jobs(spark, d)
    return catalogue.list_jobs(j, job_type="download", status="running").select(F.lit("listed").alias("list"), "id").union(catalogue.active_jobs(j).select(F.lit("active"), "id"))


@query(f"WITH {VID} SELECT c_custkey AS video_id FROM customer WHERE c_custkey IN (SELECT id FROM vi WHERE status = 'analyzed')")
def valid_scopes(spark, d):
    """Of all customers' numbers those that are analysed videos."""
    return catalogue.valid_scope(table(spark, d, "customer").select(F.col("c_custkey").alias("video_id")), videos(spark, d)).select("video_id")


@query(
    f"""WITH {VID}, fl AS (SELECT CAST(substr(source, 4) AS INT) AS id, bool_or(coalesce(text, '') <> '') AS t, bool_or(lang = 'de') AS v FROM documents GROUP BY 1)
SELECT id, status, coalesce(t, false) AS has_transcript, coalesce(v, false) AS has_visual, false AS has_ocr FROM vi LEFT JOIN fl USING (id)"""
)
def public_videos(spark, d):
    s = segments(spark, d).withColumn("visual_description", F.when(F.col("lang") == "de", "x").otherwise(""))
    v = catalogue.video_view(videos(spark, d).withColumn("file_path", F.lit("/secret")), catalogue.modality_flags(s))
    return v.select("id", "status", *[c for c in ("has_transcript", "has_visual", "has_ocr", "file_path") if c in v.columns])


@query(f"WITH {VID}, {JOB} SELECT 'videos' AS name, id FROM vi WHERE status <> 'failed' UNION ALL SELECT 'jobs', jo.id FROM jo WHERE video_id NOT IN (SELECT id FROM vi WHERE status = 'failed')")
def cascaded(spark, d):
    """Videos and jobs without the failed videos and what belongs to them."""
    v = videos(spark, d)
    left = catalogue.cascade_delete({"videos": v, "jobs": _jobs(spark, d)}, v.where("status = 'failed'").select(F.col("id").alias("video_id")))
    return left["videos"].select(F.lit("videos").alias("name"), "id").union(left["jobs"].select(F.lit("jobs"), "id"))


@query(f"WITH {VID} SELECT id, CASE WHEN id % 4 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN id % 4 <> 0 THEN analyzed_at END AS analyzed_at, CASE WHEN id % 4 <> 0 THEN round(cost_usd, 2) END AS cost_usd FROM vi")
def reset_catalogue(spark, d):
    v = videos(spark, d)
    out = catalogue.reset_videos(v, v.where("id % 4 = 0").select(F.col("id").alias("video_id")))
    return _round(out.select("id", "status", "analyzed_at", "cost_usd"), "cost_usd", digits=2)


@query(
    f"""WITH {VID} SELECT id, CASE WHEN id % 3 = 0 THEN 'analyzed' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN 'asr' END AS asr_model, CASE WHEN id % 3 = 0 THEN 'emb' END AS embedding_model, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'new' ELSE title END AS summary,
 CASE WHEN id % 3 = 0 THEN round(id / 10.0, 2) ELSE round(cost_usd, 2) END AS cost_usd, CASE WHEN id % 3 <> 0 THEN NULL WHEN id % 4 = 0 AND id % 5 > 0 THEN 'stopped by budget; ' || id % 5 || ' failed scenes' WHEN id % 4 = 0 THEN 'stopped by budget' WHEN id % 5 > 0 THEN id % 5 || ' failed scenes' END AS pipeline_stage FROM vi"""
)
def applied_outcomes(spark, d):
    """Outcomes of every third video, half of them with a new summary."""
    text = lambda c: F.lit(None).cast("string").alias(c)
    v = videos(spark, d).withColumn("summary", F.col("title"))
    v = align_columns(v, schema_of("videos"))[0]
    i = F.col("id")
    o = v.where("id % 3 = 0").select("id", F.lit("analyzed").alias("status"), F.lit("2024-01-01").alias("analyzed_at"), F.lit(1).alias("segment_count"), (i / 10.0).alias("cost_usd"), F.lit("asr").alias("asr_model"), F.lit("vlm").alias("vlm_model"), F.lit("emb").alias("embedding_model"), F.when(i % 2 == 0, "new").alias("summary"), text("summary_model"), text("document_json"), text("document_type"), text("document_model"), (i % 4 == 0).alias("stopped_by_budget"), (i % 5).alias("failed_scenes"))
    out = catalogue.apply_outcomes(v, o)
    return _round(out.select("id", "status", "asr_model", "embedding_model", "summary", "cost_usd", "pipeline_stage"), "cost_usd", digits=2)


def _score_sql(words: tuple[str, ...]) -> str:
    return " + ".join(f"3 * contains(lower(title), '{w}')::INT + contains(lower(summary), '{w}')::INT" for w in words)


@query(
    "WITH v AS (SELECT text || CASE doc_id % 5 WHEN 0 THEN ' Python 教學' WHEN 1 THEN ' music travel' WHEN 2 THEN ' recipe' ELSE '' END AS title, CASE WHEN doc_id % 7 = 0 THEN '物理 化學 music' ELSE '' END AS summary FROM documents WHERE text IS NOT NULL),\n"
    + "s AS (SELECT "
    + ", ".join(f"{_score_sql(w)} AS s{i}" for i, w in enumerate(TOPICS.values()))
    + " FROM v), g AS (SELECT *, greatest("
    + ", ".join(f"s{i}" for i in range(len(TOPICS)))
    + f") AS g FROM s) SELECT CASE WHEN g = 0 THEN '{OTHER_TOPIC}' "
    + " ".join(f"WHEN s{i} = g THEN '{t}'" for i, t in enumerate(TOPICS))
    + " END AS category, count(*) AS n FROM g GROUP BY 1"
)
def topic_counts(spark, d):
    """Documents as videos by the library's own topics, with a few words that these know put after their texts."""
    i = F.col("doc_id")
    title = F.concat("text", F.when(i % 5 == 0, " Python 教學").when(i % 5 == 1, " music travel").when(i % 5 == 2, " recipe").otherwise(""))
    v = table(spark, d, "documents").where("text is not null").select(title.alias("title"), F.when(i % 7 == 0, "物理 化學 music").alias("summary"), F.lit("analyzed").alias("status"))
    return catalogue.category_counts(v, "analyzed")


@query("SELECT CAST(page_id AS VARCHAR) AS video_id, CASE WHEN page_id % 3 = 0 THEN '（無標題）' ELSE url END AS title, CASE WHEN page_id % 2 = 0 THEN 'https://www.youtube.com/watch?v=' || page_id ELSE url END AS url, '' AS description, CASE WHEN page_id % 5 > 0 THEN CAST(floor(page_id % 5 * 61.7) AS INT) END AS duration_sec, CASE WHEN page_id % 4 = 0 THEN 'c' ELSE 'u' END AS channel, page_id AS view_count FROM pages")
def found_items(spark, d):
    """pages as flat search items with gaps."""
    i = F.col("page_id")
    raw = table(spark, d, "pages").select(i.cast("string").alias("id"), F.when(i % 3 == 0, "").otherwise(F.col("url")).alias("title"), F.when(i % 2 != 0, F.col("url")).alias("url"), F.lit(None).cast("string").alias("description"), (i % 5 * 61.7).alias("duration"), F.when(i % 4 == 0, "c").otherwise("").alias("channel"), F.lit("u").alias("uploader"), i.alias("view_count"))
    return catalogue_items(raw)


@query("SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 6 = 0 THEN 'https://i.ytimg.com/vi/' || page_id || '/hqdefault.jpg' WHEN page_id % 4 <> 0 AND 4 * (page_id % 3) > 3 * (page_id % 5) THEN 'b' ELSE 'a' END AS url FROM pages")
def thumbnails(spark, d):
    i = F.col("page_id").cast("int")
    entry = lambda u, w, h: F.struct(u.alias("url"), w.cast("int").alias("width"), h.cast("int").alias("height"))
    two = F.array(entry(F.lit("a"), i % 5, F.lit(3)), entry(F.when(i % 4 == 0, "").otherwise("b"), F.lit(4), i % 3))
    return best_thumbnail(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.when(i % 6 != 0, two).alias("thumbnails")))


@query("SELECT page_id, page_id % 4 <> 3 AS is_video FROM pages")
def video_urls(spark, d):
    """Addresses made from the pages' numbers: three forms of a video's, and the page's own."""
    i = F.col("page_id")
    n = i.cast("string")
    url = F.when(i % 4 == 0, F.concat(F.lit(" https://youtu.be/"), n)).when(i % 4 == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), n)).when(i % 4 == 2, F.concat(F.lit("youtube.com/shorts/"), n)).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", is_video_url(url).alias("is_video"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round((event_id % 1000) * 0.15 + coalesce(CASE WHEN event_id % 2 = 0 THEN event_id % 700 END, 0) * 0.6, 6) END AS chat, CASE WHEN event_id % 3 <> 0 THEN 'no price for other' END AS error, round((event_id % 1000) * 0.02, 6) AS embedding, round(value / 60 * 0.006, 8) AS speech FROM events"""
)
def model_costs(spark, d):
    """Costs in millionths of a dollar, of speech in dollars."""
    i = F.col("event_id").cast("int")
    usage = table(spark, d, "events").select("event_id", "value", F.when(i % 3 == 0, "gpt-4o-mini").otherwise("other").alias("model"), (i % 1000).alias("prompt_tokens"), F.when(i % 2 == 0, i % 700).alias("completion_tokens"))
    out = chat_cost(usage)
    return out.select("event_id", F.round(F.col("cost_usd") * 1e6, 6).alias("chat"), "error", F.round(embedding_cost(F.col("prompt_tokens")) * 1e6, 6).alias("embedding"), F.round(speech_cost(F.col("value")), 8).alias("speech"))


@query(f"WITH {VID}, {JOB} SELECT 'video' AS kind, id, CASE WHEN status = 'analyzing' AND analyzed_at IS NOT NULL THEN 'analyzed' WHEN status = 'analyzing' THEN 'pending' ELSE status END AS status, NULL::VARCHAR AS error FROM vi UNION ALL SELECT 'job', id, CASE WHEN status = 'running' THEN 'failed' ELSE status END, CASE WHEN status = 'running' THEN 'interrupted by a restart' END FROM jo")
def after_restart(spark, d):
    j, v = reconcile_after_restart(_jobs(spark, d), videos(spark, d).withColumn("pipeline_stage", F.lit("busy")))
    return v.select(F.lit("video").alias("kind"), "id", "status", F.lit(None).cast("string").alias("error")).union(j.select(F.lit("job"), "id", "status", "error_message"))


# ---- timeline and texts

RUNS = """f AS (SELECT *, CASE WHEN word IS DISTINCT FROM lag(word) OVER w OR scene_idx = min(scene_idx) OVER (PARTITION BY video_id) THEN 1 ELSE 0 END AS c FROM tl WINDOW w AS (PARTITION BY video_id ORDER BY scene_idx)),
r AS (SELECT *, sum(c) OVER (PARTITION BY video_id ORDER BY scene_idx) AS run FROM f), n AS (SELECT *, count(*) OVER (PARTITION BY video_id, run) AS run_length FROM r)"""


@query(f"WITH {LINE}, {RUNS} SELECT video_id, scene_idx, value > 0.7 AS hallucinated, run_length >= 3 AS is_repetitive, CASE WHEN NOT value > 0.7 AND run_length < 3 THEN word END AS index_transcript FROM n")
def index_transcripts(spark, d):
    """Event types as transcripts, without those of long runs and of high no-speech figures."""
    t = adapters.timeline(spark, d).withColumns({"transcript": F.col("word"), "no_speech_prob": F.col("value")})
    out = timeline.transcript_for_index(timeline.repetitive_transcripts(t))
    return out.select("video_id", F.col("scene_idx").cast("bigint").alias("scene_idx"), timeline.is_hallucinated(F.col("no_speech_prob")).alias("hallucinated"), "is_repetitive", "index_transcript")


@query(
    """WITH t AS (SELECT doc_id, CAST(substr(source, 4) AS INT) AS video_id, lower(text || CASE WHEN doc_id % 4 > 0 THEN repeat(' ' || lang, CAST(length(text) // 4 AS INT)) ELSE '' END) AS x FROM documents),
w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(string_split_regex(x, '\\s+'), lambda v: v <> '') AS l FROM t)),
c AS (SELECT doc_id, word, count(*) AS n, min(i) AS i FROM w GROUP BY 1, 2),
b AS (SELECT doc_id, CASE WHEN n / sum(n) OVER (PARTITION BY doc_id) >= 0.5 THEN word END AS word FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1),
j AS (SELECT t.doc_id, video_id, word FROM t LEFT JOIN b USING (doc_id)),
f AS (SELECT *, CASE WHEN word IS NULL OR word IS DISTINCT FROM lag(word) OVER (PARTITION BY video_id ORDER BY doc_id) THEN 1 ELSE 0 END AS c FROM j),
r AS (SELECT *, sum(c) OVER (PARTITION BY video_id ORDER BY doc_id) AS run FROM f)
SELECT doc_id, word IS NOT NULL AND count(*) OVER (PARTITION BY video_id, run) >= 3 AS is_repetitive FROM r"""
)
def repetitive_texts(spark, d):
    """Whole documents by source as transcripts; three of four say their language's code so often that it makes up half of the words."""
    s = segments(spark, d)
    more = F.when(F.col("id") % 4 > 0, F.repeat(F.concat(F.lit(" "), "lang"), (F.length("transcript") / 4).cast("int"))).otherwise("")
    scenes = s.select("video_id", F.col("id").alias("scene_idx"), F.concat("transcript", more).alias("transcript"))
    return timeline.repetitive_transcripts(scenes).select(F.col("scene_idx").alias("doc_id"), "is_repetitive")


@query("SELECT doc_id AS id FROM documents WHERE coalesce(CASE WHEN lang = 'de' THEN text END, '') = ''")
def text_gaps(spark, d):
    return timeline.ocr_gap(segments(spark, d).withColumn("ocr_text", F.when(F.col("lang") == "de", F.col("transcript")))).select("id")


@query(f"WITH {LINE} SELECT video_id, scene_idx, CASE WHEN scene_idx % 2 = 0 THEN word ELSE '' END AS visual_description, CASE WHEN scene_idx % 2 = 0 THEN scene_idx ELSE 0 END AS frames FROM tl")
def scenes_with_output(spark, d):
    """Every second scene has a model's output."""
    t = adapters.timeline(spark, d)
    o = t.where("scene_idx % 2 = 0").select("video_id", "scene_idx", F.col("word").alias("visual_description"), F.lit(None).cast("string").alias("ocr_text"), F.col("scene_idx").alias("vlm_frame_count"))
    out = timeline.attach_model_output(t, o)
    return out.select("video_id", F.col("scene_idx").cast("bigint").alias("scene_idx"), "visual_description", F.col("vlm_frame_count").cast("bigint").alias("frames"))


@query(f"WITH {LINE}, v AS (SELECT video_id, max(end_sec) AS dur FROM tl GROUP BY 1) SELECT v.video_id, round(coalesce(start_sec, 0), 4) AS start_sec, round(coalesce(end_sec, dur), 4) AS end_sec FROM v LEFT JOIN (SELECT * FROM tl WHERE video_id % 3 <> 0) t USING (video_id)")
def whole_videos(spark, d):
    """Every third user has no cuts."""
    t = adapters.timeline(spark, d)
    v = t.groupBy("video_id").agg(F.max("end_sec").alias("duration_sec"))
    return _round(timeline.scene_ranges(t.where("video_id % 3 <> 0").select("video_id", "start_sec", "end_sec"), v), "start_sec", "end_sec", digits=4)


@query(
    f"""WITH RECURSIVE {LINE}, z AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_sec) AS i, start_sec / 1000 AS a, end_sec / 1000 AS b FROM tl),
f AS (SELECT video_id, i, a AS oa, b, b - a >= 8 AS done FROM z WHERE i = 1
 UNION ALL SELECT z.video_id, z.i, CASE WHEN f.done THEN z.a ELSE f.oa END, z.b, z.b - CASE WHEN f.done THEN z.a ELSE f.oa END >= 8 FROM f JOIN z ON z.video_id = f.video_id AND z.i = f.i + 1),
e AS (SELECT video_id, min(oa) AS first, max(b) AS last, count(*) FILTER (done) AS n FROM f GROUP BY 1), m AS (SELECT video_id, oa, b, row_number() OVER (PARTITION BY video_id ORDER BY i DESC) AS r FROM f WHERE done)
SELECT video_id, round(oa, 5) AS start_sec, round(CASE WHEN r = 1 THEN last ELSE b END, 5) AS end_sec FROM m JOIN e USING (video_id) UNION ALL SELECT video_id, round(first, 5), round(last, 5) FROM e WHERE n = 0"""
)
def scenes_merged(spark, d):
    """Every merged scene of scenes of a thousandth of the events' length."""
    return _round(timeline.merge_short(_scaled(spark, d)), "start_sec", "end_sec", digits=5)


@query(f"WITH {SPLIT}, p AS (SELECT *, unnest(range(n)) AS i FROM n) SELECT video_id, round(a + i * (len / n), 5) AS start_sec, round(CASE WHEN n = 1 THEN b ELSE a + (i + 1) * (len / n) END, 5) AS end_sec, round(len, 5) AS source_raw_duration FROM p")
def scenes_split(spark, d):
    """Every piece of scenes of a thousandth of the events' length."""
    return _round(timeline.split_long(_scaled(spark, d)), "start_sec", "end_sec", "source_raw_duration", digits=5)


@query(
    f"""WITH {LINE}, {RUNS}
SELECT video_id, dense_rank() OVER (PARTITION BY video_id ORDER BY scene_idx) - 1 AS scene, word AS transcript, CASE WHEN NOT value > 0.7 AND run_length < 3 THEN word END AS index_transcript, CASE WHEN scene_idx % 2 = 0 THEN word END AS visual_description, round(value, 6) AS no_speech_prob FROM n"""
)
def built_segments(spark, d):
    """Each user's events as cuts of ten seconds, with an utterance in each and a model's output for every second one."""
    t = adapters.timeline(spark, d).withColumn("_n", F.row_number().over(adapters.Window.partitionBy("video_id").orderBy("scene_idx")) - 1)
    at = F.col("_n") * 10.0
    t = t.select("video_id", "scene_idx", "_n", "word", "value", at.alias("start_sec"), (at + 10).alias("end_sec"))
    cuts = t.select("video_id", "start_sec", "end_sec")
    u = t.select("video_id", (F.col("start_sec") + 1).alias("start_sec"), (F.col("end_sec") - 1).alias("end_sec"), F.col("word").alias("text"), F.col("value").alias("no_speech_prob"), F.col("value").alias("avg_logprob"), F.col("value").alias("compression_ratio"))
    o = t.where("scene_idx % 2 = 0").select("video_id", F.col("_n").alias("scene_idx"), F.col("word").alias("visual_description"), F.lit("").alias("ocr_text"), F.lit(3).alias("vlm_frame_count"))
    out = build_segments(cuts, t.groupBy("video_id").agg(F.max("end_sec").alias("duration_sec")), u, o)
    return _round(out.select("video_id", F.col("scene_idx").cast("bigint").alias("scene"), "transcript", "index_transcript", "visual_description", "no_speech_prob"), "no_speech_prob")


@query("WITH n AS (SELECT CAST(substr(source, 4) AS INT) AS video_id, lang AS text, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) SELECT video_id, text FROM n QUALIFY sum(n) OVER (PARTITION BY video_id) >= 8 AND n / sum(n) OVER (PARTITION BY video_id) > 0.15")
def watermark_texts(spark, d):
    """Languages as on-screen texts: those on more than 15 % of a source's segments."""
    return material.watermarks(segments(spark, d).withColumn("ocr_text", F.col("lang")))


@query(
    """WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''), 1) AS i FROM conversations),
c AS (SELECT conv_id, turn, word, count(*) AS n, min(i) AS i FROM w GROUP BY 1, 2, 3)
SELECT conv_id, turn, word, round(n / sum(n) OVER (PARTITION BY conv_id, turn), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, i) = 1"""
)
def dominant_words(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", dominant_word(F.col("text")).alias("w")).where("w.word is not null")
    return c.select("conv_id", "turn", "w.word", F.round("w.share", 6).alias("share"))


@query(f"WITH {STEPS} SELECT li.video_id, line_sec FROM li WHERE EXISTS (SELECT 1 FROM ga WHERE ga.video_id = li.video_id AND b - a > 30 AND line_sec BETWEEN a AND b)")
def lines_in_closed_gaps(spark, d):
    steps, lines, _ = _document(spark, d)
    return coverage.lines_in_gaps(lines, coverage.step_gaps(steps, lines).where("b - a > 30"), closed=True).select("video_id", "line_sec")


@query(f"WITH c AS ({ORACLE['document_coverage']}) SELECT count(*) AS videos, count(*) FILTER (material_coverage >= 0.9) AS well_covered, count(*) FILTER (gaps_over_limit = 0) AS without_gap, CAST(sum(over_length) AS BIGINT) AS over_length, CAST(sum(off_grid) AS BIGINT) AS off_grid, CAST(sum(steps) AS BIGINT) AS steps FROM c")
def coverage_totals(spark, d):
    return coverage.coverage_summary(coverage.document_coverage(*_document(spark, d)))


@query(f"WITH {STEPS} SELECT vi.video_id, coalesce(n, 0) AS n_lines, f AS first_sec, l AS last_sec, CAST(floor(l * 0.9) AS BIGINT) AS tail_sec, (SELECT count(*) FROM li WHERE li.video_id = vi.video_id AND line_sec > 300) AS late FROM vi LEFT JOIN bo USING (video_id)")
def material_ends(spark, d):
    """Bounds of each document's lines, and how many come after five minutes."""
    _, lines, about = _document(spark, d)
    late = material.material_after(lines, 300).groupBy("video_id").agg(F.count("*").alias("late"))
    return material.material_bounds(lines, about).join(late, "video_id", "left").withColumn("late", F.coalesce("late", F.lit(0)))


@query(f"WITH {SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, id) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM seg) SELECT 'summary' AS input, id FROM n WHERE r <= 20 UNION ALL SELECT 'document', id FROM n WHERE n <= 100")
def model_inputs(spark, d):
    """The first twenty segments of each source for its summary, and all of sources of at most a hundred for its document."""
    s = segments(spark, d)
    whole, _ = material.document_input(s, 100)
    return material.summary_input(s, 20).select(F.lit("summary").alias("input"), "id").union(whole.select(F.lit("document"), "id"))


_EXTRA = "text || CASE WHEN doc_id % 3 = 0 THEN '一名作業員彎腰' WHEN doc_id % 3 = 1 THEN '站' ELSE '' END"


@query(
    f"SELECT lang, CAST(grouping(lang) AS BIGINT) AS grouping_level, count(*) AS n, round(avg((doc_id % 3 = 0)::INT), 4) AS person_rate, round(avg((doc_id % 3 < 2)::INT), 4) AS posture_rate, round(avg(length({_EXTRA})), 1) AS avg_length FROM documents WHERE {_EXTRA} <> '' GROUP BY GROUPING SETS ((), (lang))"
)
def extra_rates(spark, d):
    """Rates of people and postures in texts that name some."""
    i = F.col("doc_id")
    text = F.concat("text", F.when(i % 3 == 0, "一名作業員彎腰").when(i % 3 == 1, "站").otherwise(""))
    out = quality.description_quality(table(spark, d, "documents").withColumn("t", text), [(), ("lang",)], "t", quality.EXTRA_RATES)
    return out.withColumn("grouping_level", F.col("grouping_level").cast("bigint"))


# ---- search

SHORT = [(1, "thing 77", None), (2, "wzqqv ment", [0, 1, 2, 3]), (3, "of 42", [1, 4])]
SHORT_SQL = f"""{SEG}, t AS (SELECT * FROM (VALUES (1, 'thing', NULL::INT[]), (1, '77', NULL), (2, 'wzqqv', [0, 1, 2, 3]), (2, 'ment', [0, 1, 2, 3]), (3, 'of', [1, 4]), (3, '42', [1, 4])) AS v(query_id, term, scope)), {HITS}, {STATS},
df AS (SELECT query_id, term, count(*)::DOUBLE AS n FROM hits WHERE length(term) >= 3 GROUP BY 1, 2),
scores AS (SELECT h.query_id, h.id, round(-sum(ln(1.0 + (n_docs - n + 0.5) / (n + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score FROM hits h JOIN df USING (query_id, term) JOIN stats USING (query_id) GROUP BY 1, 2),
lt AS (SELECT query_id, scope, unnest(list_transform(range(1, length(term)), lambda i: substr(term, i, 2))) AS term FROM t ANTI JOIN hits USING (query_id, term) WHERE length(term) >= 3 UNION SELECT query_id, scope, term FROM t WHERE length(term) < 3),
lh AS (SELECT lt.query_id, lt.term, s.id FROM lt JOIN seg s ON (lt.scope IS NULL OR list_contains(lt.scope, s.video_id)) AND contains(lower(content), lower(lt.term))),
rare AS (SELECT query_id, term FROM lh JOIN stats USING (query_id) GROUP BY query_id, term, n_docs HAVING count(*) <= 0.2 * n_docs),
found AS (SELECT query_id, id, max(score) AS score FROM (SELECT * FROM scores UNION ALL SELECT DISTINCT query_id, id, -1e6 FROM lh SEMI JOIN rare USING (query_id, term)) GROUP BY 1, 2)"""


@query(f"WITH {SHORT_SQL} SELECT query_id, id, round(score, 6) AS score FROM found")
def short_terms(spark, d):
    """The whole keyword channel: long terms, one that doesn't occur and is cut, and short ones that count where they are rare."""
    q = spark.createDataFrame(SHORT, "query_id int, query string, scope array<int>")
    return _round(sparse.sparse_channel(q, segments(spark, d), limit=None), "score")


@query("SELECT item_id AS query_id, md5(v) AS variant FROM (SELECT item_id, text AS v FROM benchmark UNION SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE left(text, 9) END FROM benchmark) WHERE v IS NOT NULL")
def variants_of_queries(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(None).cast("string").alias("zh"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.substring("text", 1, 9)).alias("en"))
    return dense.query_variants(b, "zh", "en").select("query_id", F.md5("variant").alias("variant"))


@query(
    f"""WITH {PAIRS}, v AS (SELECT query_id, video_id, round(max(score), 9) AS score FROM p WHERE id <> query_id AND video_id % 5 <> query_id // 100 % 5 GROUP BY 1, 2),
r AS (SELECT query_id, video_id FROM v WINDOW q AS (PARTITION BY query_id) QUALIFY count(*) OVER q > 1 AND max(score) OVER q >= 0.10 AND score >= max(score) OVER q - 0.15)
SELECT query_id, video_id FROM v SEMI JOIN r USING (query_id, video_id) UNION ALL SELECT query_id, video_id FROM v ANTI JOIN r USING (query_id)"""
)
def prefiltered_sources(spark, d):
    """The labels that are left to each query, without a fifth of them, by how near their vectors are."""
    s = dense.vector_scores(adapters.query_vectors(spark, d), vectors(spark, d).select(F.struct("id", "video_id").alias("key"), "vector"), "key")
    s = s.where("key.id <> query_id and key.video_id % 5 <> floor(query_id / 100) % 5")
    best = stage(s.groupBy("query_id", F.col("key.video_id").alias("video_id")).agg(F.round(F.max("score"), 9).alias("score")))
    return dense.prefilter_videos(best.select("query_id", "video_id"), dense.relevant_videos(best))


@query(f"WITH {VID} SELECT id AS video_id, CASE WHEN id % 3 = 0 THEN 's' || id ELSE title END AS text FROM vi")
def judged_texts(spark, d):
    i = F.col("id")
    v = videos(spark, d).withColumn("summary", F.when(i % 3 == 0, F.concat(F.lit("s"), i.cast("string"))).when(i % 3 == 1, ""))
    return dense.video_texts(v)


@query(
    f"""WITH {PAIRS}, e AS (SELECT query_id, id - 1 AS segment_id, max(score) AS event FROM p WHERE id % 4 = 1 GROUP BY 1, 2),
m AS (SELECT query_id, id, CASE WHEN id % 3 = 0 THEN score END AS t, CASE WHEN id % 3 = 1 THEN score END AS v FROM p WHERE id % 3 <> 2),
j AS (SELECT coalesce(m.query_id, e.query_id) AS query_id, coalesce(m.id, e.segment_id) AS id, t, v, event FROM m FULL JOIN e ON m.query_id = e.query_id AND m.id = e.segment_id)
SELECT query_id, id, round(t, 6) AS transcript_score, round(v, 6) AS visual_score, round(event, 6) AS ocr_score, round(greatest(t, v, event), 6) AS similarity FROM j SEMI JOIN (SELECT vec_id AS id FROM embeddings) USING (id)"""
)
def dense_modalities(spark, d):
    """Vectors of two modalities, a third of the segments without any, and text events that raise a neighbour's score."""
    v = vectors(spark, d)
    i = F.col("id")
    s = v.select("id", F.when(i % 3 == 0, F.col("vector")).alias("transcript_embedding"), F.when(i % 3 == 1, F.col("vector")).alias("visual_embedding"), F.lit(None).cast("array<float>").alias("ocr_embedding"))
    e = v.where("id % 4 = 1").select((i - 1).alias("segment_id"), F.col("vector").alias("embedding"))
    out = dense.dense_channel(adapters.query_vectors(spark, d), s, e)
    return _round(out, "transcript_score", "visual_score", "ocr_score", "similarity")


_FREE = "t AS (SELECT * FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0), (VALUES ('thing', NULL::INT[]), ('ment', NULL)) AS v(term, scope))"
_SCOPED = "t AS (SELECT query_id, term, CASE WHEN query_id % 200 = 0 THEN [0, 1, 2]::INT[] END AS scope FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0), (VALUES ('thing'), ('ment')) AS v(term))"
assert _FREE in HYBRID


@query(
    f"""WITH {HYBRID.replace(_FREE, _SCOPED).replace("FROM p JOIN seg s ON s.id = p.id", "FROM p JOIN seg s ON s.id = p.id WHERE p.query_id % 200 <> 0 OR s.video_id IN (0, 1, 2)")}, {VID},
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, video_id, start_sec, id) AS rank FROM ranked WHERE similarity >= 0.1 AND fusion_score >= 0.1)
SELECT query_id, rank, best.id AS segment_id, coalesce(title, '未知影片') AS video_title, md5(seg.transcript) AS description, round(fusion_score, 6) AS fusion_score FROM best JOIN seg ON seg.id = best.id LEFT JOIN vi ON vi.id = best.video_id WHERE rank <= 20"""
)
def hybrid_in_scopes(spark, d):
    """Half of the queries in a scope of three sources; results with their titles and descriptions, which fall back to the transcript."""
    q, _, whole = _fusion_inputs(spark, d)
    q = q.withColumn("scope", F.when(F.col("query_id") % 200 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))))
    results, _ = hybrid_search(q, adapters.query_vectors(spark, d), whole, videos(spark, d), min_similarity=0.1, bm25_limit=None)
    return _round(results.select("query_id", "rank", "segment_id", "video_title", F.md5("description").alias("description"), "fusion_score"), "fusion_score")


@query(f"WITH {EVAL} SELECT round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS no_answer_precision FROM (SELECT count(*) FILTER (NOT is_answerable AND NOT conf) AS tp, count(*) FILTER (is_answerable AND NOT conf) AS fp FROM e)")
def no_answer_precision(spark, d):
    from .queries import _evaluated

    return _round(evaluation.no_answer_f1(_evaluated(spark, d)).select("no_answer_precision"), "no_answer_precision")


# ---- conversations

HISTORY = f"""t AS (SELECT *, length(text) AS n, CASE role WHEN 'system' THEN 'new_search' WHEN 'user' THEN 'refine_search' ELSE 'select_result' END AS action, CASE WHEN bool_or(role <> 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 5 ELSE 0 END AS results FROM conversations),
x AS (SELECT conv_id, turn, '- 使用者：「' || text || '」→ ' || action || '：' || CASE WHEN role <> 'assistant' THEN md5(text) WHEN n % 8 BETWEEN 1 AND results THEN '已選取第 ' || n % 8 || ' 段' ELSE '{ASK_WHICH}' END AS line FROM t)"""


@query(f"WITH {HISTORY} SELECT conv_id, turn, md5(right(string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 800)) AS history FROM x")
def conversation_histories(spark, d):
    """The history after every turn: what was said, done and answered, its last 800 characters."""
    return conversation_scopes(turns_of(spark, d)).select("conv_id", "turn", F.md5("history").alias("history"))


@query("WITH r AS (SELECT conv_id, turn + 1 AS k, length(text) AS segment_id FROM conversations), t AS (SELECT conv_id, turn, length(text) % 8 AS k FROM conversations) SELECT t.conv_id, t.turn, segment_id, segment_id IS NOT NULL AS is_valid FROM t LEFT JOIN r ON r.conv_id = t.conv_id AND r.k = t.k")
def selected_results(spark, d):
    """Each turn chooses one of its conversation's results; results are numbered by turn."""
    c = table(spark, d, "conversations")
    results = c.select("conv_id", (F.col("turn") + 1).cast("int").alias("rank"), F.length("text").cast("bigint").alias("segment_id"))
    return select_result(turns_of(spark, d).select("conv_id", "turn", "selected_index"), results).select("conv_id", "turn", "segment_id", "is_valid")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '沒有找到足夠相關的片段，可以換個描述方式，或改用人物、動作、物件名稱再試一次。' ELSE CASE WHEN event_id % 3 = 0 THEN '' ELSE '目前搜尋結果的把握度較低，' END || '找到 ' || event_id % 4 || ' 個相關片段。' END AS reply FROM events")
def replies(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", reply_text(i % 4, i % 3 == 0).alias("reply"))


# ---- models: batch functions that stand in for them


def _length_vectors(rows: list[dict]) -> list[dict]:
    return [{"vector": [float(len(r["text"])), 1.0], "cost_usd": 0.5} for r in rows]


def _first_letters(rows: list[dict]) -> list[dict]:
    return [{"zh": r["query"][:5], "en": None, "cost_usd": 1.0} for r in rows]


def _write_some(rows: list[dict]) -> list[dict]:
    if any(r["material"][0] in "0123" for r in rows):
        raise ValueError("no document")
    return [{"document_json": '{"doc_type": "sop", "overview": "%s"}' % r["material"][:4], "cost_usd": 2.0} for r in rows]


def _summarise_some(rows: list[dict]) -> list[dict]:
    if any(r["material"][0] == "0" for r in rows):
        raise ValueError("no summary")
    return [{"summary": "s" + r["material"][:3], "cost_usd": 1.0} for r in rows]


@query("SELECT doc_id AS id, CASE WHEN coalesce(text, '') <> '' THEN length(text)::DOUBLE END AS transcript, CASE WHEN coalesce(lang, '') <> '' THEN length(lang)::DOUBLE END AS ocr FROM documents")
def embedded_texts(spark, d):
    """Texts and languages through the model seam, each different text once; a vector begins with the text's length."""
    out, _ = models.embed_columns(segments(spark, d).select("id", "transcript", F.col("lang").alias("ocr_text")), {"transcript": "t", "ocr_text": "o"}, _length_vectors)
    return out.select("id", F.get("t", F.lit(0)).cast("double").alias("transcript"), F.get("o", F.lit(0)).cast("double").alias("ocr"))


@query("SELECT item_id AS query_id, v AS variant, length(v)::DOUBLE AS n, cost AS cost_usd FROM (SELECT item_id, md5(text) AS v, 2.0::DOUBLE AS cost FROM benchmark UNION ALL SELECT item_id, left(md5(text), 5), 2.0 FROM benchmark)")
def prepared_queries(spark, d):
    """Queries, their translations and vectors, and what each query costs."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.md5("text").alias("query"))
    vec, cost = models.prepare_queries(q, _first_letters, _length_vectors)
    return vec.join(cost, "query_id").select("query_id", "variant", F.get("vector", F.lit(0)).cast("double").alias("n"), "cost_usd")


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 OR role = 'assistant' THEN 'new_search' WHEN turn % 3 = 0 THEN 'clarify' ELSE 'refine_search' END AS action, CASE WHEN turn % 5 = 4 OR role = 'assistant' OR turn % 2 = 0 THEN md5(text) ELSE 'q' || turn END AS standalone_query, CASE WHEN turn % 5 <> 4 AND role <> 'assistant' THEN CAST(turn AS INT) END AS selected_index FROM conversations"""
)
def parsed_intents(spark, d):
    """Models' answers: some not JSON, some with an unknown action, some that require a clarification, some without a query."""
    t = F.col("turn")
    answer = F.to_json(F.struct(F.when(F.col("role") == "assistant", "dance").otherwise("refine_search").alias("action"), F.when(t % 2 == 0, "  ").otherwise(F.concat(F.lit("q"), t.cast("string"))).alias("standalone_query"), (t % 3 == 0).alias("requires_clarification"), t.cast("int").alias("selected_result_index")))
    c = table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("message"), F.when(t % 5 == 4, "no json {").otherwise(answer).alias("answer"))
    return models.parse_intents(c).select("conv_id", "turn", "action", "standalone_query", "selected_index")


@query(
    """WITH m AS (SELECT doc_id AS video_id, md5(coalesce(text, '')) AS m FROM documents)
SELECT video_id, CASE WHEN m >= '4' THEN 'sop' END AS document_type, CASE WHEN m >= '4' THEN left(m, 4) WHEN m >= '1' THEN 's' || left(m, 3) END AS summary, CASE WHEN m < '1' THEN 'ValueError: no summary' END AS error, CASE WHEN m >= '4' THEN 2.0 WHEN m >= '1' THEN 1.0 ELSE 0.0 END::DOUBLE AS cost_usd FROM m"""
)
def written_documents(spark, d):
    """Documents, or summaries where no document can be had, or the error where neither can."""
    m = table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.md5(F.coalesce("text", F.lit(""))).alias("material"))
    return models.write_documents(m, _write_some, _summarise_some).select("video_id", "document_type", "summary", "error", "cost_usd")


# ---- streams that end when their input is read


GRAMS = "WITH g AS (SELECT page_id, unnest(list_distinct(list_transform(range(1, length(url) - 1), lambda i: substr(lower(url), i, 3)))) AS gram FROM pages) SELECT gram, count(*) AS n FROM g GROUP BY 1"


def _grown(spark, d):
    """A trigram index of the pages' addresses that a stream has written, in two parts: its place."""
    source, path = shared_path(spark, "source"), shared_path(spark, "index")
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit(0).alias("video_id"), F.col("url").alias("content"))
    for part in ("id % 2 = 0", "id % 2 <> 0"):
        rows.where(part).write.mode("append").parquet(source)
        grow_index(spark.readStream.schema(rows.schema).parquet(source), path, f"{path}-progress").awaitTermination()
    return path


@query(GRAMS)
def grown_index(spark, d):
    return read_index(spark, _grown(spark, d)).groupBy("gram").agg(F.sum(F.size("ids")).alias("n"))


@query(GRAMS)
def compacted_index(spark, d):
    """The stream's index after its rows were put together: each gram and block of ids once."""
    index = compact_index(spark, _grown(spark, d), shared_path(spark, "compact"))
    once = index.groupBy("gram", "block").agg(F.count("*").alias("rows"), F.sum(F.size("ids")).alias("n")).where("rows = 1")
    return once.groupBy("gram").agg(F.sum("n").alias("n"))


@query(f"WITH {SEG} SELECT video_id, count(*) AS n, count(*) FILTER (video_id IN (1, 4)) AS swapped FROM seg WHERE video_id NOT IN (1, 4) OR id % 3 = 0 GROUP BY 1")
def swapped_analyses(spark, d):
    """Segments of two sources that a stream has replaced by a third of them."""
    source, path = shared_path(spark, "source"), shared_path(spark, "segments")
    rows = segments(spark, d).select("id", "video_id", F.lit(False).alias("swapped"))
    write_segments(rows, path)
    new = rows.where("video_id in (1, 4) and id % 3 = 0").withColumn("swapped", F.lit(True))
    new.write.parquet(source)
    swap_analyses(spark.readStream.schema(new.schema).parquet(source), path, shared_path(spark, "progress")).awaitTermination()
    return read_snapshot(spark, path).groupBy("video_id").agg(F.count("*").alias("n"), F.count_if("swapped").alias("swapped"))
