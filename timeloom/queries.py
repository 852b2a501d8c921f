"""The queries over whole tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.catalogue import is_video_url, topic
from .functions.scoring import cosine, hit_source_label, temporal_iou
from .functions.text import append_history, bigrams, clean_text, contains_ci, dominant_word, extract_terms, negative_text, positive_text, strip_generic_terms
from .functions.times import format_timestamp, probe_times, sample_times
from .operators import catalogue, coverage, dense, evaluation, fusion, material, pruned, quality, sparse, timeline, trigrams
from .operators.scopes import scoped_rows
from .plans.hybrid import hybrid_search
from .sources import adapters
from .sources.adapters import segments, table, vectors, videos
from .sources.schemas import reconcile
from .sources.tables import shared_path, stage
from .streaming.conversations import conversation_scopes, history
from .streaming.jobs import job_state
from .streaming.tables import log_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- keyword channel

SEG = """seg AS (SELECT doc_id AS id, CAST(substr(source, 4) AS INT) AS video_id, (doc_id % 500) * 12.0 AS start_sec,
  coalesce(text, '') || '  ' AS content, text AS transcript, lang FROM documents)"""
ASKED = [(1, "thing tion", None), (2, "ment eaux", None), (3, "keit zu", [0, 3, 5]), (4, "zzqqx of", [1, 2, 4]), (5, "rrr", [])]
TERMS = """t AS (SELECT * FROM (VALUES (1, 'thing', NULL::INT[]), (1, 'tion', NULL), (2, 'ment', NULL), (2, 'eaux', NULL),
  (3, 'keit', [0, 3, 5]), (3, 'zu', [0, 3, 5]), (4, 'zzqqx', [1, 2, 4]), (4, 'of', [1, 2, 4]), (5, 'rrr', [])) AS v(query_id, term, scope))"""
HITS = """hits AS (SELECT t.query_id, t.term, s.id, length(content)::DOUBLE AS len,
  (length(content) - length(replace(lower(content), lower(term), '')))::DOUBLE / greatest(length(term), 1) AS tf
  FROM t JOIN seg s ON (t.scope IS NULL OR list_contains(t.scope, s.video_id)) AND contains(lower(content), lower(term)))"""
STATS = """stats AS (SELECT q.query_id, count(s.id)::DOUBLE AS n_docs, greatest(coalesce(avg(length(content)), 1), 1)::DOUBLE AS avg_len
  FROM (SELECT DISTINCT query_id, scope FROM t) q LEFT JOIN seg s ON q.scope IS NULL OR list_contains(q.scope, s.video_id) GROUP BY 1)"""
SCORES = f"""WITH {SEG}, {TERMS}, {HITS}, {STATS}, df AS (SELECT query_id, term, count(*)::DOUBLE AS n FROM hits GROUP BY 1, 2),
scores AS (SELECT h.query_id, h.id, round(-sum(ln(1.0 + (n_docs - n + 0.5) / (n + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
  FROM hits h JOIN df USING (query_id, term) JOIN stats USING (query_id) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS r FROM scores)"""


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string, scope array<int>")


@query(SCORES + " SELECT query_id, id, round(score, 6) AS score FROM ranked WHERE r <= 200")
def bm25_topk(spark, d):
    """The 200 best segments of each query, whole corpus and scopes alike."""
    return _round(sparse.bm25(sparse.query_terms(asked(spark)), segments(spark, d)), "score")


@query(SCORES + " SELECT query_id, count(*) AS n, round(sum(score), 4) AS total, round(min(score), 6) AS best FROM scores GROUP BY 1")
def bm25_all(spark, d):
    """All scores, uncapped, summed up by query."""
    found = sparse.bm25(sparse.query_terms(asked(spark)), segments(spark, d), limit=None)
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.round(F.min("score"), 6).alias("best"))


@query(f"WITH {SEG}, {TERMS}, {STATS} SELECT query_id, n_docs, round(avg_len, 6) AS avg_len FROM stats")
def corpus_stats(spark, d):
    return _round(sparse.corpus_stats(asked(spark), segments(spark, d)), "avg_len")


@query(f"WITH {SEG}, {TERMS}, {HITS} SELECT t.query_id, t.term, count(h.id) AS n_hits FROM t LEFT JOIN hits h USING (query_id, term) GROUP BY 1, 2")
def doc_freq(spark, d):
    terms = sparse.query_terms(asked(spark))
    return sparse.doc_freq(terms, sparse.term_hits(terms, segments(spark, d)))


@query(f"WITH {SEG}, {TERMS}, {HITS} SELECT query_id, term, id FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY id) <= 200")
def like_hits(spark, d):
    return sparse.like_hits(sparse.query_terms(asked(spark)), segments(spark, d), limit=200)


@query(
    f"""WITH {SEG}, {TERMS}, {HITS}, known AS (SELECT DISTINCT query_id, term FROM hits)
SELECT query_id, term, 'bm25' AS channel FROM t SEMI JOIN known USING (query_id, term) WHERE length(term) >= 3
UNION SELECT query_id, unnest(list_transform(range(1, length(term)), lambda i: substr(term, i, 2))), 'like' FROM t ANTI JOIN known USING (query_id, term) WHERE length(term) >= 3
UNION SELECT query_id, term, 'like' FROM t WHERE length(term) < 3"""
)
def term_routing(spark, d):
    return sparse.route_terms(sparse.query_terms(asked(spark)), segments(spark, d)).select("query_id", "term", "channel")


@query(f"WITH {SEG}, {TERMS}, {HITS} SELECT query_id, term, id FROM hits WHERE length(term) >= 3")
def trigram_lookup(spark, d):
    """By a stored index of trigrams."""
    s, path = segments(spark, d), shared_path(spark, "index")
    trigrams.write_index(trigrams.build_trigram_index(s), path)
    return trigrams.trigram_lookup(sparse.query_terms(asked(spark)), trigrams.read_index(spark, path), s).select("query_id", "term", "id")


MANY = "SELECT DISTINCT substr(word, 1, 4) AS term FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE length(word) >= 4"


@query(f"""WITH {SEG}, t AS ({MANY}) SELECT term, count(*) AS n_hits, CAST(sum((length(content) - length(replace(lower(content), term, ''))) // length(term)) AS BIGINT) AS n FROM t JOIN seg ON contains(lower(content), term) GROUP BY 1""")
def many_terms(spark, d):
    """How often the segments hold each beginning of a word of the benchmark, all looked for in one pass."""
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w") >= 4)
    terms = words.select(F.substring("w", 1, 4).alias("term")).distinct().select(F.lit(1).alias("query_id"), "term", F.lit(None).cast("array<int>").alias("scope"))
    hits = sparse.term_hits(terms, segments(spark, d))
    return hits.groupBy("term").agg(F.count("*").alias("n_hits"), F.sum("tf").cast("bigint").alias("n"))


NEGATIVE = [(1, "ment，不要theof", None), (2, "tion，沒有zuzu。並非eaux", [0, 1, 2, 3])]


@query(
    f"""WITH {SEG}, t AS (SELECT * FROM (VALUES (1, 'theof', NULL::INT[]), (2, 'zuzu', [0, 1, 2, 3]), (2, 'eaux', [0, 1, 2, 3])) AS v(query_id, term, scope)),
bad AS (SELECT DISTINCT query_id, id FROM t JOIN seg s ON (scope IS NULL OR list_contains(scope, video_id)) AND contains(lower(content), term)),
cand AS (SELECT query_id, id FROM (SELECT DISTINCT query_id, scope FROM t) q JOIN seg s ON scope IS NULL OR list_contains(scope, video_id))
SELECT query_id, id FROM cand ANTI JOIN bad USING (query_id, id)"""
)
def negation_exclude(spark, d):
    """The candidates that no negated term finds, without a limit; all of these terms occur."""
    q = spark.createDataFrame(NEGATIVE, "query_id int, query string, scope array<int>")
    s = segments(spark, d)
    candidates = scoped_rows(q, s.select("id", "video_id")).select("query_id", "id")
    return sparse.exclude_negated(q, s, candidates)


STOP = "[A-Za-z0-9的了在是這那個有跟和與上中一準備出現連續喊著地正要，。！？、\\s]+"


@query(
    f"""WITH w AS (SELECT item_id, list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(text, '[A-Za-z0-9]+'), string_split_regex(text, '{STOP}')), lambda x: length(x) >= 2))) AS l FROM benchmark)
SELECT item_id, len(l) AS n, array_to_string(l, ' ') AS terms FROM w"""
)
def extract_terms_of(spark, d):
    terms = F.array_sort(extract_terms(F.col("text")))
    return table(spark, d, "benchmark").select("item_id", F.size(terms).cast("bigint").alias("n"), F.array_join(terms, " ").alias("terms"))


@query("SELECT doc_id, trim(text) || ' ' AS positive, lang AS negative, len(list_distinct(list_transform(range(1, length(lang)), lambda i: substr(lang, i, 2)))) AS pieces FROM documents")
def split_negation(spark, d):
    """Every document with a negated language code after its text: what is positive, what is negative, and that code's pieces."""
    q = F.concat(F.trim("text"), F.lit("段落"), F.lit("不要"), F.col("lang"))
    cleaned = strip_generic_terms(q)
    blank = F.repeat(F.lit(" "), F.length("lang") + 2)
    positive = F.replace(positive_text(cleaned), blank, F.lit(" "))
    return table(spark, d, "documents").select("doc_id", positive.alias("positive"), negative_text(cleaned).alias("negative"), F.size(bigrams(F.col("lang"))).cast("bigint").alias("pieces"))


# ---- vector channel

COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
PAIRS = f"""p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label AS video_id, {COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)"""


@query(f"WITH {PAIRS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, id, round(score, 6) AS score FROM p QUALIFY rank <= 10")
def cosine_topk(spark, d):
    return _round(dense.cosine_topk(adapters.query_vectors(spark, d), vectors(spark, d), 10), "score")


@query(
    f"""WITH p AS (SELECT a.label AS query_id, b.vec_id AS id, max({COS}) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, id, round(score, 6) AS score FROM p QUALIFY rank <= 15"""
)
def dense_multi_variant(spark, d):
    """Queries of several variants: the vectors of one label among every fiftieth."""
    q = vectors(spark, d).where("id % 50 = 0").select(F.col("video_id").alias("query_id"), F.col("id").alias("variant"), "vector")
    return _round(dense.cosine_topk(q, vectors(spark, d), 15), "score")


@query(
    f"""WITH {PAIRS}, v AS (SELECT query_id, video_id, round(max(score), 9) AS score FROM p WHERE id <> query_id GROUP BY 1, 2)
SELECT query_id, video_id FROM v WINDOW q AS (PARTITION BY query_id) QUALIFY count(*) OVER q > 1 AND max(score) OVER q >= 0.10 AND score >= max(score) OVER q - 0.15"""
)
def relevant_sources(spark, d):
    """For each query the labels whose best other vector is near the best of all."""
    return dense.relevant_of_vectors(adapters.query_vectors(spark, d), vectors(spark, d))


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS id, round({COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0")
def cosine_native(spark, d):
    """Scores of candidates from an equi-join, without Python."""
    v = vectors(spark, d)
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "video_id", "vector")
    return _round(dense.scores_in_videos(q, v), "score")


# ---- fusion: embeddings and documents of one id are one segment

FUSED = f"""{SEG}, {PAIRS}, t AS (SELECT * FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0), (VALUES ('thing', NULL::INT[]), ('ment', NULL)) AS v(term, scope)),
{HITS}, {STATS}, df AS (SELECT query_id, term, count(*)::DOUBLE AS n FROM hits GROUP BY 1, 2),
sparse0 AS (SELECT h.query_id, h.id, round(-sum(ln(1.0 + (n_docs - n + 0.5) / (n + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
  FROM hits h JOIN df USING (query_id, term) JOIN stats USING (query_id) GROUP BY 1, 2),
scored AS (SELECT p.query_id, p.id, s.video_id, s.start_sec, p.score AS similarity FROM p JOIN seg s ON s.id = p.id),
sparse1 AS (SELECT s.* FROM sparse0 s SEMI JOIN scored USING (query_id, id)),
sr AS (SELECT query_id, id, rank() OVER (PARTITION BY query_id ORDER BY score) + (count(*) OVER (PARTITION BY query_id, score) - 1) / 2.0 AS sparse_rank FROM sparse1),
fused AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY similarity DESC, video_id, start_sec, s.id) AS dense_rank, sparse_rank FROM scored s LEFT JOIN sr ON sr.query_id = s.query_id AND sr.id = s.id),
ranked AS (SELECT *, 1.0 / (5 + dense_rank) + coalesce(1.0 / (5 + sparse_rank), 0) AS fusion_score FROM fused)"""


def _fusion_inputs(spark, d):
    s = segments(spark, d)
    e = vectors(spark, d).select("id", "vector")
    queries = adapters.query_vectors(spark, d).select("query_id", F.lit("thing ment").alias("query"), F.lit(None).cast("array<int>").alias("scope"))
    none = F.lit(None).cast("array<float>")
    whole = s.join(e, "id").withColumns({"transcript_embedding": F.col("vector"), "visual_embedding": none, "ocr_embedding": none})
    return queries, s, whole


def _fused_inputs(spark, d):
    """The queries with their askers, the rows with a vector, and what the keywords of each asker find among them, by the figures of all documents."""
    queries, s, whole = _fusion_inputs(spark, d)
    asked = pruned.askers(queries, "query", "scope")
    rows = stage(pruned.vector_rows(whole))
    terms = sparse.query_terms(asked.where("query_id = asker"))
    found = sparse.bm25(terms, s, limit=None, hits=stage(sparse.term_hits(terms, s)))
    return asked, rows, found.join(rows.select("id"), "id", "left_semi")


def _fused(spark, d, bound: int):
    """The rows that either channel ranks among the first `bound`, with both ranks and the fused score."""
    asked, rows, found = _fused_inputs(spark, d)
    q = adapters.query_vectors(spark, d)
    first = stage(pruned.best_rows(q, asked, rows, bound))
    return pruned.fused_rows(q, asked, rows, first, found, bound)


@query(f"WITH {FUSED} SELECT query_id, id, dense_rank, sparse_rank, round(fusion_score, 6) AS fusion_score FROM ranked WHERE dense_rank <= 50 OR sparse_rank <= 50")
def rrf_fusion(spark, d):
    """Both ranks and the fused score of the rows that either channel ranks among the first 50."""
    out = _fused(spark, d, 50)
    return _round(out.select("query_id", "id", "dense_rank", "sparse_rank", "fusion_score"), "fusion_score")


@query(f"WITH {FUSED} SELECT query_id, id, dense_rank, sparse_rank, round(fusion_score, 6) AS fusion_score FROM ranked")
def rrf_fusion_all(spark, d):
    """Both ranks and the fused score of all rows."""
    asked, rows, found = _fused_inputs(spark, d)
    out = pruned.all_fused_rows(adapters.query_vectors(spark, d), asked, rows, found)
    return _round(out.select("query_id", "id", "dense_rank", "sparse_rank", "fusion_score"), "fusion_score")


@query(f"""WITH {FUSED}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, video_id, start_sec, id) AS rank FROM ranked WHERE similarity >= 0.05 AND fusion_score >= 0.05)
SELECT query_id, rank, id, round(similarity, 6) AS similarity, round(fusion_score, 6) AS fusion_score FROM best WHERE rank <= 20""")
def rrf_pruned(spark, d):
    """The best 20 of each query, with ranks by counting instead of sorting all rows."""
    out = fusion.top_results(_fused(spark, d, fusion.rank_bound(0.05)), 20, 0.05, 0.05)
    return _round(out.select("query_id", "rank", "id", "similarity", "fusion_score"), "similarity", "fusion_score")


# segments without a vector can't be candidates, but the keyword figures are those of the segments with one
HYBRID = FUSED.replace(SEG, SEG.replace("FROM documents)", "FROM documents SEMI JOIN embeddings ON vec_id = doc_id)"))


@query(f"""WITH {HYBRID}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, video_id, start_sec, id) AS rank FROM ranked WHERE similarity >= 0.1 AND fusion_score >= 0.1)
SELECT query_id, rank, id AS segment_id, video_id, round(similarity, 6) AS similarity, '字幕' AS hit_source, round(fusion_score, 6) AS fusion_score FROM best WHERE rank <= 20""")
def hybrid_search_results(spark, d):
    queries, _, whole = _fusion_inputs(spark, d)
    results, _ = hybrid_search(queries, adapters.query_vectors(spark, d), whole, videos(spark, d), min_similarity=0.1, bm25_limit=None)
    return _round(results.select("query_id", "rank", "segment_id", "video_id", "similarity", "hit_source", "fusion_score"), "similarity", "fusion_score")


@query(f"""WITH {HYBRID}, first AS (SELECT query_id, sparse_rank IS NOT NULL AS is_confident FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, video_id, start_sec, id) = 1),
n AS (SELECT query_id, least(count(*), 20) AS n FROM ranked WHERE similarity >= 0.1 AND fusion_score >= 0.1 GROUP BY 1)
SELECT query_id, coalesce(n, 0) AS n_results, is_confident FROM first LEFT JOIN n USING (query_id)""")
def hybrid_search_summary(spark, d):
    queries, _, whole = _fusion_inputs(spark, d)
    _, summary = hybrid_search(queries, adapters.query_vectors(spark, d), whole, videos(spark, d), min_similarity=0.1, bm25_limit=None)
    return summary.select("query_id", "n_results", "is_confident")


# ---- evaluation: vectors of the query's label are its answers

EVAL = f"""{PAIRS}, r AS (SELECT query_id, id, video_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM p WHERE id <> query_id QUALIFY rank <= 20),
res AS (SELECT *, (id % 50) * 2.0 AS a, (id % 50) * 2.0 + 10 AS b FROM r),
q AS (SELECT vec_id AS query_id, label AS video_id, vec_id % 200 = 0 AS is_answerable FROM embeddings WHERE vec_id % 100 = 0),
m AS (SELECT res.query_id, rank, (least(b, 70) - greatest(a, 20)) / (greatest(b, 70) - least(a, 20)) AS iou FROM res JOIN q ON q.query_id = res.query_id AND q.video_id = res.video_id AND q.is_answerable WHERE a < 70 AND b > 20),
h AS (SELECT query_id, min(rank) AS rank, max(iou) AS iou FROM m GROUP BY 1),
c AS (SELECT query_id, score >= 0.35 AS conf FROM r WHERE rank = 1),
e AS (SELECT q.query_id, is_answerable, coalesce(h.rank <= 1, false) AS r1, coalesce(h.rank <= 5, false) AS r5, coalesce(1.0 / h.rank, 0) AS rr, CASE WHEN h.rank <= 5 THEN 1 / log2(h.rank + 1) ELSE 0 END AS nd, iou, conf FROM q LEFT JOIN h USING (query_id) JOIN c USING (query_id))"""


def _evaluated_parts(spark, d):
    v = vectors(spark, d)
    q = adapters.query_vectors(spark, d)
    top = dense.cosine_topk(q, v, 21).where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    at = (F.col("id") % 50) * 2.0
    results = top.withColumn("rank", rank).where("rank <= 20").join(v.select("id", "video_id"), "id").select("query_id", "rank", "video_id", at.alias("start_sec"), (at + 10).alias("end_sec"), F.col("score").alias("similarity"))
    queries = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), (F.col("id") % 200 == 0).alias("is_answerable"), "video_id")
    answers = queries.where("is_answerable").select("query_id", "video_id", F.lit(20.0).alias("start_sec"), F.lit(70.0).alias("end_sec"))
    summary = results.where("rank = 1").select("query_id", (F.col("similarity") >= 0.35).alias("is_confident"))
    return queries, answers, results, summary


def _evaluated(spark, d):
    return evaluation.evaluate(*_evaluated_parts(spark, d))


@query(
    f"WITH {EVAL} SELECT query_id, is_answerable, CASE WHEN is_answerable THEN r1 END AS recall_at_1, CASE WHEN is_answerable THEN r5 END AS recall_at_5, round(CASE WHEN is_answerable THEN rr END, 6) AS reciprocal_rank, round(CASE WHEN is_answerable THEN nd END, 6) AS ndcg_at_5, round(CASE WHEN is_answerable THEN iou END, 6) AS best_iou, conf AS predicted_answerable FROM e"
)
def golden_per_query(spark, d):
    return _round(_evaluated(spark, d).drop("top1_similarity"), "reciprocal_rank", "ndcg_at_5", "best_iou")


@query(
    f"""WITH {EVAL}, k AS (SELECT count(*) FILTER (NOT is_answerable AND NOT conf) AS tp, count(*) FILTER (is_answerable AND NOT conf) AS fp, count(*) FILTER (NOT is_answerable AND conf) AS fn FROM e),
pr AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM k)
SELECT round(avg(r1::INT), 6) AS recall_at_1, round(avg(r5::INT), 6) AS recall_at_5, round(avg(rr), 6) AS mrr, round(avg(nd), 6) AS ndcg_at_5, round(avg(iou), 6) AS mean_timestamp_iou,
 round(any_value(p), 6) AS no_answer_precision, round(any_value(r), 6) AS no_answer_recall, round(any_value(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS no_answer_f1 FROM e, pr WHERE is_answerable"""
)
def golden_eval(spark, d):
    out = evaluation.aggregate_eval(_evaluated(spark, d))
    return _round(out, *out.columns)


# ---- timeline: events by user

LINE = """tl0 AS (SELECT user_id AS video_id, row_number() OVER w - 1 AS scene_idx, epoch_us(ts) / 1e6 - min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6 AS start_sec, event_type AS word, value, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
tl AS (SELECT * FROM (SELECT *, lead(start_sec) OVER (PARTITION BY video_id ORDER BY ts, event_id) AS end_sec FROM tl0) WHERE end_sec > start_sec)"""


@query(
    f"""WITH {LINE}, f AS (SELECT *, CASE WHEN word IS DISTINCT FROM lag(word) OVER w OR scene_idx = min(scene_idx) OVER (PARTITION BY video_id) THEN 1 ELSE 0 END AS c FROM tl WINDOW w AS (PARTITION BY video_id ORDER BY scene_idx)),
r AS (SELECT *, sum(c) OVER (PARTITION BY video_id ORDER BY scene_idx) AS run FROM f), n AS (SELECT *, count(*) OVER (PARTITION BY video_id, run) AS run_length FROM r)
SELECT video_id, scene_idx, word, run_length FROM n WHERE run_length >= 3"""
)
def repetition_runs(spark, d):
    """Runs of three or more scenes in a row with one event type as their text."""
    t = adapters.timeline(spark, d)
    best = dominant_word(F.col("word"))
    found = timeline.runs(t.withColumn("_d", best), "video_id", ["scene_idx"], F.col("_d.word"), F.col("_d.share") >= 0.5)
    return found.where("in_run").select("video_id", F.col("scene_idx").cast("bigint").alias("scene_idx"), "word", F.col("run_length").cast("bigint").alias("run_length"))


@query(
    f"""WITH {LINE}, s AS (SELECT video_id, k AS scene_idx, k * 21600.0 AS a, (k + 1) * 21600.0 AS b FROM (SELECT DISTINCT video_id FROM tl), range(0, 120) AS g(k))
SELECT s.video_id, s.scene_idx, coalesce(trim(string_agg(word, ' ' ORDER BY start_sec, end_sec)), '') AS transcript, round(avg(value), 6) AS no_speech_prob, max(value) AS compression_ratio
FROM s LEFT JOIN tl ON tl.video_id = s.video_id AND start_sec < b AND end_sec > a GROUP BY 1, 2"""
)
def interval_align(spark, d):
    """The event types that overlap each stretch of six hours of each user."""
    of_user = F.row_number().over(Window.partitionBy("video_id").orderBy("ts", "event_id"))
    t = stage(adapters.timeline(spark, d).select("video_id", "start_sec", "end_sec", "word", "value", (of_user == 1).alias("is_first")))
    scenes = t.where("is_first").select("video_id", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("scene_idx"))
    scenes = scenes.select("video_id", "scene_idx", (F.col("scene_idx") * 21600.0).alias("start_sec"), ((F.col("scene_idx") + 1) * 21600.0).alias("end_sec"))
    u = t.select("video_id", "start_sec", "end_sec", F.col("word").alias("text"), F.col("value").alias("no_speech_prob"), F.col("value").alias("avg_logprob"), F.col("value").alias("compression_ratio"))
    out = timeline.align_transcript(scenes, u, width=21600.0)
    return _round(out.select("video_id", F.col("scene_idx").cast("bigint").alias("scene_idx"), "transcript", "no_speech_prob", "compression_ratio"), "no_speech_prob")


SPLIT = f"""{LINE}, z AS (SELECT video_id, start_sec / 1000 AS a, end_sec / 1000 AS b FROM tl),
n AS (SELECT *, b - a AS len, CASE WHEN b - a <= 12 THEN 1 ELSE greatest(1, least(CAST(round_even((b - a) / 10, 0) AS BIGINT), CAST(floor((b - a) / 8) AS BIGINT))) END AS n FROM z)"""


def _scaled(spark, d):
    return adapters.timeline(spark, d).select("video_id", (F.col("start_sec") / 1000).alias("start_sec"), (F.col("end_sec") / 1000).alias("end_sec"))


@query(f"WITH {SPLIT} SELECT video_id, CAST(sum(n) AS BIGINT) AS pieces, round(min(len / n), 5) AS shortest, round(max(len / n), 5) AS longest, round(sum(len), 4) AS total FROM n GROUP BY 1")
def scene_split(spark, d):
    """Scenes of a thousandth of the events' length, split."""
    out = timeline.split_long(_scaled(spark, d))
    length = F.col("end_sec") - F.col("start_sec")
    return out.groupBy("video_id").agg(F.count("*").alias("pieces"), F.round(F.min(length), 5).alias("shortest"), F.round(F.max(length), 5).alias("longest"), F.round(F.sum(length), 4).alias("total"))


@query(
    f"""WITH RECURSIVE {LINE}, z AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_sec) AS i, start_sec / 1000 AS a, end_sec / 1000 AS b FROM tl),
f AS (SELECT video_id, i, a AS oa, b, b - a >= 8 AS done FROM z WHERE i = 1
 UNION ALL SELECT z.video_id, z.i, CASE WHEN f.done THEN z.a ELSE f.oa END, z.b, z.b - CASE WHEN f.done THEN z.a ELSE f.oa END >= 8 FROM f JOIN z ON z.video_id = f.video_id AND z.i = f.i + 1)
SELECT video_id, greatest(count(*) FILTER (done), 1) AS scenes, round(min(oa), 5) AS first_sec, round(max(b), 5) AS last_sec FROM f GROUP BY 1"""
)
def scene_merge(spark, d):
    """Scenes of a thousandth of the events' length, merged."""
    out = timeline.merge_short(_scaled(spark, d))
    return out.groupBy("video_id").agg(F.count("*").alias("scenes"), F.round(F.min("start_sec"), 5).alias("first_sec"), F.round(F.max("end_sec"), 5).alias("last_sec"))


@query(
    f"""WITH {LINE}, h AS (SELECT video_id, CAST(floor(start_sec / 86400) AS INT) AS scene_idx, start_sec AS frame_sec, upper(word) AS resolved_text, value AS confidence, event_id FROM tl WHERE value >= 0.3),
g AS (SELECT video_id, scene_idx, resolved_text, min(frame_sec) AS lo, max(frame_sec) AS hi, max(confidence) AS confidence, arg_max(frame_sec, (confidence, -frame_sec)) AS frame_sec FROM h GROUP BY 1, 2, 3)
SELECT video_id, scene_idx, resolved_text, round(greatest(scene_idx * 86400.0, lo - 1), 5) AS start_sec, round(least((scene_idx + 1) * 86400.0, hi + 1), 5) AS end_sec, round(frame_sec, 5) AS frame_sec, confidence FROM g"""
)
def ocr_dedupe(spark, d):
    """Events of one type on one day of a user as one text event; the text in full-width letters, which normalise to capitals."""
    wide = "".join(chr(0xFF21 + i) for i in range(26))
    text = F.translate(F.upper("word"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", wide)
    hits = adapters.timeline(spark, d).select("video_id", F.floor(F.col("start_sec") / 86400).cast("int").alias("scene_idx"), F.col("start_sec").alias("frame_sec"), text.alias("text"), F.col("value").alias("confidence"), F.lit(None).cast("string").alias("bbox"))
    scenes = hits.select("video_id", "scene_idx").distinct().select("*", (F.col("scene_idx") * 86400.0).alias("start_sec"), ((F.col("scene_idx") + 1) * 86400.0).alias("end_sec"))
    out = timeline.merge_ocr(hits, scenes)
    return _round(out.select("video_id", "scene_idx", "resolved_text", "start_sec", "end_sec", "frame_sec", "confidence"), "start_sec", "end_sec", "frame_sec", digits=5)


@query(
    f"""WITH {LINE}, s AS (SELECT video_id, scene_idx, least(5, greatest(1, ceil((end_sec - start_sec) / 2)))::INT AS n, start_sec FROM tl),
e AS (SELECT video_id, scene_idx, unnest(range(n)) AS round, start_sec FROM s)
SELECT video_id, scene_idx, round, round(start_sec + 2 * round, 5) AS at_sec, row_number() OVER (PARTITION BY video_id ORDER BY round, scene_idx) AS position FROM e QUALIFY position <= 101"""
)
def ocr_schedule(spark, d):
    """When to look at which scene, until 100 looks are spent."""
    scenes = adapters.timeline(spark, d).select("video_id", F.col("scene_idx").cast("bigint").alias("scene_idx"), "start_sec", "end_sec")
    out = timeline.ocr_schedule(scenes, budget=100.0)
    return out.select("video_id", "scene_idx", F.col("round").cast("bigint").alias("round"), F.round("at_sec", 5).alias("at_sec"), F.col("position").cast("bigint").alias("position"))


@query(
    """WITH c AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, floor((row_number() OVER w - 1) / 2) AS batch, sum(l_extendedprice) OVER w AS total FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, min(CASE WHEN total > 1000000 THEN batch END) OVER (PARTITION BY l_suppkey) AS over FROM c)
SELECT l_suppkey, count(*) AS items, round(sum(l_extendedprice), 2) AS cost FROM o WHERE over IS NULL OR batch <= over GROUP BY 1"""
)
def budget_cut(spark, d):
    """Each supplier's line items until the batch that goes beyond a million."""
    out = timeline.budget_cut(table(spark, d, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_extendedprice", 1e6)
    return out.groupBy("l_suppkey").agg(F.count("*").alias("items"), F.round(F.sum("l_extendedprice"), 2).alias("cost"))


# ---- hygiene, coverage, quality

LINES = """ln AS (SELECT CAST(substr(source, 4) AS INT) AS video_id, doc_id, trim(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '\\s+', ' ', 'g')) AS line FROM documents),
cl AS (SELECT * FROM ln WHERE line <> '' AND lower(line) NOT IN ('null', 'none', 'n/a', 'na', '無', '-')),
sh AS (SELECT video_id, line AS text, count(*) AS n, sum(count(*)) OVER (PARTITION BY video_id) AS total FROM cl GROUP BY 1, 2)"""


def _lines(spark, d):
    return segments(spark, d).select("video_id", F.explode(F.split(F.coalesce("transcript", F.lit("")), "\n")).alias("line"))


@query(f"WITH {LINES} SELECT video_id, round(CASE WHEN any_value(total) >= 8 THEN max(n) / any_value(total) ELSE 0 END, 6) AS share FROM sh GROUP BY 1")
def dominant_share(spark, d):
    return _round(material.dominant_share(_lines(spark, d), "line"), "share")


@query(f"WITH {LINES} SELECT video_id, text, n, CAST(total AS BIGINT) AS total FROM sh WHERE n >= 3")
def repeated_lines(spark, d):
    """Lines that a source has three times or more: what watermarks and junk come from."""
    return material.text_shares(_lines(spark, d), "line", where=F.col("n") >= 3).select("video_id", "text", "n", "total")


@query(
    """WITH n AS (SELECT CAST(substr(source, 4) AS INT) AS video_id, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT video_id FROM n GROUP BY 1 HAVING sum(n) >= 8 AND max(n) / sum(n) > 0.4"""
)
def junk_sources(spark, d):
    """Sources of which one language has more than two fifths."""
    return material.junk_transcript_videos(segments(spark, d).withColumn("transcript", F.col("lang")))


@query(
    """WITH s AS (SELECT doc_id, CAST(substr(source, 4) AS INT) AS video_id, (doc_id % 500) * 12 AS sec, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT video_id, CAST(sec AS BIGINT) AS line_sec, md5(max('[' || lpad((sec // 60)::VARCHAR, greatest(2, length((sec // 60)::VARCHAR))::INT, '0') || ':' || lpad((sec % 60)::VARCHAR, 2, '0') || '｜' || sec || ' 秒] 字幕：' || t)) AS line FROM s WHERE t <> '' GROUP BY 1, 2"""
)
def material_of_sources(spark, d):
    """The lines of material of every source; where two segments begin in one second, the greater line."""
    lines = material.material_lines(material.build_material(segments(spark, d), include_ocr=True))
    return lines.select("video_id", "line_sec", F.md5("line").alias("line"))

@query(
    """WITH s AS (SELECT doc_id, CAST(substr(source, 4) AS INT) AS video_id, doc_id * 12 AS sec, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT video_id, sec AS line_sec, md5(max('[' || lpad((sec // 60)::VARCHAR, greatest(2, length((sec // 60)::VARCHAR))::INT, '0') || ':' || lpad((sec % 60)::VARCHAR, 2, '0') || '｜' || sec || ' 秒] 字幕：' || t)) AS line FROM s WHERE t <> '' GROUP BY 1, 2"""
)
def material_of_sources_whole(spark, d):
    """The lines of material of every source, where each document begins in a second of its own, so that every text keeps its line."""
    lines = material.material_lines(material.build_material(segments(spark, d, wrap=False), include_ocr=True))
    return lines.select("video_id", "line_sec", F.md5("line").alias("line"))


STEPS = """st AS (SELECT conv_id AS video_id, turn // 3 AS section_idx, turn % 3 AS step_idx, (length(text) * 7 % 900)::DOUBLE AS t FROM conversations WHERE role = 'assistant'),
li AS (SELECT DISTINCT conv_id AS video_id, length(text) * 13 % 700 AS line_sec FROM conversations),
vi AS (SELECT conv_id AS video_id, 600 AS dur, count(*) FILTER (role = 'system') AS unc FROM conversations GROUP BY 1),
bo AS (SELECT video_id, count(*) AS n, min(line_sec) AS f, max(line_sec) AS l FROM li GROUP BY 1),
ed AS (SELECT video_id, t, 1 AS k FROM st SEMI JOIN bo USING (video_id) UNION ALL SELECT video_id, f, 0 FROM bo SEMI JOIN st USING (video_id) UNION ALL SELECT video_id, l, 2 FROM bo SEMI JOIN st USING (video_id)),
ga AS (SELECT * FROM (SELECT video_id, t AS a, lead(t) OVER (PARTITION BY video_id ORDER BY k, t) AS b FROM ed) WHERE b > a)"""


def _document(spark, d):
    """conversations as documents: assistant turns are steps, all turns lines, times from the texts' lengths."""
    c = table(spark, d, "conversations").withColumn("_n", F.length("text"))
    steps = c.where("role = 'assistant'").select(F.col("conv_id").alias("video_id"), F.floor(F.col("turn") / 3).cast("int").alias("section_idx"), (F.col("turn") % 3).cast("int").alias("step_idx"), (F.col("_n") * 7 % 900).cast("double").alias("timestamp_sec"))
    lines = c.select(F.col("conv_id").alias("video_id"), (F.col("_n") * 13 % 700).cast("bigint").alias("line_sec")).distinct()
    about = c.groupBy(F.col("conv_id").alias("video_id")).agg(F.lit(600).alias("duration_sec"), F.count_if(F.col("role") == "system").alias("uncovered_items"))
    return steps, lines, about


@query(f"WITH {STEPS} SELECT video_id, a, b FROM ga")
def step_gaps(spark, d):
    steps, lines, _ = _document(spark, d)
    return coverage.step_gaps(steps, lines)


@query(f"WITH {STEPS} SELECT video_id, count(*) FILTER (t < p) AS backwards FROM (SELECT *, lag(t) OVER (PARTITION BY video_id ORDER BY section_idx, step_idx) AS p FROM st) GROUP BY 1")
def backwards(spark, d):
    return coverage.backwards(_document(spark, d)[0])


@query(
    f"""WITH {STEPS}, so AS (SELECT st.video_id, count(*) AS steps, max(t) AS peak, count(*) FILTER (t > dur / 2) AS h, count(*) FILTER (t > dur * 0.8) AS q, count(*) FILTER (t > dur) AS o FROM st JOIN vi USING (video_id) GROUP BY 1),
gg AS (SELECT video_id, max(b - a) AS mg, count(*) FILTER (b - a > 60) AS gl FROM ga GROUP BY 1),
sk AS (SELECT video_id, count(*) AS sk FROM li WHERE EXISTS (SELECT 1 FROM ga WHERE ga.video_id = li.video_id AND b - a > 60 AND a < line_sec AND line_sec < b) GROUP BY 1),
og AS (SELECT video_id, count(*) AS og FROM st WHERE NOT EXISTS (SELECT 1 FROM li WHERE li.video_id = st.video_id AND li.line_sec = CAST(floor(t) AS BIGINT)) GROUP BY 1),
bk AS (SELECT video_id, count(*) FILTER (t < p) AS bk FROM (SELECT *, lag(t) OVER (PARTITION BY video_id ORDER BY section_idx, step_idx) AS p FROM st) GROUP BY 1)
SELECT vi.video_id, coalesce(steps, 0) AS steps, round(coalesce(peak, 0), 1) AS max_timestamp_sec, coalesce(l, 0)::DOUBLE AS material_end_sec, round(coalesce(peak, 0) / dur, 4) AS coverage, CASE WHEN l > 0 THEN round(coalesce(peak, 0) / l, 4) END AS material_coverage,
 coalesce(h, 0) AS second_half, coalesce(q, 0) AS tail_20, coalesce(o, 0) AS over_length, coalesce(og, 0) AS off_grid, unc AS uncovered_items, round(coalesce(mg, 0), 1) AS max_gap_sec, coalesce(gl, 0) AS gaps_over_limit, CASE WHEN n > 0 THEN round(coalesce(sk, 0) / n, 4) END AS skipped_share, coalesce(bk, 0) AS backwards
FROM vi LEFT JOIN so USING (video_id) LEFT JOIN bo USING (video_id) LEFT JOIN gg USING (video_id) LEFT JOIN sk USING (video_id) LEFT JOIN og USING (video_id) LEFT JOIN bk USING (video_id)"""
)
def document_coverage(spark, d):
    return coverage.document_coverage(*_document(spark, d))


HOLES = f"""{STEPS}, ins AS (SELECT st.* FROM st JOIN bo USING (video_id) WHERE t BETWEEN f AND l),
e2 AS (SELECT video_id, t, 1 AS k FROM ins UNION ALL SELECT video_id, f, 0 FROM bo SEMI JOIN ins USING (video_id) UNION ALL SELECT video_id, l, 2 FROM bo SEMI JOIN ins USING (video_id)),
g2 AS (SELECT * FROM (SELECT video_id, t AS a, lead(t) OVER (PARTITION BY video_id ORDER BY k, t) AS b FROM e2) WHERE b - a > 60),
un AS (SELECT * FROM li WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.video_id = li.video_id AND CAST(floor(t) AS BIGINT) = line_sec)),
ho AS (SELECT DISTINCT video_id, CAST(a AS BIGINT) AS hole_start, CAST(b AS BIGINT) AS hole_end FROM g2 WHERE EXISTS (SELECT 1 FROM un WHERE un.video_id = g2.video_id AND line_sec BETWEEN a AND b))"""


@query(f"WITH {HOLES} SELECT * FROM ho")
def document_holes(spark, d):
    return coverage.document_holes(*_document(spark, d)[:2])


@query(
    f"""WITH {HOLES}, fp AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY hole_end - hole_start DESC, hole_start) AS turn FROM ho WHERE video_id % 4 <> 0 QUALIFY turn <= 5)
SELECT fp.video_id, turn, hole_start, hole_end, count(*) AS n_lines, least(8000, 400 + 80 * count(*)) AS token_budget FROM fp JOIN un ON un.video_id = fp.video_id AND line_sec BETWEEN hole_start AND hole_end GROUP BY 1, 2, 3, 4"""
)
def fill_plan(spark, d):
    """Every fourth document is a log, which isn't filled."""
    steps, lines, about = _document(spark, d)
    documents = about.select("video_id", F.when(F.col("video_id") % 4 == 0, "content_log").otherwise("sop").alias("doc_type"))
    return coverage.fill_plan(documents, coverage.document_holes(steps, lines), lines, steps).withColumn("turn", F.col("turn").cast("bigint"))


@query(
    f"""WITH {HOLES}, s1 AS (SELECT video_id, t, arg_min(section_idx, (section_idx, step_idx)) AS section_idx FROM st GROUP BY 1, 2)
SELECT ho.video_id, hole_start, hole_end, s1.section_idx FROM ho ASOF LEFT JOIN s1 ON ho.video_id = s1.video_id AND ho.hole_start >= s1.t"""
)
def asof_section(spark, d):
    steps, lines, _ = _document(spark, d)
    out = coverage.assign_fill_section(coverage.document_holes(steps, lines), steps)
    return out.withColumn("section_idx", F.col("section_idx").cast("bigint"))


_WORDS = {"vague_rate": ("tion", "schen"), "concrete_rate": ("@", "+1"), "meta_rate": ("|",)}


@query(
    """SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS grouping_level, count(*) AS n, round(avg(length(text)), 1) AS avg_length,
 round(avg((contains(text, 'tion') OR contains(text, 'schen'))::INT), 4) AS vague_rate, round(avg((contains(text, '@') OR contains(text, '+1'))::INT), 4) AS concrete_rate, round(avg(contains(text, '|')::INT), 4) AS meta_rate
FROM documents WHERE coalesce(text, '') <> '' GROUP BY GROUPING SETS ((), (lang), (source))"""
)
def quality_rates(spark, d):
    """Rates of word lists over all documents, by language and by source, in one pass."""
    out = quality.description_quality(table(spark, d, "documents"), [(), ("lang",), ("source",)], "text", _WORDS)
    return out.withColumn("grouping_level", F.col("grouping_level").cast("bigint"))


# ---- catalogue and ledger

VID = """vi AS (SELECT o_orderkey AS id, o_orderpriority || ' ' || o_custkey AS title, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'analyzed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'analyzing' END AS status,
 strftime(o_orderdate, '%Y-%m-%d') AS created_at, CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS analyzed_at, o_orderkey % 100 AS segment_count, o_totalprice AS cost_usd, o_custkey % 5000 AS duration_sec FROM orders)"""


@query(f"WITH {VID} SELECT count(*) FILTER (status = 'pending' OR (status = 'analyzing' AND analyzed_at IS NULL)) AS pending, count(*) FILTER (status = 'analyzed') AS analyzed, CAST(sum(segment_count) FILTER (analyzed_at IS NOT NULL AND status IN ('analyzed', 'analyzing')) AS BIGINT) AS segments, round(sum(cost_usd) FILTER (analyzed_at IS NOT NULL AND status IN ('analyzed', 'analyzing')), 2) AS cost_usd FROM vi")
def header_stats(spark, d):
    return _round(catalogue.header_stats(videos(spark, d)), "cost_usd", digits=2)


@query(f"WITH {VID} SELECT id, status, analyzed_at FROM vi WHERE status IN ('analyzed', 'failed') OR (status = 'analyzing' AND analyzed_at IS NOT NULL)")
def library_list(spark, d):
    return catalogue.library(videos(spark, d)).select("id", "status", "analyzed_at")


@query(f"WITH {VID} SELECT id, created_at FROM vi WHERE status = 'pending' OR (status = 'analyzing' AND analyzed_at IS NULL)")
def unanalyzed_list(spark, d):
    return catalogue.unanalyzed(videos(spark, d)).select("id", "created_at")


@query(f"WITH {VID} SELECT id, title FROM vi WHERE status <> 'failed' AND contains(lower(title), 'urgent') AND duration_sec <= 1000")
def library_search(spark, d):
    v = catalogue.within_duration(catalogue.status_view(videos(spark, d), "analyzed"), 1000)
    return catalogue.matches_library(v, " URGENT ").select("id", "title")


@query(f"WITH {VID} SELECT row_number() OVER (ORDER BY coalesce(analyzed_at, created_at) DESC, id) AS place, id FROM vi QUALIFY place <= 100")
def library_sorted(spark, d):
    """The first hundred in the library's default order, numbered."""
    top = catalogue.library_sort(videos(spark, d)).limit(100)
    return top.select("id", F.coalesce("analyzed_at", "created_at").alias("_a")).select(F.row_number().over(Window.orderBy(F.desc("_a"), "id")).cast("bigint").alias("place"), "id")


@query(f"WITH {VID} SELECT row_number() OVER (ORDER BY coalesce(analyzed_at, created_at) DESC, id) AS place, id FROM vi")
def library_places(spark, d):
    """Every video's place in the library's default order."""
    rows = videos(spark, d).select("id", F.coalesce("analyzed_at", "created_at").alias("_a"))
    return catalogue.places(rows, F.desc("_a"), F.col("id")).select("place", "id")


_TOPICS = {"urgent": ("urgent", "high"), "low": ("low",), "other priority": ("specified", "medium", "11")}


@query(
    f"""WITH {VID}, t AS (SELECT *, 3 * contains(lower(title), 'urgent')::INT + 3 * contains(lower(title), 'high')::INT AS a, 3 * contains(lower(title), 'low')::INT AS b, 3 * contains(lower(title), 'specified')::INT + 3 * contains(lower(title), 'medium')::INT + 3 * contains(lower(title), '11')::INT AS c FROM vi WHERE status <> 'failed')
SELECT CASE WHEN greatest(a, b, c) = 0 THEN 'none' WHEN a >= b AND a >= c THEN 'urgent' WHEN b >= c THEN 'low' ELSE 'other priority' END AS category, count(*) AS n FROM t GROUP BY 1"""
)
def category_counts(spark, d):
    v = catalogue.status_view(videos(spark, d), "analyzed")
    return v.groupBy(topic(F.col("title"), F.col("summary"), _TOPICS, "none").alias("category")).agg(F.count("*").alias("n"))


@query("SELECT CAST(substr(source, 4) AS INT) AS video_id, bool_or(coalesce(text, '') <> '') AS has_transcript, bool_or(lang = 'de') AS has_visual, false AS has_ocr FROM documents GROUP BY 1")
def modality_flags(spark, d):
    s = segments(spark, d).withColumn("visual_description", F.when(F.col("lang") == "de", "x").otherwise(""))
    return catalogue.modality_flags(s)


@query(
    """WITH act AS (SELECT o_custkey AS v FROM orders WHERE o_orderstatus = 'P') SELECT c_custkey AS video_id FROM customer ANTI JOIN act ON v = c_custkey"""
)
def admitted_jobs(spark, d):
    """Requests for an analysis of every customer, without those that have an order under way."""
    jobs = table(spark, d, "orders").select(F.lit("analysis").alias("job_type"), F.col("o_custkey").alias("video_id"), F.lit(None).cast("string").alias("source_url"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"))
    requests = table(spark, d, "customer").select(F.lit("analysis").alias("job_type"), F.col("c_custkey").alias("video_id"), F.lit(None).cast("string").alias("source_url"))
    return catalogue.admit_jobs(requests, jobs, videos(spark, d).select(F.lit(None).cast("string").alias("source_url"))).select("video_id")


@query("SELECT o_orderstatus AS day, l_returnflag AS kind, round(sum(l_extendedprice), 2) AS cost_usd, count(*) AS entries, CAST(grouping(o_orderstatus, l_returnflag) AS BIGINT) AS grouping_level FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_orderstatus, l_returnflag)")
def cost_rollup(spark, d):
    ledger = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderstatus").alias("day"), F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("cost_usd"))
    return _round(catalogue.cost_rollup(ledger, ["day", "kind"]), "cost_usd", digits=2).withColumn("grouping_level", F.col("grouping_level").cast("bigint"))


@query(
    """SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'left' WHEN a.p_partkey IS NULL THEN 'right' ELSE 'values' END AS difference FROM (SELECT * FROM part WHERE p_partkey % 11 <> 0) a
FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'x' ELSE p_name END AS p_name FROM part WHERE p_partkey % 17 <> 0) b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_name IS DISTINCT FROM b.p_name"""
)
def reconcile_tables(spark, d):
    """Two copies of part that lack and change rows of their own."""
    p = table(spark, d, "part")
    left = p.where("p_partkey % 11 <> 0").select("p_partkey", "p_name")
    right = p.where("p_partkey % 17 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 13 == 0, "x").otherwise(F.col("p_name")).alias("p_name"))
    return reconcile(left, right, "p_partkey").select("p_partkey", "difference")


# ---- jobs, conversations, logs

EVENTS = """ev AS (SELECT user_id AS job_id, event_id AS seq, ts, CASE WHEN event_type = 'purchase' THEN 'result' WHEN event_type = 'error' THEN 'error' ELSE 'progress' END AS et, event_type, value FROM events)"""


def _job_events(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "result").when(F.col("event_type") == "error", "error").otherwise("progress")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("event_time"), kind.alias("event_type"), F.col("event_type").alias("stage"), (F.col("value") % 100).cast("int").alias("percent"), F.col("event_type").alias("message"), F.col("value").alias("cost_usd"))


@query(
    f"""WITH {EVENTS}, fin AS (SELECT job_id, arg_min(et, (ts, seq)) AS et, min((ts, seq)) AS at, arg_min(value, (ts, seq)) AS value, min(ts) AS done FROM ev WHERE et <> 'progress' GROUP BY 1),
pr AS (SELECT job_id, arg_max(event_type, (ts, seq)) AS stage FROM ev LEFT JOIN fin USING (job_id) WHERE ev.et = 'progress' AND (fin.at IS NULL OR (ev.ts, ev.seq) < fin.at) GROUP BY 1)
SELECT j.job_id, CASE fin.et WHEN 'result' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, stage, CASE WHEN fin.et = 'result' THEN fin.value END AS cost_usd, done AS completed_at
FROM (SELECT DISTINCT job_id FROM ev) j LEFT JOIN fin USING (job_id) LEFT JOIN pr USING (job_id)"""
)
def job_states(spark, d):
    """Events by user as a job's: the first purchase completes it, the first error fails it."""
    return job_state(_job_events(spark, d)).select("job_id", "status", "stage", "cost_usd", "completed_at")


@query("SELECT date_trunc('day', ts) AS window_start, count(*) AS searches, round(sum(value), 4) AS cost_usd FROM events GROUP BY 1")
def log_by_day(spark, d):
    return _round(log_windows(table(spark, d, "events").select(F.col("ts").alias("created_at"), F.col("value").alias("cost_usd"))), "cost_usd", digits=4)


def turns_of(spark: SparkSession, d: str) -> DataFrame:
    """conversations as turns: a system turn starts a new search, a user's refines it, an assistant's selects one of five results."""
    c = table(spark, d, "conversations")
    action = F.when(F.col("role") == "system", "new_search").when(F.col("role") == "user", "refine_search").otherwise("select_result")
    n = F.length("text")
    llm = F.when(n % 3 == 0, F.array((n % 5).cast("int"), (n % 7).cast("int"))).otherwise(F.array().cast("array<int>"))
    ui = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array().cast("array<int>"))
    return c.select("conv_id", "turn", F.col("text").alias("message"), action.alias("action"), F.md5("text").alias("query"), llm.alias("llm_video_ids"), ui.alias("ui_video_ids"), (n % 8).cast("int").alias("selected_index"), F.lit(5).alias("n_results"), F.lit(None).cast("string").alias("clarification"))


@query(
    """WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) AS n FROM conversations),
x AS (SELECT *, CASE WHEN n % 3 = 0 THEN [(n % 5)::INT, (n % 7)::INT] ELSE []::INT[] END AS llm, CASE WHEN conv_id % 2 = 0 THEN [0, 1, 2, 3]::INT[] ELSE []::INT[] END AS ui FROM t),
f AS (SELECT conv_id, 0::BIGINT AS i, []::INT[] AS scope, 0 AS results, NULL::BIGINT AS sel, NULL::VARCHAR AS q FROM (SELECT DISTINCT conv_id FROM t)
 UNION ALL SELECT x.conv_id, x.i,
  CASE WHEN x.role = 'assistant' THEN f.scope ELSE (SELECT CASE WHEN len(x.ui) = 0 THEN l WHEN len(list_filter(l, lambda v: list_contains(x.ui, v))) > 0 THEN list_filter(l, lambda v: list_contains(x.ui, v)) ELSE x.ui END FROM (SELECT CASE WHEN len(x.llm) > 0 THEN x.llm WHEN x.role = 'user' THEN f.scope ELSE []::INT[] END AS l)) END,
  CASE WHEN x.role = 'assistant' THEN f.results ELSE 5 END,
  CASE WHEN x.role <> 'assistant' THEN NULL WHEN x.n % 8 BETWEEN 1 AND f.results THEN x.n % 8 ELSE f.sel END,
  CASE WHEN x.role = 'assistant' THEN f.q ELSE md5(x.text) END
 FROM f JOIN x ON x.conv_id = f.conv_id AND x.i = f.i + 1)
SELECT f.conv_id, t.turn, array_to_string(f.scope, ',') AS scope, CAST(f.sel AS INT) AS selected_index, f.q AS active_query FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i"""
)
def conversation_states(spark, d):
    out = conversation_scopes(turns_of(spark, d))
    return out.select("conv_id", "turn", F.concat_ws(",", F.col("scope").cast("array<string>")).alias("scope"), "selected_index", "active_query")


@query("SELECT conv_id, md5(right(string_agg(left(text, 60), chr(10) ORDER BY turn), 800)) AS history FROM conversations GROUP BY 1")
def history_tail(spark, d):
    """Each conversation's history of the first 60 characters of its turns, its last 800 characters."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 60).alias("x")))), lambda t: t["x"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(lines.alias("l")).select("conv_id", F.md5(F.aggregate("l", F.lit(""), lambda acc, x: append_history(acc, x))).alias("history"))


@query("SELECT conv_id, md5(coalesce(right(string_agg(text, chr(10) ORDER BY turn), 800), '')) AS history FROM conversations GROUP BY 1")
def history_tail_whole(spark, d):
    """Each conversation's history of its whole turns, its last 800 characters."""
    return history(table(spark, d, "conversations")).select("conv_id", F.md5("history").alias("history"))


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def recent_turns(spark, d):
    return catalogue.recent_turns(table(spark, d, "conversations"), 6, "conv_id").select("conv_id", "turn")


@query("SELECT page_id, contains(lower(html), 'the ') AS has_the, length(trim(regexp_replace(coalesce(html, ''), '\\s+', ' ', 'g'))) AS n, contains(lower(url), 'youtu.be/') AS is_video FROM pages")
def page_text(spark, d):
    """Pages through the text functions: a substring whatever its case, cleaned length, and whether the address is a video's."""
    return table(spark, d, "pages").select("page_id", contains_ci(F.col("html"), F.lit("THE ")).alias("has_the"), F.length(clean_text(F.col("html"))).cast("bigint").alias("n"), is_video_url(F.col("url")).alias("is_video"))


@query(
    """SELECT event_id, lpad((e // 60)::VARCHAR, greatest(2, length((e // 60)::VARCHAR))::INT, '0') || ':' || lpad((e % 60)::VARCHAR, 2, '0') AS stamp, least(5, greatest(1, ceil(value / 2)))::BIGINT AS samples, round(value * 0.7, 6) AS last_probe,
 round(CASE WHEN value > 5 THEN (least(value, 20) - 5) / (greatest(value, 20) - 0) ELSE 0 END, 6) AS iou, CASE WHEN value > 100 THEN '字幕' WHEN value > 0.5 THEN '字幕' ELSE '字幕＋畫面' END AS label FROM (SELECT *, CAST(floor(value * 60) AS BIGINT) AS e FROM events)"""
)
def time_functions(spark, d):
    v = F.col("value")
    e = table(spark, d, "events")
    scored = e.withColumns({"transcript_score": v, "visual_score": F.when(v <= 0.5, v - 0.01), "ocr_score": F.lit(None).cast("double")})
    return scored.select("event_id", format_timestamp(v * 60).alias("stamp"), F.size(sample_times(F.lit(0.0), v)).cast("bigint").alias("samples"), F.round(F.get(probe_times(F.lit(0.0), v), F.lit(2)), 6).alias("last_probe"), F.round(temporal_iou(F.lit(0.0), v, F.lit(5.0), F.lit(20.0)), 6).alias("iou"), hit_source_label().alias("label"))


from . import queries_more, queries_tables  # noqa: E402, F401  register their queries
