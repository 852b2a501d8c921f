"""Hybrid search for many queries in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import hit_source_label
from ..functions.text import first_text, negative_text, strip_generic_terms
from ..operators.dense import dense_channel, relevant_of_vectors
from ..operators.fusion import MIN_FUSION, MIN_SIMILARITY, is_confident, rank_bound, rrf, top_results
from ..operators.pruned import askers, best_rows, fused_rows, vector_rows
from ..operators.scopes import in_scope, scoped_rows
from ..operators.sparse import LIMIT, corpus_stats, exclude_negated, negated_segments, sparse_channel
from ..sources.tables import small, stage

#: Fixed value: the title of a segment whose video isn't among the analysed ones.
UNKNOWN_TITLE = "未知影片"


def attach_titles(results: DataFrame, videos: DataFrame) -> DataFrame:
    """Adds video_title."""
    titles = videos.select(F.col("id").alias("video_id"), F.col("title").alias("_title"))
    return results.join(titles, "video_id", "left").withColumn("video_title", F.coalesce("_title", F.lit(UNKNOWN_TITLE))).drop("_title")


def hybrid_search(
    queries: DataFrame,
    query_vectors: DataFrame,
    segments: DataFrame,
    videos: DataFrame,
    events: DataFrame | None = None,
    video_vectors: DataFrame | None = None,
    top_k: int = 20,
    bm25_limit: int | None = LIMIT,
    negation_limit: int | None = None,
    sparse_scope: str = "query",
    min_similarity: float = MIN_SIMILARITY,
    min_fusion: float = MIN_FUSION,
    prune: bool = True,
    index: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """results (query_id, rank, segment and scores) and summary (query_id, n_results, is_confident), one row for each query.

    queries: (query_id, query, scope); query_vectors: (query_id, variant, vector); segments: with content and array vectors;
    videos: the analysed ones (id, title); video_vectors: (video_id, vector) of summaries, by which queries without a scope
    are first narrowed to relevant videos. sparse_scope `prefiltered` makes the keyword channel's figures and limit those of the
    narrowed segments too. prune: only rows that can reach min_fusion are ranked, by counting, and no row is made for each pair of query
    and segment; without it all pairs are written and sorted, as a reference. index: a trigram index of the segments, if there is one.
    """
    cleaned = queries.withColumn("query", strip_generic_terms(F.col("query")))
    narrowed = cleaned.select("query_id", "query", "scope")
    if video_vectors is not None:
        free = query_vectors.join(cleaned.where("scope is null").select("query_id"), "query_id", "left_semi")
        relevance = relevant_of_vectors(free, video_vectors.select(F.lit(None).cast("string").alias("id"), "video_id", "vector"))
        relevant = relevance.groupBy("query_id").agg(F.collect_set("video_id").alias("_few"))
        narrowed = narrowed.join(relevant, "query_id", "left").select("query_id", "query", F.coalesce("scope", "_few").alias("scope"))
    narrowed = stage(narrowed)
    asked = narrowed if sparse_scope == "prefiltered" else cleaned
    search = _pruned if prune and min_fusion > 0 else _sorted
    fused = stage(search(cleaned, narrowed, asked, query_vectors, segments, events, bm25_limit, negation_limit, min_fusion, index))
    best = top_results(fused, top_k, min_similarity, min_fusion)
    own = segments.select("id", "end_sec", "transcript", first_text("visual_description", "transcript", "ocr_text").alias("description"))
    results = attach_titles(best.join(own, "id"), videos).withColumn("hit_source", hit_source_label())
    shown = results.select("query_id", "rank", F.col("id").alias("segment_id"), "video_id", "video_title", "start_sec", "end_sec", "similarity", "hit_source", "description", "transcript", "transcript_score", "visual_score", "ocr_score", "fusion_score")
    n = best.groupBy("query_id").agg(F.count("*").alias("n_results"))
    summary = queries.select("query_id", "query").join(n, "query_id", "left").join(is_confident(fused), "query_id", "left")
    return shown, summary.select("query_id", "query", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("is_confident", F.lit(False)).alias("is_confident"))


def _within(narrowed: DataFrame, segments: DataFrame):
    """Which of found rows (query_id, id, ...) are segments that their query may show."""
    scopes, places = narrowed.select("query_id", "scope"), segments.select("id", "video_id")

    def restrict(found: DataFrame) -> DataFrame:
        met = found.join(places, "id").join(small(scopes), "query_id").where(in_scope(F.col("scope"), F.col("video_id")))
        return met.select(*found.columns)

    return restrict


def _pruned(cleaned, narrowed, asked, query_vectors, segments, events, bm25_limit, negation_limit, min_fusion, index) -> DataFrame:
    """The rows that can reach the floor, with both ranks and the fused score.

    Such a row, and the best row of a query too, has one of its ranks at most rank_bound: the dense ones are the best of what the tasks
    send, the sparse ones the first that the keywords find; the latter's dense rank is counted inside the tasks. Queries of one text and
    scope ask the keywords once.
    """
    bound = max(rank_bound(min_fusion), 1)
    both = cleaned.select("query_id", "query", F.col("scope").alias("own")).join(narrowed.select("query_id", "scope"), "query_id")
    members = askers(both, "query", "own", "scope")
    once = stage(members.where("query_id = asker"))
    own = once.select("query_id", "query", F.col("own").alias("scope"))
    scopes = once.select("query_id", "scope")
    asked = once.select("query_id", "query", "scope") if asked is narrowed else own
    inside = _within(scopes, segments)
    negated = own.where(F.trim(negative_text(F.col("query"))) != "")
    excluded = None
    if not negated.isEmpty():
        n = corpus_stats(scopes, segments).select("query_id", F.col("n_docs").alias("n"))
        excluded = stage(negated_segments(negated, segments, None, negation_limit, index=index, restrict=inside, totals=n))
    vectors = stage(vector_rows(segments, events, excluded))
    first = stage(best_rows(query_vectors, members, vectors, bound))
    # queries of one asker have as many rows; it may itself have no vector
    counts = first.where("id is null").groupBy("query_id").agg(F.sum("n").alias("n")).join(members, "query_id")
    totals = counts.groupBy(F.col("asker").alias("query_id")).agg(F.max("n").alias("n"))

    def valid(found: DataFrame) -> DataFrame:
        kept = inside(found).join(vectors.select("id"), "id", "left_semi")
        return kept if excluded is None else kept.join(excluded, ["query_id", "id"], "left_anti")

    sparse = sparse_channel(asked, segments, limit=bm25_limit, index=index, restrict=valid, totals=totals)
    return fused_rows(query_vectors, members, vectors, first, sparse, bound)


def _sorted(cleaned, narrowed, asked, query_vectors, segments, events, bm25_limit, negation_limit, min_fusion, index) -> DataFrame:
    """The same from all pairs of queries and segments, for all rows."""
    rows = segments.select("id", "video_id", "start_sec")
    scoped = scoped_rows(narrowed, rows)
    candidates = stage(exclude_negated(narrowed, segments, scoped, negation_limit))
    scored = dense_channel(query_vectors, segments, events).join(candidates, ["query_id", "id"])
    valid = stage(scored.select("query_id", "id", "video_id", "start_sec", "similarity", "transcript_score", "visual_score", "ocr_score"))
    sparse = stage(sparse_channel(asked, segments, valid.select("query_id", "id"), limit=bm25_limit, index=index))
    return rrf(valid, sparse)
