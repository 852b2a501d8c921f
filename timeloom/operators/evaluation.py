"""Evaluation of ranked results against expected time ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import f1, ndcg, reciprocal_rank, temporal_iou


def match_answers(results: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, rank, iou): results (query_id, rank, video_id, start_sec, end_sec) that overlap an answer of their query, with the
    best overlap of each."""
    a = answers.select("query_id", "video_id", F.col("start_sec").alias("_a"), F.col("end_sec").alias("_b"))
    iou = temporal_iou(F.col("start_sec"), F.col("end_sec"), F.col("_a"), F.col("_b"))
    joined = results.join(a, ["query_id", "video_id"]).withColumn("iou", iou).where("iou > 0")
    return joined.groupBy("query_id", "rank").agg(F.max("iou").alias("iou"))


def hit_rank(matches: DataFrame) -> DataFrame:
    return matches.groupBy("query_id").agg(F.min("rank").alias("hit_rank"))


def best_iou(matches: DataFrame, k: int) -> DataFrame:
    """(query_id, best_iou) among the first k results."""
    return matches.where(F.col("rank") <= k).groupBy("query_id").agg(F.max("iou").alias("best_iou"))


def evaluate(queries: DataFrame, answers: DataFrame, results: DataFrame, summary: DataFrame, top_k: int = 20) -> DataFrame:
    """One row for each query (query_id, is_answerable): recall at 1 and 5, reciprocal rank, nDCG at 5 and best IoU, null if it
    has no answer; is_confident; and the first result's similarity."""
    matches = match_answers(results.select("query_id", "rank", "video_id", "start_sec", "end_sec"), answers)
    first = results.where("rank = 1").select("query_id", F.col("similarity").alias("top1_similarity"))
    rows = queries.select("query_id", "is_answerable").join(hit_rank(matches), "query_id", "left").join(best_iou(matches, top_k), "query_id", "left")
    rows = rows.join(summary.select("query_id", "is_confident"), "query_id", "left").join(first, "query_id", "left")
    rank, able = F.col("hit_rank"), F.col("is_answerable")
    only = lambda c: F.when(able, c)
    return rows.select(
        "query_id",
        "is_answerable",
        only(F.coalesce(rank <= 1, F.lit(False))).alias("recall_at_1"),
        only(F.coalesce(rank <= 5, F.lit(False))).alias("recall_at_5"),
        only(reciprocal_rank(rank)).alias("reciprocal_rank"),
        only(ndcg(rank, 5)).alias("ndcg_at_5"),
        only(F.col("best_iou")).alias("best_iou"),
        F.coalesce("is_confident", F.lit(False)).alias("predicted_answerable"),
        "top1_similarity",
    )


def no_answer_f1(per_query: DataFrame) -> DataFrame:
    """(no_answer_precision, no_answer_recall, no_answer_f1): how well a missing confidence tells queries without an answer."""
    able, said = F.col("is_answerable"), F.col("predicted_answerable")
    n = per_query.groupBy().agg(F.count_if(~able & ~said).alias("tp"), F.count_if(able & ~said).alias("fp"), F.count_if(~able & said).alias("fn"))
    p, r, f = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.select(p.alias("no_answer_precision"), r.alias("no_answer_recall"), f.alias("no_answer_f1"))


def aggregate_eval(per_query: DataFrame) -> DataFrame:
    """One row: means over the answerable queries (0 without any), the mean IoU over those with a hit (null without any), and the
    figures of no_answer_f1."""
    able = per_query.where("is_answerable")
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c)
    means = able.groupBy().agg(share("recall_at_1"), share("recall_at_5"), F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"), share("ndcg_at_5"), F.avg("best_iou").alias("mean_timestamp_iou"))
    return means.join(no_answer_f1(per_query))  # one row each
