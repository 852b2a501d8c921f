"""The golden set: queries with their expected time ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import parse_timestamp

COLUMNS = "id string, query string, query_type string, is_answerable string, expected_video_id string, expected_start string, expected_end string, confirmed string, notes string"


def read_golden_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """queries(id, query, query_type, is_answerable, notes) and answers(id, video_id, start_sec, end_sec) from CSV with a header.

    Several rows of one id are several answers; the query's own columns are those of its first row. A row without an expected
    video has no answer.
    """
    rows = spark.read.csv(path, header=True, schema=COLUMNS).select("*", F.monotonically_increasing_id().alias("_n"))
    own = [F.min_by(c, "_n").alias(c) for c in ("query", "query_type")]
    answerable = F.lower(F.trim(F.min_by("is_answerable", "_n"))) == "true"
    queries = rows.groupBy("id").agg(*own, answerable.alias("is_answerable"), F.coalesce(F.min_by("notes", "_n"), F.lit("")).alias("notes"))
    video = F.nullif(F.trim("expected_video_id"), F.lit(""))
    answers = rows.where(video.isNotNull()).select("id", video.cast("int").alias("video_id"), parse_timestamp(F.col("expected_start")).alias("start_sec"), parse_timestamp(F.col("expected_end")).alias("end_sec"))
    return queries, answers
