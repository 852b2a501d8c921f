"""The star-schema and corpus tables of a folder, seen as the tables of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import with_content

#: Seconds between the starts of neighbouring segments, and how many a source has before its time starts again.
STEP, SPAN = 12.0, 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str, wrap: bool = True) -> DataFrame:
    """documents as segments: their source is the video, their text the transcript. Without wrap each has a start of its own."""
    d = table(spark, sf_dir, "documents")
    start = (F.col("doc_id") % SPAN if wrap else F.col("doc_id")) * STEP
    none = F.lit(None).cast("string")
    rows = d.select(F.col("doc_id").alias("id"), F.expr("cast(substr(source, 4) as int)").alias("video_id"), start.alias("start_sec"), (start + STEP).alias("end_sec"), F.col("text").alias("transcript"), none.alias("visual_description"), none.alias("ocr_text"), "lang")
    return with_content(rows)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as segment vectors: their label is the video."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("video_id"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as a query."""
    return vectors(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.lit(0).alias("variant"), "vector")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by user as scenes: (video_id, scene_idx, start_sec, end_sec, word, value), each until the user's next event, in seconds
    since the user's first one."""
    w = Window.partitionBy("video_id").orderBy("ts", "event_id")
    first = F.min(F.col("ts").cast("timestamp")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(first) / 1e6
    events = table(spark, sf_dir, "events").withColumn("video_id", F.col("user_id"))  # all windows are over this one column, so rows are dealt and sorted once
    rows = events.select("video_id", (F.row_number().over(w) - 1).alias("scene_idx"), at.alias("start_sec"), F.col("event_type").alias("word"), "value", "ts", "event_id")
    return rows.withColumn("end_sec", F.lead("start_sec").over(w)).where("end_sec > start_sec")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as videos: finished orders are analysed, open ones pending, the others being analysed; every seventh has failed."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 7 == 0, "failed").when(F.col("o_orderstatus") == "F", "analyzed").when(F.col("o_orderstatus") == "O", "pending").otherwise("analyzing")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_custkey").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("summary"),
        status.alias("status"),
        day.alias("created_at"),
        F.when((F.col("o_orderstatus") != "O") & (F.col("o_orderkey") % 3 != 0), day).alias("analyzed_at"),
        (F.col("o_orderkey") % 100).cast("int").alias("segment_count"),
        F.col("o_totalprice").alias("cost_usd"),
        (F.col("o_custkey") % 5000).cast("int").alias("duration_sec"),
    )
