"""Streams into tables: windows over the search log, swapped analyses, and an index that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.trigrams import compacted, postings, read_index, write_index
from ..sources.tables import replace_partition


def log_windows(log: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, searches, cost_usd) of a log (created_at as text or time, cost_usd), batch or stream; rows that come later
    than `late` after newer ones are left out by a stream."""
    rows = log.withColumn("_at", F.col("created_at").cast("timestamp"))
    if log.isStreaming:
        rows = rows.withWatermark("_at", late)
    return rows.groupBy(F.window("_at", width).alias("w")).agg(F.count("*").alias("searches"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd")).select(F.col("w.start").alias("window_start"), "searches", "cost_usd")


def swap_analyses(segments: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch's videos take the place of their old segments in one step of a table of snapshots: readers see the old ones until then. A row without an id
    says that its video's new analysis has no segment. A batch that is run again after a failure changes nothing."""

    def swap(df: DataFrame, n: int) -> None:
        replace_partition(df.where("id is not null"), path, keys=df, batch=f"{checkpoint}:{n}")

    writer = segments.writeStream.foreachBatch(swap).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def grow_index(segments: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the posting rows of new segments to the index as they come; no state is kept. They can be looked up at once, and compact_index
    puts them in order."""
    writer = postings(segments).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def compact_index(spark: SparkSession, path: str, to: str) -> DataFrame:
    """The stream's many small files written to another place as one row for each gram and block, in order; the old index stays as it is."""
    write_index(compacted(read_index(spark, path)), to)
    return read_index(spark, to)
