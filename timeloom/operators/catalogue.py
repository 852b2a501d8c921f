"""The catalogue of videos and jobs: lists, counts, admission, removal and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalogue import topic
from ..functions.text import has_text
from ..sources.tables import stage

TEXTS = (("has_transcript", "transcript"), ("has_visual", "visual_description"), ("has_ocr", "ocr_text"))
#: What a reset blanks.
RESULTS = ("analyzed_at", "segment_count", "cost_usd", "pipeline_stage", "asr_model", "vlm_model", "embedding_model", "summary", "summary_model", "document_json", "document_type", "document_model")
#: Rows, about, that a task sorts, and the bits of monotonically_increasing_id for the number in a partition.
RANGE_ROWS, ID_BITS = 250_000, 33
UNANALYZED = "status = 'pending' or (status = 'analyzing' and analyzed_at is null)"
LIBRARY = "status in ('analyzed', 'failed') or (status = 'analyzing' and analyzed_at is not null)"


def unanalyzed(videos: DataFrame) -> DataFrame:
    return videos.where(UNANALYZED).orderBy(F.desc("created_at"), F.desc("id"))


def library(videos: DataFrame) -> DataFrame:
    """Those without an analysis time come first, as they do in a descending order of a database."""
    return videos.where(LIBRARY).orderBy(F.desc_nulls_first("analyzed_at"), F.desc("created_at"), "id")


def by_status(videos: DataFrame, status: str) -> DataFrame:
    return videos.where(F.col("status") == status).orderBy("id")


def analyzed(videos: DataFrame) -> DataFrame:
    return videos.where("status = 'analyzed'").orderBy(F.desc_nulls_first("analyzed_at"), "id")


def within_duration(videos: DataFrame, most: int = 3600) -> DataFrame:
    return videos.where(F.col("duration_sec") <= most)


def matches_library(videos: DataFrame, needle: str) -> DataFrame:
    """Videos whose title or summary holds the trimmed text; an empty text keeps all."""
    n = needle.strip().lower()
    if not n:
        return videos
    return videos.where(F.contains(F.lower("title"), F.lit(n)) | F.contains(F.lower(F.coalesce("summary", F.lit(""))), F.lit(n)))


def status_view(videos: DataFrame, kind: str) -> DataFrame:
    """`failed`, `analyzed` for all that hasn't failed, or `all`."""
    if kind == "all":
        return videos
    return videos.where(F.col("status") == "failed" if kind == "failed" else F.col("status") != "failed")


def _library_order(column: str, desc: bool) -> list[Column]:
    keys = {"title": F.col("title"), "segment_count": F.coalesce("segment_count", F.lit(0)), "cost_usd": F.coalesce("cost_usd", F.lit(0.0)), "analyzed_at": F.coalesce("analyzed_at", "created_at")}
    return [keys[column].desc() if desc else keys[column].asc(), F.col("id")]


def library_sort(videos: DataFrame, column: str = "analyzed_at", desc: bool = True) -> DataFrame:
    """By title, segment_count, cost_usd or analyzed_at; missing numbers count as 0 and a missing time as that of creation."""
    return videos.orderBy(*_library_order(column, desc))


def library_places(videos: DataFrame, column: str = "analyzed_at", desc: bool = True) -> DataFrame:
    """Adds place: each video's number in that order."""
    return places(videos, *_library_order(column, desc))


def places(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds place: each row's number from 1 on in this order. Rows are numbered inside ranges of the order, and the rows before a
    range are counted. A range has about RANGE_ROWS rows, however many there are, and is sorted once."""
    session = rows.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    parted = stage(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_row_", F.monotonically_increasing_id()))
    parted = parted.select("*", F.shiftright("_row_", ID_BITS).alias("_p"), F.col("_row_").bitwiseAND((1 << ID_BITS) - 1).alias("_i")).drop("_row_")
    count = parted.groupBy("_p").agg(F.count("*").alias("_n"))
    before = count.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parted.join(F.broadcast(before), "_p").withColumn("place", F.col("_i") + 1 + F.col("_before")).drop("_p", "_i", "_before")


def modality_flags(segments: DataFrame) -> DataFrame:
    """(video_id, has_transcript, has_visual, has_ocr): whether any segment has such a text."""
    return segments.groupBy("video_id").agg(*[F.bool_or(has_text(c)).alias(n) for n, c in TEXTS])


def video_view(videos: DataFrame, flags: DataFrame) -> DataFrame:
    """Videos without their file's place, with the three flags, false without segments."""
    shown = videos.drop("file_path").join(flags.withColumnRenamed("video_id", "id"), "id", "left")
    return shown.withColumns({n: F.coalesce(n, F.lit(False)) for n, _ in TEXTS})


def header_stats(videos: DataFrame) -> DataFrame:
    """(pending, analyzed, segments, cost_usd) in one pass; the last two over videos with a finished analysis."""
    done = F.expr("analyzed_at is not null and status in ('analyzed', 'analyzing')")
    return videos.groupBy().agg(
        F.count_if(F.expr(UNANALYZED)).alias("pending"),
        F.count_if(F.col("status") == "analyzed").alias("analyzed"),
        F.coalesce(F.sum(F.when(done, F.col("segment_count"))), F.lit(0)).alias("segments"),
        F.coalesce(F.sum(F.when(done, F.col("cost_usd"))), F.lit(0.0)).alias("cost_usd"),
    )


def category_counts(videos: DataFrame, kind: str = "all", topics: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    return status_view(videos, kind).groupBy(topic(F.col("title"), F.col("summary"), topics).alias("category")).agg(F.count("*").alias("n"))


def valid_scope(selected: DataFrame, videos: DataFrame) -> DataFrame:
    """Of the selected video ids those that exist and are analysed."""
    return selected.join(videos.where("status = 'analyzed'").select(F.col("id").alias("video_id")), "video_id", "left_semi")


def list_jobs(jobs: DataFrame, video_id: int | None = None, job_type: str | None = None, status: str | None = None) -> DataFrame:
    for column, value in (("video_id", video_id), ("job_type", job_type), ("status", status)):
        if value is not None:
            jobs = jobs.where(F.col(column) == value)
    return jobs.orderBy(F.desc("created_at"), F.desc("id"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where("status in ('queued', 'running')").orderBy("id")


def admit_jobs(requests: DataFrame, jobs: DataFrame, videos: DataFrame) -> DataFrame:
    """The requests (job_type, video_id, source_url, ...) that aren't under way: no active analysis of the video, and for downloads no
    active job and no video of the address. Of equal requests one stays."""
    active = jobs.where("status in ('queued', 'running')")
    analysis = requests.where("job_type = 'analysis'").join(active.where("job_type = 'analysis'").select("video_id"), "video_id", "left_anti").dropDuplicates(["video_id"])
    taken = active.where("job_type = 'download'").select("source_url").union(videos.select("source_url")).where("source_url is not null")
    download = requests.where("job_type = 'download'").join(taken, "source_url", "left_anti").dropDuplicates(["source_url"])
    return analysis.unionByName(download)


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the videos (video_id) and what belongs to them."""
    return {name: df.join(ids.select(F.col("video_id").alias("id")) if name == "videos" else ids.select("video_id"), "id" if name == "videos" else "video_id", "left_anti") for name, df in tables.items()}


def reset_videos(videos: DataFrame, ids: DataFrame) -> DataFrame:
    """The videos with those of ids (video_id) as before their analysis."""
    hit = ids.select(F.col("video_id").alias("id"), F.lit(True).alias("_reset")).distinct()
    joined = videos.join(hit, "id", "left")
    blank = {c: F.when(F.col("_reset").isNull(), F.col(c)) for c in RESULTS if c in videos.columns}
    return joined.withColumns(blank).withColumn("status", F.when(F.col("_reset"), "pending").otherwise(F.col("status"))).select(*videos.columns)


def apply_outcomes(videos: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The videos after their analyses: outcomes (id, status, analyzed_at, segment_count, cost_usd, asr_model, vlm_model, embedding_model,
    summary, summary_model, document_json, document_type, document_model, stopped_by_budget, failed_scenes). Summary and document
    stay where an outcome lacks them; the cost and the three models are the outcome's own; the stage notes a stop by the budget and
    failed scenes."""
    kept = [c for c in ("summary", "summary_model", "document_json", "document_type", "document_model")]
    own = [c for c in ("status", "analyzed_at", "segment_count", "cost_usd", "asr_model", "vlm_model", "embedding_model") if c in outcomes.columns]
    note = F.nullif(F.concat_ws("; ", F.when(F.col("o.stopped_by_budget"), F.lit("stopped by budget")), F.when(F.col("o.failed_scenes") > 0, F.concat(F.col("o.failed_scenes").cast("string"), F.lit(" failed scenes")))), F.lit(""))
    joined = videos.alias("v").join(outcomes.alias("o"), F.col("v.id") == F.col("o.id"), "left")
    hit = F.col("o.id").isNotNull()
    new = {c: F.coalesce(f"o.{c}", f"v.{c}") for c in kept} | {c: F.when(hit, F.col(f"o.{c}")).otherwise(F.col(f"v.{c}")) for c in own} | {"pipeline_stage": F.when(hit, note).otherwise(F.col("v.pipeline_stage"))}
    return joined.select(*[new.get(c, F.col(f"v.{c}")).alias(c) for c in videos.columns])


def recent_turns(turns: DataFrame, n: int = 6, key: str = "frame_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("turn"))
    return turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def cost_rollup(ledger: DataFrame, keys: list[str], cost: str = "cost_usd") -> DataFrame:
    """Sums of an append-only ledger for every prefix of the keys, down to the total; missing costs count as nothing."""
    return ledger.rollup(*keys).agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost_usd"), F.count("*").alias("entries"), F.grouping_id().alias("grouping_level"))
