"""Corpus hygiene: junk text, watermarks, and the lines of material for documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..functions.times import format_timestamp

MIN_SAMPLES = 8
JUNK_SHARE, WATERMARK_SHARE = 0.4, 0.15
# The labels of a line's parts.
VISUAL, TRANSCRIPT, ON_SCREEN, SECONDS = "畫面：", "字幕：", "畫面文字：", " 秒] "


def _cleaned(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, text, h): the cleaned, non-empty texts, and 128 bits that stand for each. A row's text is cleaned once: it leaves a generator, which
    no filter or later column moves below."""
    once = F.explode(F.filter(F.array(clean_text(F.col(text))), lambda t: t != ""))
    h = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b"))
    return df.select(key, once.alias("text")).select(key, "text", h.alias("h"))


def _counted(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, h, n): how often a key has each cleaned, non-empty text."""
    return _cleaned(df, text, key).groupBy(key, "h").agg(F.count("*").alias("n"))


def text_shares(df: DataFrame, text: str, key: str = "video_id", where: Column | None = None) -> DataFrame:
    """(key, text, n, total, share) of each distinct cleaned, non-empty text, or of those for which a condition on the three figures holds.

    Texts are counted by hash, so that only hashes are shuffled and one video's rows needn't meet; the texts themselves are fetched
    for the rows that stay.
    """
    n = _counted(df, text, key)
    shares = n.join(n.groupBy(key).agg(F.sum("n").alias("total")), key).withColumn("share", F.col("n") / F.col("total"))
    if where is not None:
        shares = shares.where(where)
    named = _cleaned(df, text, key).join(shares.select(key, "h"), [key, "h"], "left_semi").groupBy(key, "h").agg(F.min("text").alias("text"))
    return shares.join(named, [key, "h"]).select(key, "text", "n", "total", "share")


def dominant_share(df: DataFrame, text: str, key: str = "video_id", least: int = MIN_SAMPLES) -> DataFrame:
    """(key, share): how much of a key's texts the most frequent one is; 0 for fewer than `least` texts."""
    top = _counted(df, text, key).groupBy(key).agg(F.max("n").alias("n"), F.sum("n").alias("total"))
    return top.select(key, F.when(F.col("total") >= least, F.col("n") / F.col("total")).otherwise(0.0).alias("share"))


def junk_transcript_videos(segments: DataFrame) -> DataFrame:
    """(video_id) of videos whose transcripts repeat one text too often."""
    return dominant_share(segments, "transcript").where(F.col("share") > JUNK_SHARE).select("video_id")


def watermarks(segments: DataFrame) -> DataFrame:
    """(video_id, text): on-screen texts that are on too many of a video's segments."""
    often = (F.col("total") >= MIN_SAMPLES) & (F.col("share") > WATERMARK_SHARE)
    return text_shares(segments, "ocr_text", where=often).select("video_id", "text")


def build_material(segments: DataFrame, include_ocr: bool = False) -> DataFrame:
    """(video_id, start_sec, line_sec, line): one line for each segment with any text, without junk transcripts and watermarks."""
    cleaned = [clean_text(F.col(c)).alias(n) for c, n in (("visual_description", "v"), ("transcript", "t"), ("ocr_text", "o"))]
    rows = segments.select("video_id", "start_sec", F.inline(F.array(F.struct(*cleaned))))  # a generator: each text is cleaned once
    junk = junk_transcript_videos(segments).withColumn("junk", F.lit(True))
    rows = rows.join(junk, "video_id", "left")
    parts = [F.when(F.col("v") != "", F.concat(F.lit(VISUAL), F.col("v"))), F.when((F.col("t") != "") & F.col("junk").isNull(), F.concat(F.lit(TRANSCRIPT), F.col("t")))]
    if include_ocr:
        marks = watermarks(segments).select("video_id", F.col("text").alias("o"), F.lit(True).alias("mark"))
        rows = rows.join(marks, ["video_id", "o"], "left")
        parts.append(F.when((F.col("o") != "") & F.col("mark").isNull(), F.concat(F.lit(ON_SCREEN), F.col("o"))))
    text = F.concat_ws("；", *parts)
    second = F.col("start_sec").cast("bigint")
    line = F.concat(F.lit("["), format_timestamp(F.col("start_sec")), F.lit("｜"), second.cast("string"), F.lit(SECONDS), text)
    some = F.exists(F.array(*parts), lambda x: x.isNotNull())
    return rows.where(some).select("video_id", "start_sec", second.alias("line_sec"), line.alias("line"))


def material_lines(material: DataFrame) -> DataFrame:
    """(video_id, line_sec, line): the last line of each second."""
    return material.groupBy("video_id", "line_sec").agg(F.max_by("line", F.struct("start_sec", "line")).alias("line"))


def material_after(lines: DataFrame, after_sec: int) -> DataFrame:
    return lines.where(F.col("line_sec") > after_sec).orderBy("video_id", "line_sec")


def material_bounds(lines: DataFrame, videos: DataFrame | None = None, tail: float = 0.9) -> DataFrame:
    """(video_id, n_lines, first_sec, last_sec, tail_sec); with videos, those without a line have 0 and nulls."""
    found = lines.groupBy("video_id").agg(F.count("*").alias("n_lines"), F.min("line_sec").alias("first_sec"), F.max("line_sec").alias("last_sec")).withColumn("tail_sec", F.floor(F.col("last_sec") * tail).cast("bigint"))
    if videos is None:
        return found
    return videos.select("video_id").join(found, "video_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def summary_input(segments: DataFrame, most: int = 200) -> DataFrame:
    """The first segments of each video."""
    w = Window.partitionBy("video_id").orderBy("start_sec", "id")
    return segments.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def document_input(segments: DataFrame, most: int = 600) -> tuple[DataFrame, DataFrame]:
    """Segments of the videos that have at most `most`, and (video_id, n, error) of the others: documents don't leave any out."""
    n = segments.groupBy("video_id").agg(F.count("*").alias("n"))
    error = n.where(F.col("n") > most).withColumn("error", F.concat(F.lit("too many segments: "), F.col("n").cast("string")))
    return segments.join(error, "video_id", "left_anti"), error
