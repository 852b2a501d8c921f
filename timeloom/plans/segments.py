"""From scene cuts to the segment table, for all videos at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeline import align_transcript, attach_model_output, normalise_scenes, repetitive_transcripts, scene_ranges, transcript_for_index


def build_segments(cuts: DataFrame, videos: DataFrame, utterances: DataFrame, outputs: DataFrame) -> DataFrame:
    """cuts (video_id, start_sec, end_sec), videos (video_id, duration_sec), utterances and model outputs to segments with their
    transcripts, confidence figures, and index_transcript without what is unreliable."""
    scenes = normalise_scenes(scene_ranges(cuts, videos))
    aligned = repetitive_transcripts(align_transcript(scenes, utterances))
    whole = attach_model_output(transcript_for_index(aligned), outputs)
    texts = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("transcript", "visual_description", "ocr_text")]
    return whole.select("video_id", "scene_idx", "start_sec", "end_sec", "source_raw_duration", *texts, "index_transcript", "no_speech_prob", "avg_logprob", "compression_ratio", "vlm_frame_count")
