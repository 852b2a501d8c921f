"""Reports over whole corpora: coverage of documents, quality of descriptions, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.coverage import coverage_summary, document_coverage
from ..operators.evaluation import aggregate_eval, evaluate
from ..operators.material import build_material, material_lines
from ..operators.quality import description_quality
from ..sources.vectors import read_documents, uncovered_items


def coverage_report(videos: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each document's figures and their summary."""
    lines = material_lines(build_material(segments, include_ocr=True))
    about = videos.where("document_json is not null").select(F.col("id").alias("video_id"), "duration_sec").join(uncovered_items(videos), "video_id", "left")
    rows = document_coverage(read_documents(videos), lines, about)
    return rows, coverage_summary(rows)


def quality_report(segments: DataFrame) -> DataFrame:
    return description_quality(segments, [(), ("vlm_frame_count",), ("video_id",)])


def golden_report(queries: DataFrame, answers: DataFrame, results: DataFrame, summary: DataFrame, top_k: int = 20) -> tuple[DataFrame, DataFrame]:
    rows = evaluate(queries, answers, results, summary, top_k)
    return rows, aggregate_eval(rows)
