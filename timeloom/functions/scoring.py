"""Scores of ranked retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The modalities' names in their order.
MODALITY_NAMES = (("transcript_score", "字幕"), ("visual_score", "畫面"), ("ocr_score", "OCR"))
ALL_MODALITIES = "綜合"


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of numbers; 0 if either has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def hit_source_label(close: float = 0.03) -> Column:
    """Which modalities come within `close` of the best score, three as one word; the second's name if there is no score."""
    names = dict(MODALITY_NAMES)
    best = F.greatest(*[F.col(c) for c in names])
    near = F.filter(F.array(*[F.when(best - F.col(c) < close, F.lit(n)) for c, n in MODALITY_NAMES]), lambda n: n.isNotNull())
    return F.when(best.isNull(), names["visual_score"]).when(F.size(near) >= 3, ALL_MODALITIES).otherwise(F.array_join(near, "＋"))


def temporal_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap of two time ranges over their hull; 0 if they don't overlap."""
    overlap = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when((overlap > 0) & (hull > 0), overlap / hull).otherwise(0.0)


def reciprocal_rank(rank: Column) -> Column:
    return F.coalesce(1.0 / rank, F.lit(0.0))


def ndcg(rank: Column, k: int) -> Column:
    """Of one relevant result at the rank, or none."""
    return F.when(rank <= k, 1.0 / F.log2(rank + 1)).otherwise(0.0)


def f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where nothing is to divide by."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
