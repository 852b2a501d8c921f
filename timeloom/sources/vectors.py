"""Vectors packed as little-endian float32 bytes, and structured documents in JSON."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import DOCUMENT


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vec(packed: pd.Series) -> pd.Series:
    """The packed numbers as an array; null stays null."""
    return packed.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def encode_vec(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def read_documents(videos: DataFrame) -> DataFrame:
    """(video_id, section_idx, step_idx, timestamp_sec, heading, detail) of the videos' documents, places from 0 on."""
    doc = F.from_json("document_json", DOCUMENT)
    sections = videos.where("document_json is not null").select(F.col("id").alias("video_id"), F.posexplode(doc["sections"]).alias("section_idx", "section"))
    steps = sections.select("video_id", "section_idx", F.posexplode("section.steps").alias("step_idx", "step"))
    return steps.select("video_id", "section_idx", "step_idx", "step.timestamp_sec", "step.heading", "step.detail")


def uncovered_items(videos: DataFrame) -> DataFrame:
    """(video_id, uncovered_items): how many entries each document lists as not covered."""
    doc = F.from_json("document_json", DOCUMENT)
    return videos.where("document_json is not null").select(F.col("id").alias("video_id"), F.coalesce(F.size(doc["uncovered"]), F.lit(0)).alias("uncovered_items"))
