"""Importance resampling: a draw of documents whose word n-grams are as those of target texts.

Features are words and pairs of neighbouring words, hashed to buckets by CRC-32. Line feeds separate words, so a text's features are those of its
lines and the pairs of words that a line's end parts. Each distinct line of the corpus is counted once and its counts multiplied by how often
it occurs; pairs across lines are counted likewise, apart. Blocks of texts send each of their lines once, and lines meet their copies by a
group-by that combines on the way, so a line that a third of the rows have is one row of a task. In the second pass a block adds up the gains of each
of its distinct lines once; no text moves there. Only the counts by bucket reach the driver.

Weights get Gumbel noise from a hash of the document's id; the highest scores are a draw without replacement (Xie et al., 2023).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalogue import places
from .common import materialize, text_slices, utf8_list
from .text import Lines, alnum_words, crc32_pairs, crc32_words

BUCKETS = 10_000


def _pairs(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """For each word with a next one in its text: its number, and whether a line's end parts them."""
    left = np.ones(len(x.start), bool)
    left[x.first[1:][x.first[1:] > x.first[:-1]] - 1] = False
    left = np.flatnonzero(left)
    return left, x.line[left] != x.line[np.minimum(left + 1, max(len(x.line) - 1, 0))]


def _line_texts(x: Lines) -> pa.Array:
    """All lines with their line feeds."""
    ends = np.r_[0, x.feed + 1].astype(np.int64)
    return pa.Array.from_buffers(pa.large_utf8(), len(x.feed), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x.raw))])


def segments(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(segment, parted, n): each distinct line with any word and how often it occurs, and with parted the pairs of words that a line's end parts."""

    def run(batches):
        for b in text_slices(batches, text_col):
            x = alnum_words(utf8_list(b.column(text_col)))
            lines = _line_texts(x).take(pa.array(np.unique(x.line))).value_counts()
            left, parted = _pairs(x)
            word = lambda i: x.raw[x.start[i] : x.end[i]].tobytes().decode()
            pairs = pa.array([f"{word(i)} {word(i + 1)}" for i in left[parted]], pa.large_utf8()).value_counts()
            for found, is_pair in ((lines, False), (pairs, True)):
                n = len(found)
                yield pa.record_batch([found.field("values").cast(pa.string()), pa.array(np.full(n, is_pair)), found.field("counts").cast(pa.int64())], ["segment", "parted", "n"])

    rows = docs.select(text_col).mapInArrow(run, "segment string, parted boolean, n bigint")
    return rows.groupBy("segment", "parted").agg(F.sum("n").alias("n"))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features occur in all texts."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in text_slices(batches, "segment"):
            x = alnum_words(utf8_list(b.column("segment")))
            n, parted = b.column("n").to_numpy(), b.column("parted").to_numpy(zero_copy_only=False)
            of = np.searchsorted(x.first, np.arange(len(x.start)), side="right") - 1
            crc = crc32_words(x.raw, x.start, x.end)
            left, _ = _pairs(x)
            pair = crc32_pairs(x.raw, x.start, x.end, crc, left, left + 1)
            single = ~parted[of]  # of a parted pair only the pair counts
            for c, times in ((crc[single], n[of[single]]), (pair, n[of[left]])):
                np.add.at(total, c % np.uint32(buckets), times)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    found = segments(docs, text_col).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in found:
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, with one more of each."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: object, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """(id_col, n_words, n_features, weight, score) of every row: the floored mean gain of its features, and with noise."""
    known = docs.sparkSession.sparkContext.broadcast(gain)  # as many numbers as there are buckets

    def run(batches):
        of_bucket = known.value.astype(np.float64)
        gain_of = lambda c: of_bucket[c % np.uint32(len(of_bucket))]
        for b in text_slices(batches, text_col):
            x = alnum_words(utf8_list(b.column(text_col)))
            text = _line_texts(x).dictionary_encode()
            code = np.asarray(text.indices)
            _, first = np.unique(code, return_index=True)  # the first line of each text of a line
            is_first = np.zeros(len(code), bool)
            is_first[first] = True
            left, parted = _pairs(x)
            needed = is_first[x.line]
            needed[left[parted]] = needed[left[parted] + 1] = True
            crc = np.zeros(len(x.start), np.uint32)
            crc[needed] = crc32_words(x.raw, x.start[needed], x.end[needed])
            inside = left[~parted & is_first[x.line[left]]]
            one = np.flatnonzero(is_first[x.line])
            pair = lambda i: gain_of(crc32_pairs(x.raw, x.start, x.end, crc, i, i + 1))
            sums = np.bincount(x.line[one], gain_of(crc[one]), len(code)) + np.bincount(x.line[inside], pair(inside), len(code))
            sums = sums[first][code] if len(code) else sums  # every line has the sum of its first copy
            across = left[parted]
            total = np.r_[0, np.cumsum(sums)][x.lines]
            at = np.searchsorted(x.first, across, side="right") - 1
            whole = (np.diff(total) + np.bincount(at, pair(across), b.num_rows)).astype(np.int64)
            words = np.diff(x.first)
            features = np.maximum(2 * words - 1, 0)
            weight = np.where(features > 0, whole // np.maximum(features, 1), 0)
            noisy = weight + np.array([noise(i, seed) for i in b.column(id_col).to_pylist()], np.int64)
            yield pa.record_batch([b.column(id_col), pa.array(words), pa.array(features), pa.array(weight), pa.array(noisy)], [id_col, "n_words", "n_features", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def draw(scored: DataFrame, percent: int = 25, least_words: int = 20, id_col: str = "doc_id") -> DataFrame:
    """scored with rank: of the rows with at least least_words words the floor(percent %) with the highest scores, numbered from 1 on, ties to the
    smaller id (null ids last); null for the others. Rows are numbered in ranges of their order, and no task has all."""
    rows = materialize(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    may = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    most = rows.where(may).count() * percent // 100
    numbered = places(rows.where(may), F.desc("score"), F.asc_nulls_last(id_col), F.col("_row"))
    ranked = numbered.withColumn("rank", F.when(F.col("place") <= most, F.col("place")))
    return ranked.drop("_row", "place").unionByName(rows.where(~may).drop("_row").withColumn("rank", F.lit(None).cast("bigint")))


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) for every row of docs.

    A null text counts as empty: no features, weight 0, never drawn. Repeated rows and ids are rows of their own with the same score, and
    their ranks follow each other; a null id hashes as an empty one. With an empty target all gains come from the corpus alone; an empty table gives an
    empty result. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text, buckets))
    return draw(weighted(docs, gain, id_col, text_col, seed), percent, least_words, id_col)
