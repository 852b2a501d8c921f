"""A trigram index in posting blocks, for substring look-ups that read only their own trigrams' rows.

A row (gram, block, ids) holds the sorted ids, of one block of ID_BLOCK numbers, of the segments whose lower-cased content has the gram; it may be in
several rows, as a stream appends them, until they are compacted. Rows lie in order of gram in the files, so that their statistics tell which row groups a look-up needs. A term's candidates are met block by block, its rarest gram first, and only they
have their text read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_ci, grams
from ..sources.tables import small, stage
from .scopes import in_scope

INDEX = "gram string, block bigint, ids array<bigint>"
#: Numbers of ids in a block.
ID_BLOCK = 1 << 13
#: Characters that are cut into grams at once.
CHARS = 1 << 20
#: Up to so many different grams are named in the scan's filter; more are met by a join.
MOST_NAMED = 200
#: Pairs of a term and its gram, and candidates, that are sent to every task; more of them are met by a shuffle.
MOST_PAIRS, MOST_FOUND = 2_000, 200_000


def _gram_rows(ids: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(gram as a number, id) of all distinct pairs, sorted."""
    joined = "".join(texts)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    if len(chars) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = chars[:-2] << np.uint64(42) | chars[1:-1] << np.uint64(21) | chars[2:]
    row = np.repeat(np.arange(len(texts)), size)
    inside = row[:-2] == row[2:]
    key, row = key[inside], ids[row[:-2][inside]]
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])] if len(key) else np.zeros(0, bool)
    return key[new], row[new]


def _postings(ids: np.ndarray, texts: list[str]) -> pa.RecordBatch:
    key, row = _gram_rows(ids, texts)
    block = row // ID_BLOCK
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])]) if len(key) else np.zeros(0, np.int64)
    k = key[first]
    mask = np.uint64((1 << 21) - 1)
    chars = np.stack([k >> np.uint64(42), k >> np.uint64(21) & mask, k & mask], 1).astype("<u4").tobytes().decode("utf-32-le")
    named = pa.array([chars[i : i + 3] for i in range(0, len(chars), 3)], pa.string())
    return pa.record_batch([named, pa.array(block[first], pa.int64()), pa.ListArray.from_arrays(np.r_[first, len(key)].astype(np.int32), row.astype(np.int64))], ["gram", "block", "ids"])


def postings(segments: DataFrame) -> DataFrame:
    """INDEX rows of segments (id, content), several of a gram and block. Ids are whole numbers; null contents have no grams. Batch or stream."""

    def run(batches):
        for b in batches:
            ids, texts = b.column("id").to_numpy(), b.column("low")
            part = (np.cumsum(np.asarray(pc.utf8_length(texts))) - 1) // CHARS
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if b.num_rows else []
            for i, j in zip(first, [*first[1:], b.num_rows], strict=True):
                yield _postings(ids[i:j], texts.slice(i, j - i).to_pylist())

    rows = segments.where("id is not null and content is not null").select(F.col("id").cast("bigint").alias("id"), F.lower("content").alias("low"))
    return rows.mapInArrow(run, INDEX)


def compacted(index: DataFrame) -> DataFrame:
    """One row for each gram and block, in ranges of gram."""
    whole = index.groupBy("gram", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return whole.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")


def build_trigram_index(segments: DataFrame) -> DataFrame:
    return compacted(postings(segments))


def write_index(index: DataFrame, path: str) -> None:
    """Small row groups and pages, so that their statistics and bloom filters part the grams."""
    index.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).option("parquet.bloom.filter.enabled#gram", "true").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def _wanted_rows(index: DataFrame, wanted: DataFrame, names: list[str] | None) -> DataFrame:
    """The index's rows of the wanted grams (low, gram): by the scan's filter where their names are given, else by a join."""
    if names is None:
        return index.join(wanted.select("gram").distinct(), "gram", "left_semi")
    return index.where(reduce(lambda a, b: a | b, [F.col("gram") == n for n in names])) if names else index.limit(0)


def candidates(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(low, id) of segments that have all grams of each of the lower-cased terms (low) of three or more characters. Grams of one block of ids meet, the
    rarest first, so that no term's postings are gathered as a whole."""
    each = terms.where(F.length("low") >= 3).select("low").distinct()
    wanted = each.select("low", F.explode(grams(F.col("low"))).alias("gram"))
    known, names = wanted.limit(MOST_PAIRS + 1).collect(), None
    if len(known) <= MOST_PAIRS:
        wanted = F.broadcast(terms.sparkSession.createDataFrame(known, "low string, gram string"))
        names = sorted({r.gram for r in known})
        names = names if len(names) <= MOST_NAMED else None
    n_grams = wanted.groupBy("low").agg(F.count("*").alias("n"))
    part = _wanted_rows(index, wanted, names)
    met = part.join(wanted, "gram").groupBy("low", "block", "gram").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    met = met.groupBy("low", "block").agg(F.array_sort(F.collect_list(F.struct(F.size("ids").alias("n"), "ids"))).alias("lists"))
    whole = met.join(n_grams, "low").where(F.size("lists") == F.col("n"))  # a block that lacks a gram lacks the term
    both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.array_distinct(F.element_at("lists", 1)["ids"]), lambda acc, x: F.array_intersect(acc, x["ids"]))
    return whole.select("low", F.explode(both).alias("id"))


def trigram_lookup(terms: DataFrame, index: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows of terms (query_id, term, scope), each with the id and content of a segment that holds the term: segments with all of its trigrams, then verified.
    Terms of fewer than three characters find nothing. Of the index, which may be a stored one, the rows of the terms' trigrams are read, and of the segments each
    candidate's text is looked at once for all queries."""
    asked = terms.where(F.length("term") >= 3).select("query_id", "term", "scope", F.lower("term").alias("low"))
    found = small(stage(candidates(asked, index)), MOST_FOUND)  # so that texts needn't be moved to few candidates
    texts = segments.select(F.col("id").cast("bigint").alias("_id"), "id", "video_id", "content")
    held = found.withColumnRenamed("id", "_id").join(texts, "_id").where(contains_ci(F.col("content"), F.col("low"))).select("low", "id", "video_id", "content")
    return held.join(small(asked), "low").where(in_scope(F.col("scope"), F.col("video_id"))).select("query_id", "term", "id", "content")
