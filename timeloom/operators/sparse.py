"""The keyword channel: substring BM25, substring hits, term routing and negation, for many queries at once.

Queries come as (query_id, scope, ...): scope is an array of video ids, null for all and empty for none. Segments come with
id, video_id and content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import counted
from ..functions.text import bigrams, extract_terms, negative_text, term_frequency
from ..sources.tables import small, stage
from .scopes import in_scope
from .trigrams import trigram_lookup

K1, B = 1.2, 0.75
LIMIT = 200
SHORT_SCORE = -1e6
MAX_SHARE = 0.2
#: Scores are equal if they are up to this digit: the order in which a sum is made then doesn't part equal rows.
DIGITS = 9
#: Up to so many different terms are tested one by one; more by an automaton, of which one pass has so many characters at most.
FEW_TERMS, PATTERN_CHARS = 64, 8_000_000


def corpus_stats(queries: DataFrame, segments: DataFrame) -> DataFrame:
    """(query_id, n_docs, avg_len) of the segments in each query's scope, the length at least 1.

    The numbers are summed by video first, so that segments are read once, whatever the number of queries. Scopes meet these sums by
    video id, and queries without a scope the one row of all videos.
    """
    by_video = segments.groupBy("video_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    asked = queries.select("query_id", F.explode(F.array_distinct("scope")).alias("video_id")).join(by_video, "video_id").select("query_id", "n", "chars")
    whole = by_video.groupBy().agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).withColumn("_all", F.lit(True))
    free = queries.where("scope is null").select("query_id", F.lit(True).alias("_all")).join(F.broadcast(whole), "_all").select("query_id", "n", "chars")
    total = asked.unionByName(free).groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    n = F.coalesce("n", F.lit(0))
    return queries.select("query_id").join(total, "query_id", "left").select("query_id", n.cast("double").alias("n_docs"), F.greatest(F.coalesce(F.col("chars") / F.nullif(n, F.lit(0)), F.lit(1.0)), F.lit(1.0)).alias("avg_len"))


def _scanned_few(words: list[str], segments: DataFrame) -> DataFrame:
    """(low, id, video_id, len, lost): for each of the lower-cased words and each segment that holds it the content's length, and what of it
    is lost without the word. One pass over the segments, in which each text is lower-cased once; without Python."""
    listed = F.array(*[F.lit(w) for w in words])
    lost = lambda text, w: F.length("content") - F.length(F.replace(text, w, F.lit("")))
    inside = lambda text: F.transform(F.filter(listed, lambda w: F.contains(text, w)), lambda w: F.struct(w.alias("low"), lost(text, w).alias("lost")))
    found = F.flatten(F.transform(F.array(F.lower("content")), inside))
    return segments.select("id", "video_id", F.length("content").alias("len"), F.inline(found))


def _scanned_many(words: list[str], segments: DataFrame) -> DataFrame:
    """As _scanned_few, by one automaton of all words (none empty): the time of a text hardly depends on their number."""
    shared = segments.sparkSession.sparkContext.broadcast(tuple(words))
    low = F.lower("content")
    # lower case may be longer
    rows = segments.where("content is not null").select("id", "video_id", F.length("content").alias("len"), (F.length("content") - F.length(low)).alias("more"), low.alias("text"))
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "video_id")]

    def run(batches):
        names = pa.array(shared.value, pa.string())
        size = np.array([len(w) for w in shared.value])
        for b in batches:
            row, word, n = [], [], []
            for i, found in enumerate(counted(shared.value, b.column("text").to_pylist())):
                row += [i] * len(found)
                word += found.keys()
                n += found.values()
            at, word = pa.array(row, pa.int64()), np.array(word, np.int64)
            more = b.column("more").to_numpy()[np.array(row, np.int64)]
            lost = (np.array(n, np.int64) * size[word] + more).astype(np.int32)
            yield pa.record_batch([*(b.column(c).take(at) for c in ("id", "video_id", "len")), names.take(pa.array(word)), pa.array(lost)], ["id", "video_id", "len", "low", "lost"])

    return rows.mapInArrow(run, ", ".join([*kinds, "len int, low string, lost int"]))


def _slices(terms: DataFrame) -> Iterator[list[str]]:
    """The different words, in slices of at most PATTERN_CHARS characters."""
    held, size = [], 0
    for r in terms.select("low").where("low is not null").distinct().orderBy("low").toLocalIterator():
        if held and size + len(r.low) > PATTERN_CHARS:
            yield held
            held, size = [], 0
        held.append(r.low)
        size += len(r.low)
    if held:
        yield held


def term_hits(terms: DataFrame, segments: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(query_id, term, id, len, tf) for each term and segment in scope that holds it: the length of the segment's content and how often
    the term occurs.

    The segments are read once for all terms: up to FEW_TERMS different ones are tested one by one, more by an automaton. Only terms of more than PATTERN_CHARS
    characters together, which is as much as is broadcast, take another pass. With a trigram index terms of three or more characters are looked up in it instead.
    """
    some = terms.select("query_id", "term", "scope", F.lower("term").alias("low"))
    tf = lambda lost: (lost.cast("double") / F.greatest(F.length("term"), F.lit(1))).alias("tf")
    parts = []
    if index is not None:
        looked = trigram_lookup(some, index, segments)
        parts.append(looked.select("query_id", "term", "id", F.length("content").alias("len"), term_frequency(F.col("content"), F.col("term")).alias("tf")))
        some = some.where(F.length("term") < 3)
    for words in _slices(some):
        scans = [_scanned_few(words, segments)] if len(words) <= FEW_TERMS else [_scanned_few([w for w in words if not w], segments)] * (not words[0]) + [_scanned_many([w for w in words if w], segments)]
        for scan in scans:
            met = scan.join(small(some), "low").where(in_scope(F.col("scope"), F.col("video_id")))
            parts.append(met.select("query_id", "term", "id", "len", tf(F.col("lost"))))
    if not parts:
        kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", terms), ("id", segments))}
        return terms.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, term string, id {kinds['id']}, len int, tf double")
    return reduce(DataFrame.unionByName, parts)


def doc_freq(terms: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, term, n_hits), 0 for terms without a hit."""
    n = hits.groupBy("query_id", "term").agg(F.count("*").alias("n"))
    return terms.select("query_id", "term").join(n, ["query_id", "term"], "left").select("query_id", "term", F.coalesce("n", F.lit(0)).alias("n_hits"))


def bm25(terms: DataFrame, segments: DataFrame, limit: int | None = LIMIT, hits: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): the segments that hold any of a query's terms, the lower the better, at most `limit` of each
    query, equals by id. All figures are those of the query's scope."""
    hits = term_hits(terms, segments) if hits is None else hits
    stats = corpus_stats(terms.select("query_id", "scope").distinct(), segments)
    n = doc_freq(terms, hits).join(stats, "query_id")
    rows = hits.join(n, ["query_id", "term"])
    idf = F.log(1.0 + (F.col("n_docs") - F.col("n_hits") + 0.5) / (F.col("n_hits") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1.0)) / (F.col("tf") + K1 * (1.0 - B + B * F.col("len") / F.col("avg_len")))
    scores = rows.groupBy("query_id", "id").agg(F.round(-F.sum(part), DIGITS).alias("score"))
    if limit is None:
        return scores
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return scores.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def like_hits(terms: DataFrame, segments: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, term, id): segments in scope that hold the term; with a limit the lowest ids of each term."""
    found = term_hits(terms, segments).select("query_id", "term", "id")
    if limit is None:
        return found
    rank = F.row_number().over(Window.partitionBy("query_id", "term").orderBy("id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, scope, term) of each query's text."""
    return queries.select("query_id", "scope", F.explode(extract_terms(F.col(text))).alias("term"))


def route_terms(terms: DataFrame, segments: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(query_id, scope, term, channel): terms of three or more characters that occur in scope go to `bm25`; those that don't are
    cut into pieces of two, which go to `like` with the shorter terms, each once. hits: what term_hits found for the terms."""
    long = terms.where(F.length("term") >= 3)
    known = (term_hits(long, segments) if hits is None else hits).select("query_id", "term").distinct()
    kept = long.join(known, ["query_id", "term"], "left_semi").withColumn("channel", F.lit("bm25"))
    cut = long.join(known, ["query_id", "term"], "left_anti").select("query_id", "scope", F.explode(bigrams(F.col("term"))).alias("term"))
    short = terms.where(F.length("term") < 3).select("query_id", "scope", "term").union(cut).dropDuplicates(["query_id", "term"])
    return kept.select("query_id", "scope", "term", "channel").union(short.withColumn("channel", F.lit("like")))


def sparse_channel(queries: DataFrame, segments: DataFrame, candidates: DataFrame | None = None, text: str = "query", limit: int | None = LIMIT, like_limit: int | None = None, index: DataFrame | None = None, restrict: Callable[[DataFrame], DataFrame] | None = None, totals: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of the candidates (query_id, id), or of all segments in a query's scope, that the keywords find. Instead of
    all candidates `restrict` may say which of found rows (query_id, id, ...) are some, and totals (query_id, n) how many a query has.

    BM25 scores go first; a segment found by short terms only scores SHORT_SCORE. A short term that more than a fifth of
    a query's candidates hold says nothing and is left out. like_limit: consider only so many lowest ids for a short term.
    The segments are scanned once for all terms, and once more only if terms that don't occur are cut into pieces.
    """
    terms = stage(query_terms(queries, text))
    hits = stage(term_hits(terms, segments, index))
    routed = stage(route_terms(terms, segments, hits))
    known, short = routed.where("channel = 'bm25'"), routed.where("channel = 'like'")
    found = hits.join(short, ["query_id", "term"], "left_semi")
    cut = short.join(terms, ["query_id", "term"], "left_anti")
    if not cut.isEmpty():
        found = stage(found.unionByName(term_hits(cut, segments)))
    found = found.select("query_id", "term", "id")
    if like_limit is not None:
        rank = F.row_number().over(Window.partitionBy("query_id", "term").orderBy("id"))
        found = found.withColumn("_r", rank).where(F.col("_r") <= like_limit).drop("_r")
    scored = bm25(known, segments, limit, hits.join(known, ["query_id", "term"], "left_semi"))
    if restrict is not None:
        scored, found, total = restrict(scored), restrict(found), totals
    elif candidates is None:
        total = corpus_stats(queries.select("query_id", "scope"), segments).select("query_id", F.col("n_docs").alias("n"))
    else:
        scored, found = (x.join(candidates, ["query_id", "id"], "left_semi") for x in (scored, found))
        total = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
    rare = found.groupBy("query_id", "term").agg(F.count("*").alias("k")).join(total, "query_id").where(F.col("k") <= MAX_SHARE * F.col("n"))
    only = found.join(rare, ["query_id", "term"], "left_semi").select("query_id", "id").distinct().withColumn("score", F.lit(SHORT_SCORE))
    return scored.unionByName(only).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def negated_segments(queries: DataFrame, segments: DataFrame, candidates: DataFrame | None = None, limit: int | None = None, **options) -> DataFrame:
    """(query_id, id): the candidates, or all segments in a query's scope, that the negated part of a query finds; options: as in
    sparse_channel."""
    negative = queries.withColumn("_neg", negative_text(F.col("query"))).where("trim(_neg) <> ''")
    return sparse_channel(negative, segments, candidates, "_neg", limit, **options).select("query_id", "id")


def exclude_negated(queries: DataFrame, segments: DataFrame, candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """The candidates without those that a negation finds; without any negated query they are as they were."""
    negated = queries.where(F.trim(negative_text(F.col("query"))) != "")
    if negated.isEmpty():
        return candidates
    of = stage(candidates.join(negated.select("query_id"), "query_id", "left_semi").select("query_id", "id"))  # read several times
    return candidates.join(negated_segments(negated, segments, of, limit), ["query_id", "id"], "left_anti")
