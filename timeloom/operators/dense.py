"""The vector channel: exhaustive cosine scores of query vectors against segment vectors.

Queries come as (query_id, variant, vector), several variants each; the best one counts. The query matrix is broadcast in
slices of bounded size, and each Arrow batch of vectors is multiplied with it at once. Pairs leave a task only where asked for:
the best of each batch, or those with named queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scoring import cosine
from ..sources.tables import small, stage

#: Query rows that are broadcast at once; more are worked off in several passes.
MAX_QUERIES = 4_096
#: Scores that a task holds at once: rows of a batch times queries.
MOST_SCORES = 2_000_000
#: Rows of best scores that a task holds before it keeps only the best of them.
HELD = 200_000
#: Vectors of one video that meet its queries in a task.
PART_ROWS = 1_000
#: Scores are equal if they are up to this digit.
DIGITS = 9


def unit(vector):
    """The vector as an array of doubles of length 1, or null if it is null or of length 0."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _best(units: np.ndarray, queries: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each row and query the highest product over the query's variants; owner is sorted and has every query."""
    product = units @ queries.T
    return np.maximum.reduceat(product, np.searchsorted(owner, np.arange(n)), axis=1)


def _slices(batches, queries: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that rows times queries stay within MOST_SCORES."""
    step = max(1, MOST_SCORES // max(queries, 1))
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def query_slices(queries: DataFrame) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(query ids, matrix, owner) of at most about MAX_QUERIES rows each; a query's variants stay together."""
    rows = queries.select("query_id", unit(F.col("vector")).alias("v")).where("v is not null").orderBy("query_id")
    held: list = []
    for r in rows.toLocalIterator():
        if len(held) >= MAX_QUERIES and held[-1].query_id != r.query_id:
            yield _slice(held)
            held = []
        held.append(r)
    if held:
        yield _slice(held)


def _slice(rows: list) -> tuple[list, np.ndarray, np.ndarray]:
    ids = list(dict.fromkeys(r.query_id for r in rows))
    place = {q: i for i, q in enumerate(ids)}
    return ids, np.array([r.v for r in rows]), np.array([place[r.query_id] for r in rows])


def _by_id(ids: pa.Array, scores: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Each different id of a batch with the best of its rows' scores."""
    coded = ids.dictionary_encode(null_encoding="encode")
    code = np.asarray(coded.indices)
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
    return coded.dictionary, np.maximum.reduceat(scores[order], first, axis=0)


def _first_k(held: list[tuple[np.ndarray, pa.Array, np.ndarray]], k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of parts (query, id, score) the k best rows of each query, and what equals the last of them."""
    j, s = (np.concatenate([x[i] for x in held]) for i in (0, 2))
    order = np.lexsort((-s, j))
    j, s = j[order], s[order]
    start = np.searchsorted(j, j)
    last = np.minimum(start + k - 1, np.searchsorted(j, j, side="right") - 1)
    keep = s >= s[last] - 10.0**-DIGITS
    return j[keep], pa.concat_arrays([x[1] for x in held]).take(pa.array(order[keep])), s[keep]


def vector_scores(queries: DataFrame, vectors: DataFrame, id_col: str = "id", vector_col: str = "vector", top: int | None = None, best_of_id: bool = False) -> DataFrame:
    """(query_id, id_col, score): the best cosine over each query's variants, for all rows, or for at least the `top` best rows of
    each query in each task (equals at the end included), or with best_of_id for the best row of each id in each batch. Rows without a vector are left out; one of
    length 0 scores 0."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    q_kind = queries.schema["query_id"].dataType.simpleString()
    q_type = to_arrow_type(queries.schema["query_id"].dataType)
    rows = vectors.where(F.col(vector_col).isNotNull()).select(id_col, F.coalesce(unit(F.col(vector_col)), F.transform(vector_col, lambda x: F.lit(0.0))).alias("_u"))
    out, names = None, ["query_id", id_col, "score"]
    for ids, matrix, owner in query_slices(queries):
        shared = spark.sparkContext.broadcast((ids, matrix, owner))

        def run(batches, shared=shared):
            ids, matrix, owner = shared.value
            q = pa.array(ids, q_type)
            held, size = [], 0
            for b in _slices(batches, len(ids)):
                scores, of = _best(_matrix(b.column("_u")), matrix, owner, len(ids)), b.column(id_col)
                if best_of_id and len(scores):
                    of, scores = _by_id(of, scores)
                if top is not None and top < len(scores):
                    floor = np.partition(scores, len(scores) - top, axis=0)[len(scores) - top]
                    i, j = np.nonzero(scores >= floor - 10.0**-DIGITS)
                else:
                    i, j = (x.ravel() for x in np.indices(scores.shape))
                if top is None:
                    yield pa.record_batch([q.take(pa.array(j)), of.take(pa.array(i)), pa.array(scores[i, j])], names)
                    continue
                held.append((j, of.take(pa.array(i)), scores[i, j]))
                size += len(i)
                if size > max(HELD, 2 * top * len(ids)):
                    held = [_first_k(held, top)]
                    size = len(held[0][0])
            if held:
                j, found, s = _first_k(held, top)
                yield pa.record_batch([q.take(pa.array(j)), found, pa.array(s)], names)

        part = rows.mapInArrow(run, f"query_id {q_kind}, `{id_col}` {kind}, score double")
        out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.createDataFrame([], f"query_id {q_kind}, `{id_col}` {kind}, score double")
    return out


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, id_col, score): each query's k best rows, equals by id."""
    scores = vector_scores(queries, vectors, id_col, vector_col, top=k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), id_col))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def pair_scores(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """For rows (query_id, ..., vector) of few candidates: score, the best cosine over the query's variants, without Python."""
    q = queries.groupBy("query_id").agg(F.collect_list("vector").alias("_variants"))
    best = F.array_max(F.transform("_variants", lambda v: cosine(v, F.col("vector"))))
    return rows.join(q, "query_id").withColumn("score", F.when(F.col("vector").isNotNull(), best)).drop("_variants")


def scores_in_videos(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, id, score): the cosines of queries (query_id, video_id, vector) and the vectors (id, video_id, vector) of their video, without
    Python; 0 if either has length 0. Lengths are computed once a row, not once a pair, and a video's vectors are dealt to parts of about PART_ROWS
    rows, each of which meets the video's queries, so that few videos spread over many tasks."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    doubles = F.transform("vector", lambda x: x.cast("double"))
    parts = stage(vectors.groupBy("video_id").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts")))
    q = queries.select("query_id", "video_id", doubles.alias("q"), length.alias("q_length")).join(small(parts), "video_id")
    q = q.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    v = vectors.select("id", "video_id", doubles.alias("v"), length.alias("v_length")).join(small(parts), "video_id")
    v = v.withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
    # so many tasks as there are parts: their bytes are few, but not the pairs
    n = parts.agg(F.sum("_parts")).first()[0] or 1
    q, v = (x.repartition(n, "video_id", "_part") for x in (q, v))
    norm = F.col("q_length") * F.col("v_length")
    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return q.join(v, ["video_id", "_part"]).select("query_id", "id", F.when(norm == 0, 0.0).otherwise(dot / norm).alias("score"))


def event_scores(queries: DataFrame, events: DataFrame) -> DataFrame:
    """(query_id, segment_id, score): the best score of each segment's text events; events without a segment or vector count
    for nothing. A task's part sends one row for each query and segment, however many events the segment has."""
    of = events.where("segment_id is not null and embedding is not null").select("segment_id", F.col("embedding").alias("vector"))
    scores = vector_scores(queries, of, "segment_id", best_of_id=True)
    return scores.groupBy("query_id", "segment_id").agg(F.max("score").alias("score"))


MODALITIES = ("transcript", "visual", "ocr")
#: Text events of a segment that go with it; of segments with more the scores are joined.
MOST_EVENTS = 1_000


def modality_scores(b: pa.RecordBatch, matrix: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """For each modality the scores of rows by queries, NaN where a row has no vector; the vectors of its text events raise its on-screen text's."""
    out = []
    for m in MODALITIES:
        has = b.column(m).is_valid().to_numpy(zero_copy_only=False)
        s = np.full((b.num_rows, n), np.nan)
        if has.any():
            s[has] = _best(_matrix(b.column(m).drop_null()), matrix, owner, n)
        out.append(s)
    has = np.flatnonzero(b.column("events").is_valid().to_numpy(zero_copy_only=False))
    if len(has):
        lists = b.column("events").drop_null()
        size = np.asarray(pc.list_value_length(lists))
        flat = _best(_matrix(lists.flatten()), matrix, owner, n)
        out[2][has] = np.fmax(out[2][has], np.maximum.reduceat(flat, np.cumsum(size) - size, axis=0))
    return out


def dense_channel(queries: DataFrame, segments: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(query_id, id, transcript_score, visual_score, ocr_score, similarity) for the segments with any vector.

    segments have three array columns `*_embedding`, of which any may be null. Text events raise the on-screen text's score; their vectors go to
    their segment, and all are scored in one pass, so that no pair of a query and a segment is shuffled.
    """
    spark = segments.sparkSession
    types = {c: df.schema[c].dataType for c, df in (("query_id", queries), ("id", segments))}
    q_type = to_arrow_type(types["query_id"])
    zero = lambda c: F.transform(c, lambda x: F.lit(0.0))
    vectors = [F.coalesce(unit(F.col(f"{m}_embedding")), zero(f"{m}_embedding")).alias(m) for m in MODALITIES]
    rows = segments.select("id", *vectors)
    crowded = None
    if events is None:
        rows = rows.withColumn("events", F.lit(None).cast("array<array<double>>"))
    else:
        some = events.where("segment_id is not null and embedding is not null")
        crowded = stage(some.groupBy("segment_id").agg(F.count("*").alias("n")).where(F.col("n") > MOST_EVENTS).select("segment_id"))
        of = some.join(crowded, "segment_id", "left_anti").select(F.col("segment_id").cast(types["id"]).alias("id"), F.coalesce(unit(F.col("embedding")), zero("embedding")).alias("v"))
        rows = rows.join(of.groupBy("id").agg(F.collect_list("v").alias("events")), "id", "left")
    rows = stage(rows)
    names = ["query_id", "id", *(f"{m}_score" for m in MODALITIES), "similarity"]
    schema = f"query_id {types['query_id'].simpleString()}, id {types['id'].simpleString()}, " + ", ".join(f"{n} double" for n in names[2:])
    out = spark.createDataFrame([], schema)
    for part in query_slices(queries):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            ids, matrix, owner = shared.value
            q = pa.array(ids, q_type)
            for b in _slices(batches, len(ids)):
                scores = modality_scores(b, matrix, owner, len(ids))
                best = np.fmax.reduce(scores)
                i, j = np.nonzero(~np.isnan(best))
                yield pa.record_batch([q.take(pa.array(j)), b.column("id").take(pa.array(i)), *(pa.array(s[i, j], from_pandas=True) for s in (*scores, best))], names)

        out = out.unionAll(rows.mapInArrow(run, schema))
    if crowded is None or crowded.isEmpty():
        return out
    of = event_scores(queries, events.join(crowded, "segment_id", "left_semi")).select("query_id", F.col("segment_id").cast(types["id"]).alias("id"), F.col("score").alias("_event"))
    joined = out.join(of.join(segments.select("id"), "id", "left_semi").select("query_id", "id", "_event"), ["query_id", "id"], "full_outer")
    return joined.select("query_id", "id", *names[2:4], F.greatest("ocr_score", "_event").alias("ocr_score"), F.greatest("similarity", "_event").alias("similarity"))


def video_texts(videos: DataFrame) -> DataFrame:
    """(video_id, text) by which a video is judged: its summary, or its title where there is none."""
    return videos.select(F.col("id").alias("video_id"), F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("title")).alias("text"))


def relevant_videos(scores: DataFrame, least: float = 0.10, margin: float = 0.15) -> DataFrame:
    """From (query_id, video_id, score) the videos within `margin` of each query's best, for queries with two or more videos and
    a best of at least `least`; the other queries have no rows, which means no filter."""
    w = Window.partitionBy("query_id")
    best = scores.withColumn("_max", F.max("score").over(w)).withColumn("_n", F.count("*").over(w))
    return best.where((F.col("_n") > 1) & (F.col("_max") >= least) & (F.col("score") >= F.col("_max") - margin)).select("query_id", "video_id")


def _near_the_best(scores: np.ndarray, video: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(video, query, score) of each video's best score where it is near the query's best or one of its best two; video is sorted."""
    first = np.flatnonzero(np.r_[True, video[1:] != video[:-1]])
    best = np.maximum.reduceat(scores, first, axis=0)
    floor = best.max(axis=0) - margin - 10.0 ** (2 - DIGITS)
    if len(best) > 1:
        floor = np.minimum(floor, np.partition(best, len(best) - 2, axis=0)[len(best) - 2])
    i, j = np.nonzero((best >= floor) & (best > -np.inf))
    return video[first][i], j, best[i, j]


def relevant_of_vectors(queries: DataFrame, vectors: DataFrame, least: float = 0.10, margin: float = 0.15) -> DataFrame:
    """As relevant_videos, where a video scores by the best of its vectors (id, video_id, vector) other than the query's own.

    No pair of a query and a vector leaves a task: of each part of a batch the best score of each video does, if it is near enough to the
    query's best there. The best two videos always do, so that a query has one video just if it has one in all.
    """
    spark = vectors.sparkSession
    kinds = {"query_id": queries.schema["query_id"].dataType, "video_id": vectors.schema["video_id"].dataType}
    schema = f"query_id {kinds['query_id'].simpleString()}, video_id {kinds['video_id'].simpleString()}, score double"
    q_type = to_arrow_type(kinds["query_id"])
    rows = vectors.where("vector is not null").select("id", "video_id", F.coalesce(unit(F.col("vector")), F.transform("vector", lambda x: F.lit(0.0))).alias("_u"))
    out = spark.createDataFrame([], schema)
    for part in query_slices(queries):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            ids, matrix, owner = shared.value
            q = pa.array(ids, q_type)
            names = q.cast(pa.string())
            for b in _slices(batches, len(ids)):
                scores = _best(_matrix(b.column("_u")), matrix, owner, len(ids))
                own = pc.index_in(b.column("id").cast(pa.string()), value_set=names, skip_nulls=True).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(~np.isnan(own))
                scores[at, own[at].astype(np.int64)] = -np.inf
                video = pc.dictionary_encode(b.column("video_id"), null_encoding="encode")
                code = video.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                i, j, s = _near_the_best(scores[order], code[order], margin)
                yield pa.record_batch([q.take(pa.array(j)), video.dictionary.take(pa.array(i)), pa.array(s)], ["query_id", "video_id", "score"])

        out = out.unionAll(rows.mapInArrow(run, schema))
    best = out.groupBy("query_id", "video_id").agg(F.round(F.max("score"), DIGITS).alias("score"))
    return relevant_videos(best, least, margin)


def prefilter_videos(candidates: DataFrame, relevant: DataFrame) -> DataFrame:
    """The candidates (query_id, video_id, ...) in relevant videos, and all of those queries that have none."""
    filtered = relevant.select("query_id").distinct()
    kept = candidates.join(relevant, ["query_id", "video_id"], "left_semi")
    return kept.unionByName(candidates.join(filtered, "query_id", "left_anti"))


def query_variants(queries: DataFrame, *translations: str) -> DataFrame:
    """(query_id, variant): the distinct texts of the query and its translations; null translations are left out."""
    texts = F.array_distinct(F.array_compact(F.array("query", *translations)))
    return queries.select("query_id", F.explode(texts).alias("variant"))
