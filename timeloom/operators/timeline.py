"""From cuts, utterances and text candidates to segments: ordered folds and interval joins, by video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dominant_word, has_text, nfkc
from ..functions.times import sample_times
from ..sources.tables import look_up, stage
from .folds import ordered_fold
from .intervals import with_overlapping
from .ordered import has_hot_key, previous, ranged, running, unranged

MERGE_BELOW, SPLIT_ABOVE, SPLIT_TARGET = 8.0, 12.0, 10.0
NO_SPEECH = 0.7
DOMINANCE, MIN_RUN = 0.5, 3
MIN_CONFIDENCE, PAD = 0.3, 1.0
#: Width of the cells in which time ranges meet; normalised scenes are about so long.
CELL = 12.0


def scene_ranges(cuts: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, start_sec, end_sec): the cuts' ranges, and the whole video where there is none; videos: (video_id, duration_sec)."""
    found = videos.select("video_id", "duration_sec").join(cuts, "video_id", "left")
    return found.select("video_id", F.coalesce("start_sec", F.lit(0.0)).alias("start_sec"), F.coalesce("end_sec", F.col("duration_sec").cast("double")).alias("end_sec"))


def _merging(video, piece, least: float):
    """Puts a piece's scenes together: gives (scene, is_last, is_rest), the rest being what no scene of the piece could take."""
    done = begin = end = None

    def out(scene, is_last=False, is_rest=False):
        return {"video_id": video, "piece": piece, "start_sec": scene[0], "end_sec": scene[1], "is_last": is_last, "is_rest": is_rest}

    def step(row):
        nonlocal done, begin, end
        found = []
        if row is None:
            if begin is not None and done is None:
                return [out((begin, end), is_rest=True)]
            return [out(done if begin is None else (done[0], end), is_last=True)] if done else []
        begin, end = row["start_sec"] if begin is None else begin, row["end_sec"]
        if end - begin >= least:
            found = [out(done)] if done else []
            done, begin = (begin, end), None
        return found

    return step


def merge_short(scenes: DataFrame, least: float = MERGE_BELOW) -> DataFrame:
    """Scenes put together from left to right until they are `least` seconds long; what is left at the end joins the scene
    before it, or stands alone.

    One sorted pass of each video, whose last whole scene is all that is held. Where a video has very many scenes they are cut into pieces after each scene that is
    long by itself, since nothing open outlasts it; the pieces of all videos are then merged side by side, and what is left of a last piece joins the last
    scene of the piece before.
    """
    kind = scenes.schema["video_id"].dataType.simpleString()
    rows = scenes.select("video_id", F.col("start_sec").cast("double").alias("start_sec"), F.col("end_sec").cast("double").alias("end_sec"))
    schema = f"video_id {kind}, piece bigint, start_sec double, end_sec double, is_last boolean, is_rest boolean"
    if not has_hot_key(rows, "video_id"):
        found = ordered_fold(rows, "video_id", ["start_sec", "end_sec"], lambda video: _merging(video, 0, least), schema)
        return found.select("video_id", "start_sec", "end_sec")
    long = (F.col("end_sec") - F.col("start_sec") >= least).cast("bigint")
    parts = unranged(running(ranged(rows, "video_id", ["start_sec", "end_sec"]), "video_id", sums={"piece": long}))
    keyed = parts.select(F.struct("video_id", "piece").alias("k"), "start_sec", "end_sec")
    merged = stage(ordered_fold(keyed, "k", ["start_sec", "end_sec"], lambda k: _merging(k["video_id"], k["piece"], least), schema))
    alone = F.col("is_rest") & (F.col("piece") == 0)
    rests = merged.where(F.col("is_rest") & ~alone).select(F.col("video_id").alias("_v"), (F.col("piece") - 1).alias("_p"), F.col("end_sec").alias("_end"))
    same = F.col("video_id").eqNullSafe(F.col("_v")) & (F.col("piece") == F.col("_p")) & F.col("is_last")
    joined = merged.where(~F.col("is_rest") | alone).join(rests, same, "left")
    return joined.select("video_id", "start_sec", F.coalesce("_end", "end_sec").alias("end_sec"))


def split_long(scenes: DataFrame, above: float = SPLIT_ABOVE, target: float = SPLIT_TARGET, least: float = MERGE_BELOW) -> DataFrame:
    """Scenes longer than `above` cut into equal pieces near `target` seconds, none shorter than `least`, with the length
    before the cut as source_raw_duration."""
    length = F.col("end_sec") - F.col("start_sec")
    n = F.when(length <= above, 1).otherwise(F.greatest(F.lit(1), F.least(F.bround(length / target).cast("int"), F.floor(length / least).cast("int"))))
    rows = scenes.select("*", length.alias("_len"), n.alias("_n")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    piece = F.col("_len") / F.col("_n")
    # the last piece of an uncut scene ends where the scene ends
    end = F.when(F.col("_n") == 1, F.col("end_sec")).otherwise(F.col("start_sec") + (F.col("_i") + 1) * piece)
    return rows.select("video_id", (F.col("start_sec") + F.col("_i") * piece).alias("start_sec"), end.alias("end_sec"), F.col("_len").alias("source_raw_duration"))


def normalise_scenes(scenes: DataFrame) -> DataFrame:
    """Merged, split and numbered (scene_idx from 0 on) in each video."""
    split = split_long(merge_short(scenes))
    return split.withColumn("scene_idx", F.row_number().over(Window.partitionBy("video_id").orderBy("start_sec", "end_sec")) - 1)


def align_transcript(scenes: DataFrame, utterances: DataFrame, width: float = CELL) -> DataFrame:
    """scenes (video_id, scene_idx, start_sec, end_sec) with transcript: the texts of all overlapping utterances in their order, joined
    by a space ('' without any), and their mean no_speech_prob and avg_logprob and highest compression_ratio; width: about a scene's."""
    u = utterances.select("video_id", "start_sec", "end_sec", "text", "no_speech_prob", "avg_logprob", "compression_ratio", F.monotonically_increasing_id().alias("_n"))
    times = ("video_id", "start_sec", "end_sec")
    rows = scenes.select(*times, F.struct(*[c for c in scenes.columns if c not in times]).alias("_own"), F.monotonically_increasing_id().alias("_row"))
    said = F.when(F.col("r_start").isNotNull(), F.struct("r_start", "r_end", "_n", "text"))
    texts = F.transform(F.array_sort(F.collect_list(said)), lambda x: x["text"])
    of = with_overlapping(rows, u, width=width).groupBy("video_id", "_level", "_home", "_row")
    found = of.agg(F.first(F.struct("start_sec", "end_sec", "_own")).alias("_scene"), F.trim(F.array_join(texts, " ")).alias("transcript"), F.avg("no_speech_prob").alias("no_speech_prob"), F.avg("avg_logprob").alias("avg_logprob"), F.max("compression_ratio").alias("compression_ratio"))
    found = found.select("video_id", "_scene.*", "transcript", "no_speech_prob", "avg_logprob", "compression_ratio")
    return found.select(*[c if c in times else F.col(f"_own.{c}").alias(c) for c in scenes.columns], "transcript", "no_speech_prob", "avg_logprob", "compression_ratio")


def is_hallucinated(no_speech_prob: Column, most: float = NO_SPEECH) -> Column:
    return F.coalesce(no_speech_prob > most, F.lit(False))


def runs(df: DataFrame, group: str, order: list, word: Column, qualifies: Column, least: int = MIN_RUN) -> DataFrame:
    """Adds run_length and in_run: consecutive qualifying rows with one word are a run; those of runs of `least` rows or more are
    in_run. A group with very many rows is worked off in ranges."""
    rows = df.withColumn("_w", F.when(qualifies, word))
    changes = lambda before: ((~F.col("_w").eqNullSafe(before)) | F.col("_w").isNull()).cast("int")
    if has_hot_key(df, group):
        rows = previous(ranged(rows, group, order), group, _before=F.col("_w")).withColumn("_c", changes(F.col("_before")))
        rows = stage(unranged(running(rows, group, sums={"_run": F.col("_c")})).withColumn("_run", F.col("_run") + F.col("_c")).drop("_before"))
        n = stage(rows.groupBy(group, "_run").agg(F.count("*").alias("_n")).withColumn("_weight", F.col("_n")))
        rows = look_up(rows, n, [group, "_run"], "_weight", n.agg(F.sum("_n")).first()[0] or 0)
    else:
        w = Window.partitionBy(group).orderBy(*order)
        rows = rows.withColumn("_c", F.when(F.row_number().over(w) == 1, 1).otherwise(changes(F.lag("_w").over(w)))).withColumn("_run", F.sum("_c").over(w))
        rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(group, "_run")))
    length = F.when(F.col("_w").isNotNull(), F.col("_n")).otherwise(0)
    return rows.withColumn("run_length", length).withColumn("in_run", F.col("run_length") >= least).drop("_w", "_c", "_run", "_n")


def repetitive_transcripts(scenes: DataFrame, transcript: str = "transcript") -> DataFrame:
    """Adds is_repetitive: the scene is in a run of three or more in a row that one and the same word makes up by half or more."""
    best = dominant_word(F.col(transcript))
    rows = scenes.withColumn("_d", best)
    found = runs(rows, "video_id", ["scene_idx"], F.col("_d.word"), F.col("_d.share") >= DOMINANCE)
    return found.withColumnRenamed("in_run", "is_repetitive").drop("_d", "run_length")


def transcript_for_index(scenes: DataFrame) -> DataFrame:
    """Adds index_transcript: the transcript if there is one and nothing marks it as unreliable, else null."""
    fine = has_text("transcript") & ~is_hallucinated(F.col("no_speech_prob")) & ~F.col("is_repetitive")
    return scenes.withColumn("index_transcript", F.when(fine, F.col("transcript")))


def attach_model_output(scenes: DataFrame, outputs: DataFrame) -> DataFrame:
    """Scenes with visual_description, ocr_text and vlm_frame_count of their output; '' , null and 0 where it failed."""
    joined = scenes.join(outputs.select("video_id", "scene_idx", "visual_description", "ocr_text", "vlm_frame_count"), ["video_id", "scene_idx"], "left")
    return joined.withColumn("visual_description", F.coalesce("visual_description", F.lit(""))).withColumn("vlm_frame_count", F.coalesce("vlm_frame_count", F.lit(0)))


def ocr_gap(segments: DataFrame) -> DataFrame:
    """Segments whose model output has no on-screen text."""
    return segments.where(~has_text("ocr_text"))


def ocr_schedule(scenes: DataFrame, budget: float | None = None, cost: Column | float = 1.0) -> DataFrame:
    """(video_id, scene_idx, round, at_sec, position): when to look at which scene, every scene's first time before any second; with a
    budget, without what comes after the costs used it up. A video with very many looks is worked off in ranges."""
    times = scenes.select("video_id", "scene_idx", F.posexplode(sample_times(F.col("start_sec"), F.col("end_sec"))).alias("round", "at_sec"))
    each = F.lit(cost) if isinstance(cost, float) else cost
    if has_hot_key(times, "video_id"):
        rows = running(ranged(times, "video_id", ["round", "scene_idx"]), "video_id", sums={"_n": F.lit(1), "_spent": each})
        rows = unranged(rows).withColumn("position", (F.col("_n") + 1).cast("int")).drop("_n")
    else:
        w = Window.partitionBy("video_id").orderBy("round", "scene_idx")
        spent = F.coalesce(F.sum(each).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rows = times.withColumn("position", F.row_number().over(w)).withColumn("_spent", spent)
    return (rows if budget is None else rows.where(F.col("_spent") <= budget)).drop("_spent")


def merge_ocr(hits: DataFrame, scenes: DataFrame) -> DataFrame:
    """One event for each scene and normalised text: hits (video_id, scene_idx, frame_sec, text, confidence, bbox) of enough
    confidence, the time a second wider than the frames but inside the scene, raw text and box of the most certain hit, of
    equals the first."""
    rows = hits.where(F.col("confidence") >= MIN_CONFIDENCE).withColumn("resolved_text", nfkc("text")).where("resolved_text <> ''")
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    best = F.max_by(F.struct("frame_sec", "text", "confidence", "bbox"), F.struct("confidence", (-F.col("frame_sec")).alias("f"), (-F.col("_n")).alias("n")))
    found = rows.groupBy("video_id", "scene_idx", "resolved_text").agg(F.min("frame_sec").alias("_lo"), F.max("frame_sec").alias("_hi"), best.alias("_b"))
    joined = found.join(scenes.select("video_id", "scene_idx", "start_sec", "end_sec"), ["video_id", "scene_idx"])
    return joined.select("video_id", "scene_idx", F.greatest("start_sec", F.col("_lo") - PAD).alias("start_sec"), F.least("end_sec", F.col("_hi") + PAD).alias("end_sec"), F.col("_b.frame_sec").alias("frame_sec"), F.col("_b.text").alias("raw_text"), "resolved_text", F.col("_b.confidence").alias("confidence"), F.col("_b.bbox").alias("bbox"))


def budget_cut(items: DataFrame, key: str, order: list, cost: str, budget: float, batch: int = 2) -> DataFrame:
    """The items in order by batches of `batch`, up to and with the batch in which the running cost exceeds the budget. A key with very many
    items is worked off in ranges."""
    beyond = F.when(F.col("_total") > budget, F.col("_batch"))
    if has_hot_key(items, key):
        rows = running(ranged(items, key, order), key, sums={"_n": F.lit(1), "_spent": F.col(cost)})
        rows = rows.withColumn("_batch", F.floor(F.col("_n") / batch)).withColumn("_total", F.col("_spent") + F.coalesce(cost, F.lit(0)))
        rows = unranged(running(rows, key, least={"_over": beyond})).drop("_n", "_spent")
    else:
        w = Window.partitionBy(key).orderBy(*order)
        rows = items.withColumn("_batch", F.floor((F.row_number().over(w) - 1) / batch)).withColumn("_total", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("_over", F.min(beyond).over(Window.partitionBy(key)))
    return rows.where(F.col("_over").isNull() | (F.col("_batch") <= F.col("_over"))).drop("_batch", "_total", "_over")
