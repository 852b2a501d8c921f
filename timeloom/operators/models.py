"""The seam to models: a batch function that the user supplies, run on the executors."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import has_text, strip_generic_terms
from ..sources.tables import look_up, shared_path, stage
from .dense import query_variants

#: fn(list of dicts) gives for each one a dict of the output columns and cost_usd, or raises.
BatchFn = Callable[[list[dict]], list[dict]]


class RateLimited(Exception):
    """Raised by a batch function that should be asked again."""


def apply_model(df: DataFrame, in_cols: list[str], fn: BatchFn, out_schema: str, retries: int = 2, wait: float = 1.0, batch: int = 32) -> DataFrame:
    """df with the output columns, cost_usd and error. A batch that fails is asked again row by row, so that a row's failure is its
    own: null outputs, no cost, and what went wrong. Limits of rate are waited for and tried again."""
    out = T.StructType.fromDDL(out_schema)
    schema = T.StructType([*df.schema.fields, *out.fields]).add("cost_usd", "double").add("error", "string")
    columns, names = df.columns, [*out.names, "cost_usd", "error"]
    target = to_arrow_schema(schema)

    def ask(rows: list[dict]) -> list[dict]:
        for attempt in range(retries + 1):
            try:
                return fn(rows)
            except RateLimited:
                if attempt == retries:
                    raise
                time.sleep(wait * 2**attempt)
        return []

    def answers(rows: list[dict]) -> list[dict]:
        try:
            found = ask(rows)
            if len(found) != len(rows):
                raise ValueError(f"{len(found)} answers to {len(rows)} rows")
            return [x | {"error": None} for x in found]
        except Exception as e:  # noqa: BLE001  the caller's function may raise anything
            return [x for r in rows for x in answers([r])] if len(rows) > 1 else [{"cost_usd": 0.0, "error": f"{type(e).__name__}: {e}"}]

    def run(batches):
        for b in batches:
            rows = b.select(in_cols).to_pylist()
            got = [x for i in range(0, len(rows), batch) for x in answers(rows[i : i + batch])]
            added = [pa.array([x.get(n) for x in got], target.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(target.field(c).type) for c in columns), *added], schema=target)

    return df.mapInArrow(run, schema)


#: The columns by which a text is known, and how many rows a wave of questions has, about.
KEY, WAVE = ["_h1", "_h2"], 100_000


def _key(*columns: str) -> list[Column]:
    """128 bits of some columns; nulls differ from empty texts."""
    values = [*[F.col(c).isNull() for c in columns], *[F.col(c) for c in columns]]
    return [F.xxhash64(F.lit(seed), *values).alias(n) for seed, n in enumerate(KEY)]


def answered(rows: DataFrame, in_cols: list[str], fn: BatchFn, out_schema: str, ledger: str | None = None, wave: int | None = None, **options) -> DataFrame:
    """As apply_model for rows (KEY, ...) of different keys, with answers that are kept: what the ledger, a folder, has is not asked again.

    Questions go out in waves, and a wave's answers are in the ledger before the next one begins. So a job that stops half-way, or is run again, asks the rest
    only (and what had failed), and pays at most one wave twice. Without a ledger the answers lie in the shared folder of this session.
    """
    spark = rows.sparkSession
    path = ledger or shared_path(spark, "answers")
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(out_schema).fields]).add("cost_usd", "double").add("error", "string")
    exists = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists)
    rows = stage(rows)
    todo = rows if not known else stage(rows.join(spark.read.schema(schema).parquet(path).where("error is null").select(*KEY), KEY, "left_anti"))
    waves = -(-todo.count() // (wave or WAVE))
    for i in range(waves):
        part = todo.where(F.pmod(F.xxhash64(*KEY), F.lit(waves)) == i) if waves > 1 else todo
        apply_model(part, in_cols, fn, out_schema, **options).write.mode("append").parquet(path)
    if not known and not waves:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(path)
    if not known:
        return found
    own = [c for c in found.columns if c not in KEY]
    best = found.groupBy(*KEY).agg(F.min_by(F.struct(*own), F.col("error").isNotNull()).alias("_a"))  # an answer rather than an old failure
    return best.join(rows.select(*KEY), KEY, "left_semi").select(*KEY, *[F.col(f"_a.{c}").alias(c) for c in own]).select(*found.columns)


def embed_columns(segments: DataFrame, columns: dict[str, str], fn: BatchFn, ledger: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """segments with a vector column for each text column of `columns` (text: vector), and the ledger (text, cost_usd, error). Each
    distinct non-empty text is sent once, and not at all if the folder `ledger` has its answer. Texts are known by 128-bit hashes; a text that many rows have reaches them
    by its weight, so that they don't meet in one task."""
    parts = [segments.where(has_text(c)).select(F.col(c).alias("text"), *_key(c)) for c in columns]
    texts = reduce(DataFrame.unionByName, parts)
    once = texts.groupBy(*KEY).agg(F.count("*").alias("_weight"), F.any_value("text").alias("text"))
    embedded = answered(once, ["text"], fn, "vector array<float>", ledger, **options)
    total = embedded.agg(F.sum("_weight")).first()[0] or 0
    for c, v in columns.items():
        vectors = embedded.select(*KEY, "_weight", F.col("vector").alias(v))
        segments = look_up(segments.select("*", *_key(c)), vectors, KEY, "_weight", total, "left").drop(*KEY)
    return segments, embedded.select("text", "cost_usd", "error")


def _asked(rows: DataFrame, in_cols: list[str], fn: BatchFn, out_schema: str, ledger: str | None, **options) -> DataFrame:
    """apply_model for rows that are different, with answers that a ledger keeps or, without one, this session does."""
    if ledger is None:
        return stage(apply_model(rows, in_cols, fn, out_schema, **options))
    return answered(rows.select("*", *_key(*rows.columns)), in_cols, fn, out_schema, ledger, **options).drop(*KEY)


def prepare_queries(queries: DataFrame, translate: BatchFn, embed: BatchFn, ledger: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(query_id, variant, vector) of each query's text and translations (columns zh, en), and the cost of each query; a failed translation
    leaves the text alone. Vectors and costs come from the same answers; a ledger (two folders below it) spares what was asked before."""
    of = lambda name: None if ledger is None else f"{ledger}/{name}"
    cleaned = queries.select("query_id", strip_generic_terms(F.col("query")).alias("query"))
    translated = _asked(cleaned, ["query"], translate, "zh string, en string", of("translations"), **options)
    variants = query_variants(translated, "zh", "en")
    embedded = _asked(variants, ["variant"], lambda rows: embed([{"text": r["variant"]} for r in rows]), "vector array<float>", of("vectors"), **options)
    cost = translated.select("query_id", "cost_usd").union(embedded.select("query_id", "cost_usd")).groupBy("query_id").agg(F.sum("cost_usd").alias("cost_usd"))
    return embedded.where("error is null").select("query_id", "variant", "vector"), cost


INTENT = "struct<action:string,standalone_query:string,filters_video_ids:array<int>,selected_result_index:int,requires_clarification:boolean,clarification_question:string>"
ACTIONS = ("new_search", "refine_search", "select_result", "clarify")


def parse_intents(answers: DataFrame, raw: str = "answer", message: str = "message") -> DataFrame:
    """Adds the intent's columns from the model's JSON; what can't be read, or has another action, is a new search for the message
    itself, and so is a blank query. Where the model requires a clarification that is the action, whatever else it says."""
    x = F.from_json(raw, INTENT)
    fine = F.coalesce(x["action"].isin(*ACTIONS), F.lit(False))
    query = F.coalesce(F.nullif(F.trim(F.when(fine, x["standalone_query"])), F.lit("")), F.col(message))
    return answers.select(
        "*",
        F.when(fine & F.coalesce(x["requires_clarification"], F.lit(False)), "clarify").when(fine, x["action"]).otherwise("new_search").alias("action"),
        query.alias("standalone_query"),
        F.when(fine, F.coalesce(x["filters_video_ids"], F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>")).alias("llm_video_ids"),
        F.when(fine, x["selected_result_index"]).alias("selected_index"),
        F.when(fine, x["clarification_question"]).alias("clarification_question"),
    )


def write_documents(material: DataFrame, document: BatchFn, summary: BatchFn, ledger: str | None = None, **options) -> DataFrame:
    """(video_id, document_json, document_type, summary, cost_usd, error) from each video's material (video_id, material): a document,
    or if that fails a summary, or if both fail nulls and the last error. Either model is asked once for a video: its answers are
    written before they are parted; a ledger (two folders below it) spares what was answered before. A failed document's cost counts with its summary's."""
    of = lambda name: None if ledger is None else f"{ledger}/{name}"
    made = _asked(material.select("video_id", "material"), ["material"], document, "document_json string", of("documents"), **options)
    good, bad = made.where("error is null"), made.where("error is not null").select("video_id", "material", F.coalesce("cost_usd", F.lit(0.0)).alias("_spent"))
    short = _asked(bad, ["material"], summary, "summary string", of("summaries"), **options).withColumn("cost_usd", F.col("_spent") + F.coalesce("cost_usd", F.lit(0.0)))
    kind = F.get_json_object("document_json", "$.doc_type")
    a = good.select("video_id", "document_json", kind.alias("document_type"), F.get_json_object("document_json", "$.overview").alias("summary"), "cost_usd", "error")
    b = short.select("video_id", F.lit(None).cast("string").alias("document_json"), F.lit(None).cast("string").alias("document_type"), "summary", "cost_usd", "error")
    return a.unionByName(b)


def collect_material(lines: DataFrame) -> DataFrame:
    """(video_id, material): each video's lines in order; a document's material is bounded by the number of segments that it may have."""
    ordered = F.array_sort(F.collect_list(F.struct("start_sec", "line")))
    return lines.groupBy("video_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("material"))
