"""The tables' schemas, and frames brought to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "videos": "id int, title string, source string, source_url string, file_path string, duration_sec int, status string, pipeline_stage string, created_at string, analyzed_at string, segment_count int, cost_usd double, asr_model string, vlm_model string, embedding_model string, summary string, summary_model string, document_json string, document_type string, document_model string",
    "segments": "id int, video_id int, start_sec double, end_sec double, transcript string, visual_description string, ocr_text string, transcript_embedding binary, visual_embedding binary, ocr_embedding binary, asr_model string, vlm_model string, embedding_model string, no_speech_prob double, avg_logprob double, compression_ratio double, vlm_frame_count int, created_at string",
    "ocr_events": "id int, video_id int, segment_id int, start_sec double, end_sec double, frame_sec double, raw_text string, resolved_text string, confidence double, bbox string, primary_engine string, ocr_pipeline_version string, embedding binary, created_at string",
    "search_log": "id int, query string, cost_usd double, created_at string",
    "jobs": "id int, job_type string, video_id int, source_url string, status string, stage string, progress_percent int, progress_message string, error_message string, cost_usd double, created_at string, started_at string, completed_at string",
    "conversations": "id int, state_json string, total_cost_usd double, created_at string, updated_at string",
}


def schema_of(name: str) -> T.StructType:
    """The schema of one of the six tables."""
    return T.StructType.fromDDL(_DDL[name])


#: Columns that are computed and so never copied.
GENERATED = {"segments": ("content",)}

BBOX = "array<struct<x:double,y:double>>"
DOCUMENT = "struct<doc_type:string,title:string,overview:string,sections:array<struct<heading:string,steps:array<struct<timestamp_sec:double,heading:string,detail:string>>>>,uncovered:array<string>>"


def fit(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns, in its order and types; columns that df lacks are null, others are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the six tables from Parquet; columns added since a file was written are null."""
    found = spark.read.option("mergeSchema", "true").parquet(path)
    return fit(found, schema_of(name))


def load_jdbc(spark: SparkSession, url: str, name: str, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """One of the six tables from a database; bounds of the ids let `partitions` tasks read side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if bounds:
        reader = reader.options(partitionColumn="id", lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return fit(reader.load(), schema_of(name))


def with_content(segments: DataFrame) -> DataFrame:
    """Adds content: the three texts with a space between them, a null as empty."""
    text = [F.coalesce(c, F.lit("")) for c in ("transcript", "visual_description", "ocr_text")]
    return segments.withColumn("content", F.concat(text[0], F.lit(" "), text[1], F.lit(" "), text[2]))


def align_columns(source: DataFrame, target: T.StructType, generated: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, list[str]]]:
    """The source in the target's schema without its generated columns, and which columns moved, are lost, or are filled."""
    kept = T.StructType([f for f in target if f.name not in generated])
    names = set(kept.names)
    report = {
        "moved": [c for c in source.columns if c in names],
        "lost": [c for c in source.columns if c not in names and c not in generated],
        "filled": [c for c in kept.names if c not in source.columns],
    }
    return fit(source, kept), report


#: Bits of a key's hash that each level of the digests looks at, and the levels.
LEAF_BITS, LEVELS = 12, 2


def _leaf(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def _digests(rows: DataFrame, key: str, columns: list[str], bits: int) -> DataFrame:
    """(leaf, n, a, b): for each range of the keys' hashes how many rows it has, and 128 bits of all their values, whatever their order."""
    values = [*[F.col(c).isNull() for c in columns], *[F.col(c) for c in columns]]  # a hash passes over nulls
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), F.col(key).isNull(), F.col(key), *values)).alias(n) for n, seed in (("a", 1), ("b", 2))]
    return rows.groupBy(_leaf(key, bits).alias("leaf")).agg(F.count("*").alias("n"), *hashes)


def _differing(left: DataFrame, right: DataFrame, key: str, columns: list[str], bits: int) -> list[int]:
    x, y = _digests(left, key, columns, bits).alias("x"), _digests(right, key, columns, bits).alias("y")
    same = F.expr("x.n <=> y.n and x.a <=> y.a and x.b <=> y.b")
    return [r.leaf for r in x.join(y, F.expr("x.leaf = y.leaf"), "full_outer").where(~same).select(F.coalesce("x.leaf", "y.leaf").alias("leaf")).limit((1 << LEAF_BITS) + 1).collect()]


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, difference, columns): a row for each key whose rows differ: only `left`, only `right` or `values` with the
    columns that differ, null equal to null and bytes compared as bytes. Keys must be unique on either side.

    Both sides are digested by ranges of the keys' hashes first, and the ranges that differ once more in finer ones; only rows of those that still do are
    joined. Equal copies shuffle nothing but digests.
    """
    columns = [c for c in left.columns if c in right.columns and c != key]
    plain = [c for c in columns if not isinstance(left.schema[c].dataType, T.MapType)]
    a, b = left, right
    for level in range(1, LEVELS + 1 if plain == columns else 1):
        leaves = _differing(a, b, key, columns, level * LEAF_BITS)
        if len(leaves) > 1 << LEAF_BITS - 1:
            break  # most ranges differ: finer digests would spare nothing
        inside = _leaf(key, level * LEAF_BITS).isin(leaves)
        a, b = a.where(inside), b.where(inside)
        if not leaves:
            break
    a, b = a.alias("a"), b.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    differ = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull()) if columns else F.array().cast("array<string>")
    kind = F.when(F.col(f"b.{key}").isNull(), "left").when(F.col(f"a.{key}").isNull(), "right").when(F.size(differ) > 0, "values")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), kind.alias("difference"), F.when(kind == "values", differ).alias("columns")).where("difference is not null")


def reconcile_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(n_left, n_right, only_left, only_right, different)."""
    diff = reconcile(left, right, key).groupBy().agg(*[F.count_if(F.col("difference") == k).alias(n) for k, n in (("left", "only_left"), ("right", "only_right"), ("values", "different"))])
    return left.groupBy().agg(F.count("*").alias("n_left")).join(right.groupBy().agg(F.count("*").alias("n_right"))).join(diff)
