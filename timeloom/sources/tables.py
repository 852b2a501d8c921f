"""Reading by scope, writing, and stages between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all machines share: the session's spark.checkpoint.dir. Where that is unset, a session on one
    machine gets a new folder, and a cluster, where no folder of one machine would do, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines see")
        folder = "file://" + tempfile.mkdtemp(prefix="timeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """df written to the shared folder, and read again: steps that use it several times compute it once, and a lost executor costs no
    step before it."""
    path = shared_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than this share of all rows is a heavy one.
HEAVY = 1 / 1000


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of their key's row in table, joined `how` (inner or left); null keys are keys. weight: how many rows have
    the key, total: how many there are. The rows of heavy keys, of which there can't be a thousand, get theirs by broadcast and the others by
    shuffle, so that no key's rows meet in one task."""
    least = max(int(total * HEAVY), 100)
    named = table.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    helpers = [f"_k{i}" for i in range(len(keys))]
    if total <= 20_000:
        return rows.join(named.drop(weight), same, how).drop(*helpers)
    heavy = F.broadcast(named.where(F.col(weight) > least).drop(weight))
    others = rows.join(heavy.select(*helpers), same, "left_anti")
    rest = named.where(F.coalesce(F.col(weight) <= least, F.lit(True))).drop(weight)
    return rows.join(heavy, same).drop(*helpers).unionByName(others.join(rest, same, how).drop(*helpers))


#: Bytes, about, that are sent to every task by a broadcast of rows that were counted.
MOST_BYTES = 16 << 20


def _bytes(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value has."""
    if isinstance(kind, T.ArrayType):
        flat = F.size(column) * 8 if not isinstance(kind.elementType, T.StringType | T.BinaryType) else F.aggregate(column, F.lit(0), lambda n, x: n + F.coalesce(F.length(x), F.lit(0)) + 8)
        return F.greatest(F.coalesce(flat, F.lit(0)), F.lit(0)) + 8
    return F.coalesce(F.length(column), F.lit(0)) + 8 if isinstance(kind, T.StringType | T.BinaryType) else F.lit(16)


def small(df: DataFrame, most: int = 10_000, most_bytes: int = MOST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows and about most_bytes bytes, arrays and texts counted, else as it is."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0))
    n, total = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= most and total <= most_bytes else df


def scan(df: DataFrame, scope: list[int] | None = None, order: tuple[str, ...] = ("video_id", "start_sec")) -> DataFrame:
    """Rows of the videos in scope, in time order; None is all videos, an empty list none."""
    found = df if scope is None else df.where(F.col("video_id").isin(scope) if scope else F.lit(False))
    return found.orderBy(*order)


scan_segments = scan


def scan_ocr_events(df: DataFrame, scope: list[int] | None = None) -> DataFrame:
    return scan(df, scope, ("video_id", "start_sec", "id"))


def append_search_log(summary: DataFrame, path: str) -> None:
    """Appends (query, cost_usd, created_at) for each search, also those without a result; query is as the user typed it."""
    summary.select("query", F.col("cost_usd").cast("double"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at")).write.mode("append").parquet(path)


def write_segments(rows: DataFrame, path: str) -> int:
    """Adds segments, empty texts as null, to a table of snapshots; gives its new version."""
    from .snapshots import commit

    texts = {c: F.nullif(F.col(c), F.lit("")) for c in ("transcript", "visual_description") if c in rows.columns}
    return commit(rows.withColumns(texts), path, "video_id")


def replace_partition(new: DataFrame, path: str, key: str = "video_id", keys: DataFrame | None = None, batch: str | None = None) -> int:
    """Puts the new rows in place of all rows with their keys, or with those of `keys`: of these, one without a new row is gone. Rows of
    other keys stay as they are. Readers see all of it or nothing; a batch that is in the table already changes nothing."""
    from .snapshots import commit

    return commit(new, path, key, new.select(key) if keys is None else keys.select(key), batch)


def write_report(df: DataFrame, path: str, run_id: str) -> None:
    """One JSON folder for each run, kept beside the others."""
    df.write.mode("overwrite").json(f"{path}/run={run_id}")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
