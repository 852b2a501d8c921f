"""What the operators share: tables in the shared folder, tokenizer files, text batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at once.
BLOCK_BYTES = 2 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: the session's spark.checkpoint.dir. Where that is unset a session on one machine gets a new
    one; on a cluster no folder of one machine would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines see")
        found = "file://" + tempfile.mkdtemp(prefix="timeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: a lost executor then costs no earlier stage."""
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As materialize, and where the table lies."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: A key with more than this share of all rows is a heavy one.
HEAVY = 1 / 1000


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows with the columns of their key's row in table (an inner join): one row for each key, weight: how many rows have the key, total:
    how many there are. The rows of heavy keys, of which there can't be a thousand, get them by broadcast and the others by shuffle,
    so that no key's rows meet in one task. table is read several times."""
    least = max(int(total * HEAVY), 100)
    if total <= 20_000:
        return rows.join(table.drop(weight), keys)
    heavy = F.broadcast(table.where(F.col(weight) > least).drop(weight))
    others = rows.join(heavy.select(*keys), keys, "left_anti").join(table.where(F.col(weight) <= least).drop(weight), keys)
    return rows.join(heavy, keys).unionByName(others)


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Where a public tokenizer's file lies; folder overrides the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def text_slices(batches, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `limit` bytes of text; a longer text comes alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64) + 1
        part = (np.cumsum(size) - 1) // limit
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(first, np.r_[first[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def utf8_list(column: pa.Array) -> list[bytes]:
    """The texts' bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
