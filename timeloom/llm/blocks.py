"""A table of packed blocks of rows, bucketed by block, that several passes can read and join without moving the texts again."""

from __future__ import annotations

import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import shared_dir, text_slices


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.compress(sink.getvalue(), 3)


def unpack(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_next_batch()


def block_table(docs: DataFrame, text_col: str, measure, block_bytes: int) -> DataFrame:
    """(block, n, rows): docs cut into blocks of about block_bytes of text, whole rows each; n is measure(batch), say of its words.

    Each block has a number of its own; the table is written once, so every later pass sees the same rows in the same order.
    It lies in the shared folder, bucketed by block into as many buckets as the session has shuffle partitions: joins on block leave it
    where it is. The catalogue knows it only until it is read; its files stay, like those of other stages, as results read them lazily.
    """

    def run(batches):
        task, at = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def full():
            nonlocal at
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            at += 1
            return pa.record_batch([pa.array([task << 32 | at]), pa.array([measure(b)], pa.int64()), pa.array([pack(b)])], ["block", "n", "rows"])

        size = 0
        for b in text_slices(batches, text_col, block_bytes):
            if held and size + b.nbytes > block_bytes * 1.2:
                yield full()
                held, size = [], 0
            held.append(b)
            size += b.nbytes
        if held:
            yield full()

    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"timeloom_blocks_{uuid.uuid4().hex}"
    writer = docs.mapInArrow(run, "block bigint, n bigint, rows binary").write.bucketBy(buckets, "block").option("compression", "none")
    writer.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)  # only tables can be bucketed
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of an outside path: the files stay
    return found
