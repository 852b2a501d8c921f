"""Messages of many senders to many receivers, in rows whose number grows with the senders and not with senders times receivers.

A message is bytes from one numbered sender to one numbered receiver. A row carries all messages of a sender to a part of the
receivers, of which a hop tells 2^bits apart: at the first hop those that share `bits` bits of their numbers' hashes, at the next one
twice as many bits, and at the last one each receiver. Between hops tasks gather rows of one part and deal them anew.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a row: the part of the receivers (at the last hop the receiver itself), and the messages.
ROW = "part bigint, receiver array<bigint>, sender array<bigint>, payload array<binary>"
#: Bytes of messages that a task gathers before it deals them anew.
GATHER = 16 << 20


def hops(receivers: int, bits: int) -> int:
    """How many hops it takes until a part has one receiver, of about so many."""
    return max(1, math.ceil(math.log2(max(receivers, 1)) / bits))


def _part(receiver: np.ndarray, hop: int, last: int, bits: int) -> np.ndarray:
    if hop >= last:
        return receiver
    h = receiver.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(64 - bits * hop)).astype(np.int64)


def rows(receiver, sender, payload: pa.Array, hop: int, last: int, bits: int) -> pa.RecordBatch:
    """The rows of some messages at a hop."""
    receiver, sender = np.asarray(receiver, np.int64), np.asarray(sender, np.int64)
    part = _part(receiver, hop, last, bits)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    ends = pa.array(np.r_[first, len(part)], pa.int32())
    lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(receiver[order]), pa.array(sender[order]), payload.take(pa.array(order)))]
    return pa.record_batch([pa.array(part[first]), *lists], ["part", "receiver", "sender", "payload"])


def opened(table: pa.Table) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(receiver, sender, payload) of all messages in some rows."""
    return tuple(pa.chunked_array(x.flatten() for x in table.column(c).chunks).combine_chunks() if table.num_rows else pa.array([], t) for c, t in (("receiver", pa.int64()), ("sender", pa.int64()), ("payload", pa.binary())))


def delivered(sent: DataFrame, last: int, bits: int) -> DataFrame:
    """The rows of the last hop, each with messages to one receiver, from those of the first. A receiver may have several rows."""
    tasks = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for hop in range(2, last + 1):

        def deal(batches, hop=hop):
            held, size, part = [], 0, None

            def dealt():
                return rows(*opened(pa.Table.from_batches(held)), hop, last, bits)

            for b in batches:
                parts = b.column("part").to_numpy()
                for i in range(b.num_rows):
                    if held and (parts[i] != part or size >= GATHER):
                        yield dealt()
                        held, size = [], 0
                    row = b.slice(i, 1)
                    held.append(row)
                    size, part = size + row.nbytes, parts[i]
            if held:
                yield dealt()

        # a part's rows may be dealt anew by several tasks, so that few parts don't mean few tasks
        split = F.pmod(F.hash(F.element_at("sender", 1)), F.lit(max(1, (4 * tasks) >> (bits * (hop - 1)))))
        sent = sent.repartition(tasks, "part", split).sortWithinPartitions("part").mapInArrow(deal, ROW)
    return sent
