"""Best-fit packing of token sequences by exact-complement hashing.

How many pieces there are of each length is a table of at most `cap` numbers, whatever the corpus, so the plan is made on
that table: it lists which lengths share a sequence and how many sequences are made in that way. Each piece then takes its
place by its rank among the pieces of its length, from a range lookup in the plan.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_slices, tokenizer_file

END = "<|endoftext|>"


@lru_cache(2)
def encoder(ranks: str, end_id: int):
    """The same vocabulary as byte_bpe_50k.json in the form of ranks, whose encoder is the faster one."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={END: end_id})


#: The rank encoder's pattern backtracks over runs of white space and gives up on those of most of a million characters.
_LONG_BLANK = re.compile(r"\s{100000}")


@lru_cache(2)
def library(vocabulary: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary)
    found.no_truncation()
    found.no_padding()
    return found


def token_numbers(text: str, ranks: str, vocabulary: str, end_id: int) -> np.ndarray:
    """The text's ids: from the rank encoder, or from the slower library if the text has a very long run of white space."""
    if len(text) >= 100_000 and _LONG_BLANK.search(text):
        return np.array(library(vocabulary).encode(text, add_special_tokens=False).ids, "<u4")
    return encoder(ranks, end_id).encode_to_numpy(text, allowed_special="all")


def pieces_of(docs: DataFrame, id_col: str, text_col: str, cap: int, ranks: str, vocabulary: str, end_id: int = 50256, closing_id: int = 0) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, task, nth): each text's tokens and a closing id, cut only beyond `cap` tokens,
    so that all pieces but the first are full; nth counts the task's pieces of this length."""

    def run(batches):
        task, nth = TaskContext.get().partitionId(), np.zeros(cap + 1, np.int64)
        for b in text_slices(batches, text_col):
            rows, size, crc = [], [], []
            for d, text in enumerate(pc.fill_null(b.column(text_col), "").to_pylist()):
                ids = np.append(token_numbers(text, ranks, vocabulary, end_id), closing_id).astype("<u4")
                at = -(-len(ids) // cap) * cap - len(ids)
                for i in range(-at, len(ids), cap):
                    a, z = max(i, 0), i + cap
                    rows.append((d, (i + at) // cap, a))
                    size.append(z - a)
                    crc.append(zlib.crc32(ids[a:z].tobytes()))
            n = np.asarray(size)
            order = np.argsort(n, kind="stable")
            first = np.searchsorted(n[order], n[order])
            within = np.empty(len(n), np.int64)
            within[order] = np.arange(len(n)) - first
            place = nth[n] + within
            nth += np.bincount(n, minlength=cap + 1)
            d, piece, start = map(np.asarray, zip(*rows, strict=True))
            yield pa.record_batch(
                [b.column(id_col).take(pa.array(d)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(n), pa.int32()), pa.array(place)],
                [id_col, "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint")


class _Sums:
    """Which sums one, two or three of the available lengths make."""

    def __init__(self, count: np.ndarray):
        self.count = count
        self.live = sum(1 << int(n) for n in np.flatnonzero(count))
        self._pairs: int | None = None

    def use(self, lengths: list[int], times: int) -> None:
        for n in lengths:
            self.count[n] -= times
        for n in set(lengths):
            if not self.count[n]:
                self.live &= ~(1 << n)
                self._pairs = None

    def fits(self, lengths: list[int]) -> int:
        """How many times these lengths are there together."""
        return min(int(self.count[n]) // lengths.count(n) for n in set(lengths))

    @property
    def pairs(self) -> int:
        if self._pairs is None:
            self._pairs, left = 0, self.live
            while left:
                low = left & -left
                self._pairs |= self.live << (low.bit_length() - 1)
                left ^= low
        return self._pairs

    def filling(self, have: list[int], gap: int) -> list[int] | None:
        """One, two or three lengths that, beside those in `have`, fill the gap exactly."""
        if self.live >> gap & 1 and self.fits([*have, gap]):
            return [gap]
        if self.pairs >> gap & 1:
            if found := self._pair(have, gap):
                return found
        left = self.live & ((1 << max(gap - 1, 0)) - 1)
        while left:
            n = left.bit_length() - 1
            left ^= 1 << n
            if self.pairs >> (gap - n) & 1 and (found := self._pair([*have, n], gap - n)):
                return [n, *found]
        return None

    def _pair(self, have: list[int], gap: int) -> list[int] | None:
        left = self.live & ((1 << gap) - 1)
        while left:
            n = left.bit_length() - 1
            if 2 * n < gap:
                return None
            left ^= 1 << n
            if self.live >> (gap - n) & 1 and self.fits([*have, n, gap - n]):
                return [n, gap - n]
        return None


def plan(count: np.ndarray, cap: int) -> list[tuple[list[int], int]]:
    """(lengths, times): sequences that hold pieces of these lengths, so many of each; count[n] is the number of pieces of
    length n. From the longest piece down, a gap is filled exactly by one, two or three lengths where these are left, as
    often as they are; else by the longest length that fits, and what gap is left then in the same way."""
    s = _Sums(count.astype(np.int64).copy())
    out = []
    while s.live:
        have = [s.live.bit_length() - 1]
        while gap := cap - sum(have):
            more = s.filling(have, gap)
            if more:
                have += more
                break
            left = s.live & ((1 << (gap + 1)) - 1)
            while left:
                n = left.bit_length() - 1
                if s.fits([*have, n]):
                    have.append(n)
                    break
                left ^= 1 << n
            else:
                break
        times = s.fits(have)
        s.use(have, times)
        out.append((have, times))
    return out


def slots(planned: list[tuple[list[int], int]]) -> pd.DataFrame:
    """One row for each place in a kind of sequence: pieces of `length` with ranks from `rank` on (up to the next row's) go to
    the sequences from `sequence` on, at `offset`."""
    rows, used, sequence = [], {}, 0
    for lengths, times in planned:
        offset = 0
        for n in lengths:
            rank = used.get(n, 0)
            rows.append((n, rank, sequence, offset))
            used[n] = rank + times
            offset += n
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).astype("int64").sort_values(["length", "rank"], ignore_index=True)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = 2048, ranks: str = "byte_bpe_50k.tiktoken", vocabulary: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each row's tokens goes.

    A null or empty text is the closing id alone. Rows with one id stay apart, each with pieces from 0 on. An empty table gives
    an empty result; other columns are not read. The result doesn't depend on how the rows are dealt to tasks, but which of
    several pieces of one length goes where does.
    """
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, id_col, text_col, cap, tokenizer_file(ranks, folder), tokenizer_file(vocabulary, folder)), "pieces")
    by_task = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    count = np.zeros(cap + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most cap rows
        count[r.length] = r.n
    # the table of places has at most a few rows for each length
    places = spark.sparkContext.broadcast(slots(plan(count, cap)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # this table grows with the tasks: it isn't broadcast, however small it looks
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).hint("merge")
    ranked = pieces.join(bases, ["length", "task"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches):
        table = places.value
        for b in batches:
            n, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            at = _last_not_above(table["length"].to_numpy(), table["rank"].to_numpy(), n, rank)
            sequence = table["sequence"].to_numpy()[at] + rank - table["rank"].to_numpy()[at]
            yield pa.record_batch([*b.columns[:5], pa.array(sequence), pa.array(table["offset"].to_numpy()[at])], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def _last_not_above(lengths, ranks, n, rank) -> np.ndarray:
    """For each (n, rank) the last row of the sorted (lengths, ranks) that is not above it."""
    out = np.empty(len(n), np.int64)
    for value in np.unique(n):
        of = n == value
        a, z = np.searchsorted(lengths, [value, value + 1])
        out[of] = a + np.searchsorted(ranks[a:z], rank[of], side="right") - 1
    return out
