"""Removal of word windows that documents with smaller ids already hold, with a count-min prefilter.

Pass 1 counts every window's hash in a count-min sketch of two rows. Its width grows with the number of windows (16 to 32
cells each), so it is kept in shards by the hash's leading bits: each block of rows sends a shard its partition sketch, the list
of values whose cells it raises by one; the shard's task merges these and answers each block which of its windows may occur
in another block, those of which both cells count two. Lists and answers to many receivers share rows (`messages`), so that a block or
a shard sends at most 2^FAN_BITS of them however many shards and blocks there are. The sketch only overestimates, so no repeated window is lost. Pass 2 sends
just the windows estimated repeated, with a 104-bit hash and the block's smallest document, and groups them exactly. Pass 3
cuts the words. Sketches and answers are as large as their windows are many; nothing is broadcast and nothing goes through the
driver but the number of words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import block_table, unpack
from .common import utf8_list
from .messages import ROW, delivered, hops, opened, rows
from .text import Words, words_of, xxh64_slices

BLOCK = 4 << 20
VALUE_BYTES = 4
#: Windows that a shard of the sketch holds at most, on average, and the bits of a cell's number in each of its two rows.
SHARD_WINDOWS, CELL_BITS = 1 << 21, 25
#: A block's or a shard's messages leave in at most 2^FAN_BITS rows.
FAN_BITS = 8
#: Fixed odd multiplier from which a value's cell in the second row comes.
SECOND = np.uint64(0x9E3779B1)
#: Fixed odd multipliers of the two rolling hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bytes of an entry's two hashes and id.
ENTRY_BYTES = (8, 5, 8)
LAST = np.iinfo(np.int64).max


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _rolling(words: Words, at: np.ndarray, width: int, which: int) -> np.ndarray:
    """Hash number `which` of the windows of `width` words that begin at the words `at`."""
    h = xxh64_slices(words.buf, words.start, words.end, seed=which)
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out = out * np.uint64(MULTIPLIERS[which]) + h[at + j]
    return _mix(out)


def _windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word and the text of every window."""
    n = np.maximum(np.diff(words.first) - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - (np.cumsum(n) - n)[doc] + words.first[:-1][doc], doc


def _ids(batch: pa.RecordBatch, id_col: str) -> np.ndarray:
    return np.asarray(batch.column(id_col).cast(pa.int64()).fill_null(LAST))


def _shards(sorted_hash: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards that some of the hashes are in, and where each one's begin, with the end: as many as there are hashes at most, whatever the
    number of shards."""
    of = sorted_hash >> np.uint64(64 - bits)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    return of[first].astype(np.int64), np.r_[first, len(of)]


def _planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number, byte by byte position, so that sorted numbers compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize)[:, :n].T).tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8).reshape(n, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :n] = flat.T
    return out.view("<u8")[:, 0]


class _Repeats:
    """The repeated-window candidates of one block, the same in passes 2 and 3: one entry for each distinct window, sorted."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, width: int, answers: list | None, bits: int):
        self.words = words_of(texts)
        at, doc = _windows(self.words, width)
        one = _rolling(self.words, at, width, 0)
        distinct, inverse = np.unique(one, return_inverse=True)
        flagged = np.bincount(inverse, minlength=len(distinct)) > 1
        _flag(flagged, answers or [], *_shards(distinct, bits))
        chosen = np.flatnonzero(flagged[inverse])
        self.at, self.doc, one = at[chosen], ids[doc[chosen]], one[chosen]
        two = _rolling(self.words, self.at, width, 1) >> np.uint64(24)
        order = np.lexsort((self.doc, two, one))
        one, two = one[order], two[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.entry = np.empty(len(one), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.one, self.two, self.least = one[new], two[new], self.doc[order][new]
        self.shards, self.bounds = _shards(self.one, bits)


def _flag(flags: np.ndarray, answers: list, shards: np.ndarray, bounds: np.ndarray) -> None:
    """Sets the flags that the shards' answers set."""
    at = np.searchsorted(shards, np.fromiter((s for s, _ in answers), np.int64, len(answers)))
    for i, (_, seen) in zip(at.tolist(), answers, strict=True):
        a, b = bounds[i], bounds[i + 1]
        flags[a:b] |= np.unpackbits(np.frombuffer(seen, np.uint8), count=b - a).astype(bool)


def _cells(block: pa.RecordBatch, text_col: str, width: int, bits: int):
    words = words_of(utf8_list(block.column(text_col)))
    distinct = np.unique(_rolling(words, _windows(words, width)[0], width, 0))
    shards, bounds = _shards(distinct, bits)
    values = (distinct << np.uint64(bits)) >> np.uint64(64 - 8 * VALUE_BYTES)
    for shard, a, b in zip(shards.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield shard, _planes(values[a:b], VALUE_BYTES)


def _cells_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each value's cells in the two rows."""
    cut = np.uint64(8 * VALUE_BYTES - CELL_BITS)
    return (values >> cut).astype(np.int64), ((values * SECOND & np.uint64((1 << (8 * VALUE_BYTES)) - 1)) >> cut).astype(np.int64)


def _estimate(shard: pa.Table) -> pa.Table:
    """The merged sketch of one shard, and its answer to each block: a bit for each window sent, set if both of its cells count two."""
    rows = np.zeros((2, 1 << CELL_BITS), np.uint8)
    sent = [_numbers(x, VALUE_BYTES) for x in shard.column("cells").to_pylist()]
    for x in sent:
        for row, cells in zip(rows, _cells_of(x), strict=True):
            once = np.unique(cells)
            row[once] += row[once] < 2
    seen = []
    for x in sent:
        first, second = _cells_of(x)
        seen.append(np.packbits((rows[0][first] > 1) & (rows[1][second] > 1)).tobytes())
    return pa.table({"block": shard.column("block"), "shard": shard.column("shard"), "seen": seen})


def _entries(data: bytes) -> list[np.ndarray]:
    """The two hashes and the smallest id of each entry sent."""
    data = zstandard.decompress(data)
    n = len(data) // sum(ENTRY_BYTES)
    at = np.cumsum([0, *ENTRY_BYTES]) * n
    return [_numbers(data[a:b], k) for a, b, k in zip(at[:-1], at[1:], ENTRY_BYTES, strict=True)]


def _exact(shard: pa.Table) -> pa.Table:
    """A bit for each entry sent: set if another block has the same window in a document with a smaller id than all of its own."""
    parts = [_entries(x) for x in shard.column("entries").to_pylist()]
    size = [len(p[0]) for p in parts]
    one, two, least = (np.concatenate([p[i] for p in parts]) for i in range(3))
    least = least.view(np.int64)
    order = np.lexsort((least, two, one))
    o, t = one[order], two[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
    first = least[order][new][np.cumsum(new) - 1]
    smaller = np.empty(len(o), bool)
    smaller[order] = first < least[order]
    cut = np.split(smaller, np.cumsum(size)[:-1])
    return pa.table({"block": shard.column("block"), "shard": shard.column("shard"), "seen": [np.packbits(x).tobytes() for x in cut]})


def _kept(words: Words, drop: np.ndarray) -> pa.Array:
    """Each text's words that are not dropped, joined by a space."""
    keep = ~drop
    size = np.where(keep, words.end - words.start + 1, 0)
    mask = np.repeat(keep, words.end - words.start + 1)
    buf = words.buf[mask].tobytes()
    total = np.r_[0, np.cumsum(size)]
    ends = total[words.first]
    return pa.array([buf[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()).cast(pa.string())


def _answers(column: pa.Array) -> list[list]:
    return [[x for bundle in row or [] for x in zip(bundle["sender"], bundle["payload"], strict=True)] for row in column.to_pylist()]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` (by default the id) of every row, and n_words, n_removed, kept_text.

    Words are what stands between spaces and U+0009 to U+000D. A word goes if one of the windows of `width` words of its text
    that cover it has the same words as a window of a text with a smaller id; windows are judged on the input.
    kept_text: the other words, joined by one space. The id must be a whole number. A null text counts as empty: no
    words, kept_text ''. A null id comes after all others. Rows with one and the same id don't remove each other's words. An
    empty table gives an empty result. Other columns are not read; those of `keep` that are named like a result give way to it.
    """
    results = ["n_words", "n_removed", "kept_text"]
    keep = tuple(c for c in keep or (id_col,) if c not in results)
    read = list(dict.fromkeys([id_col, text_col, *keep]))
    spark = docs.sparkSession

    def measure(b):
        return len(words_of(utf8_list(b.column(text_col))).start)

    blocks = block_table(docs.select(*read), text_col, measure, BLOCK)
    n, n_blocks = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits, fan = max(3, math.ceil(math.log2(max(n, 1) / SHARD_WINDOWS))), FAN_BITS
    to_shards, to_blocks = hops(1 << bits, fan), hops(n_blocks, fan)

    def sketch(batches):
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                found = list(_cells(unpack(packed), text_col, width, bits))
                yield rows([x[0] for x in found], [block] * len(found), pa.array([x[1] for x in found], pa.binary()), 1, to_shards, fan)

    def repeated(batches):
        press = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            for block, packed, answers in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist(), _answers(batch.column("answers")), strict=True):
                b = unpack(packed)
                r = _Repeats(utf8_list(b.column(text_col)), _ids(b, id_col), width, answers, bits)
                cuts = zip(r.bounds[:-1].tolist(), r.bounds[1:].tolist(), strict=True)
                entries = [press(b"".join(_planes(x[i:j], k) for x, k in zip((r.one, r.two, r.least), ENTRY_BYTES, strict=True))) for i, j in cuts]
                yield rows(r.shards, [block] * len(r.shards), pa.array(entries, pa.binary()), 1, to_shards, fan)

    def cut(batches):
        for batch in batches:
            for packed, answers, smaller in zip(batch.column("rows").to_pylist(), _answers(batch.column("answers")), _answers(batch.column("smaller")), strict=True):
                b = unpack(packed)
                r = _Repeats(utf8_list(b.column(text_col)), _ids(b, id_col), width, answers, bits)
                gone = np.zeros(len(r.one), bool)
                _flag(gone, smaller, r.shards, r.bounds)
                hit = r.at[gone[r.entry] | (r.doc > r.least[r.entry])]
                change = np.bincount(hit, minlength=len(r.words.start) + width) - np.bincount(hit + width, minlength=len(r.words.start) + width)
                drop = (np.cumsum(change) > 0)[: len(r.words.start)]
                before = np.r_[0, np.cumsum(drop)][r.words.first]
                yield pa.record_batch([*(b.column(c) for c in keep), pa.array(np.diff(r.words.first)), pa.array(np.diff(before)), _kept(r.words, drop)], [*keep, *results])

    def asked_of(work, column):
        """What a shard answers to the blocks that asked it."""

        def run(shard):
            receiver, sender, payload = opened(shard)
            found = work(pa.table({"block": sender, "shard": receiver, column: payload}))
            return pa.Table.from_batches([rows(found.column("block"), found.column("shard"), found.column("seen").combine_chunks(), 1, to_blocks, fan)])

        return run

    def exchanged(sent, work, column, name):
        answers = delivered(sent, to_shards, fan).groupBy("part").applyInArrow(asked_of(work, column), ROW)
        return delivered(answers, to_blocks, fan).groupBy(F.col("part").alias("block")).agg(F.collect_list(F.struct("sender", "payload")).alias(name))

    asked = blocks.join(exchanged(blocks.mapInArrow(sketch, ROW), _estimate, "cells", "answers"), "block", "left")
    smaller = exchanged(asked.mapInArrow(repeated, ROW), _exact, "entries", "smaller")
    out = T.StructType([docs.schema[c] for c in keep]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return asked.join(smaller, "block", "left").mapInArrow(cut, out)
