"""Vector codes: product quantisation by integer codebooks, whose assignments are kept up to date under adaptive distance bounds.

After Drake and Hamerly (2012) each part of a vector persists, from round to round, its own entry with an upper bound of the distance,
the b - 1 entries that come next with ordered lower bounds, and one outer bound for all entries that aren't listed. When entries
move, the triangle inequality shifts the bounds. A part whose upper bound stays below them all keeps its entry unseen; another one computes the
distances of the listed entries that its bound reaches, and of all entries only where it reaches the outer bound. Bounds are floats
rounded to the safe side, and what they leave open is decided by squared distances in integers, so codes are exact, ties included.
b follows what the round before needed.

A row of the working table holds a block of vectors, its bounds, and the sums of its parts by entry. Every round writes it anew to the shared
folder; of the sums only the totals by entry reach the driver, and the codebooks that go back have a fixed size.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, look_up, materialize, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in one row of the working table, and rows for which all distances are computed at once.
BLOCK, ROWS = 4096, 512
#: Listed entries of a part at first, and at most; the share of parts that may need more than are listed.
FIRST_B, MOST_B, MORE = 16, 64, 1 / 64


@dataclass
class Bounds:
    """For n parts: cand (n, b), own entry first; low (n, b), of which column 0 is the upper bound of the own entry and the others rise; out (n)."""

    cand: np.ndarray
    low: np.ndarray
    out: np.ndarray


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.where(x < 0, x * (1 + 1e-12), x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors along the last axis, exactly."""
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def _to_all(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(rows, entries) exact squared distances; by a product of doubles where these hold all sums exactly."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))
    if most * most * max(x.shape[1], 1) < 1 << 52:
        fx, fb = x.astype(np.float64), book.astype(np.float64)
        return ((fx * fx).sum(1)[:, None] - 2 * (fx @ fb.T) + (fb * fb).sum(1)).astype(np.int64)
    return squared(x[:, None, :], book[None, :, :])


def listed(x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
    """The bounds of parts for which the distances of all entries are computed; of equally near entries the lowest is the own one."""
    n, k = len(x), len(book)
    b = min(b, k)
    found = Bounds(np.zeros((n, b), np.uint8), np.zeros((n, b), np.float32), np.full(n, np.inf, np.float32))
    for r in range(0, n, ROWS):
        d = _to_all(x[r : r + ROWS], book)
        at = np.arange(len(d))
        own = d.argmin(1)
        up = _above(np.sqrt(d[at, own].astype(np.float64)))
        d[at, own] = np.iinfo(np.int64).max
        rest = np.argpartition(d, min(b - 1, k - 1), axis=1)[:, : b] if b < k else np.argsort(d, axis=1)[:, : k - 1]
        near = np.take_along_axis(d, rest, 1)
        order = np.argsort(near, axis=1, kind="stable")
        rest, near = np.take_along_axis(rest, order, 1), _below(np.sqrt(np.take_along_axis(near, order, 1).astype(np.float64)))
        rows = slice(r, r + len(d))
        found.cand[rows] = np.c_[own, rest[:, : b - 1]]
        found.low[rows] = np.c_[up, near[:, : b - 1]]
        if b < k:
            found.out[rows] = near[:, b - 1]
    return found


def _ordered(low: np.ndarray, out: np.ndarray) -> None:
    """Makes the lower bounds rise, and none exceed the outer bound, by lowering them."""
    if low.shape[1] > 1:
        low[:, -1] = np.minimum(low[:, -1], out)
        low[:, 1:] = np.minimum.accumulate(low[:, :0:-1], axis=1)[:, ::-1]


def reassign(x: np.ndarray, book: np.ndarray, old: Bounds, move: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
    """The bounds after the entries moved by `move` (upper bounds of how far), with b entries listed, and for how many parts how many listed
    entries had to be computed; the last number is of parts that needed all entries."""
    n, held = old.cand.shape
    b = min(b, len(book))
    cand, out = old.cand, _below(old.out - move.max(initial=0))
    low = _below(old.low - move[cand])
    low[:, 0] = _above(old.low[:, 0].astype(np.float64) + move[cand[:, 0]])
    if held > b:  # the outer bound takes over the entries that are no longer listed
        out = np.minimum(out, low[:, b:].min(1))
    elif held < b:  # a place without an entry of its own has the outer bound
        cand = np.c_[cand, np.repeat(cand[:, :1], b - held, 1)]
        low = np.c_[low, np.repeat(out[:, None], b - held, 1)]
    now = Bounds(cand[:, :b].copy(), low[:, :b].copy(), out)
    _ordered(now.low, now.out)
    need = np.zeros(MOST_B + 2, np.int64)
    first = now.low[:, 1] if b > 1 else now.out
    open_ = np.flatnonzero(np.minimum(first, now.out) <= now.low[:, 0])
    need[0] = n - len(open_)
    own = squared(x[open_], book[now.cand[open_, 0]]).astype(np.float64)
    now.low[open_, 0] = _above(np.sqrt(own))
    reached = (now.low[open_, 1:] <= now.low[open_, :1]).sum(1)
    everything = now.out[open_] <= now.low[open_, 0]
    need[-1] = everything.sum()
    for z in np.unique(reached[~everything]):
        rows = open_[~everything & (reached == z)]
        need[z] += len(rows)
        if z:
            some = now.cand[rows, : z + 1]
            d = squared(x[rows, None, :], book[some])
            order = np.lexsort((some, d), axis=1)
            d = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
            now.cand[rows, : z + 1] = np.take_along_axis(some, order, 1)
            now.low[rows, : z + 1] = np.c_[_above(d[:, :1]), _below(d[:, 1:])]
    rows = open_[everything]
    if len(rows):
        new = listed(x[rows], book, b)
        now.cand[rows], now.low[rows], now.out[rows] = new.cand, new.low, new.out
    _ordered(now.low, now.out)
    return now, need


def next_b(need: np.ndarray, b: int) -> int:
    """How many entries to list from now on: as many as all but a share MORE of the parts needed, twice as many if the list ended too soon."""
    total = need.sum()
    if not total:
        return b
    if need[-1] > total * MORE:
        return min(2 * b, MOST_B)
    beyond = total - np.cumsum(need[:-1])
    return int(np.clip(2 + np.argmax(beyond <= total * MORE), 2, MOST_B))


def _tables(ids: pa.Array, groups: pa.Array, x: np.ndarray, bounds: list[Bounds], need: np.ndarray) -> pa.RecordBatch:
    """One block as a row of the working table."""
    n, width = len(x), x.shape[1] // PARTS
    sums = np.zeros((PARTS, ENTRIES, width + 1), np.int64)
    for p, o in enumerate(bounds):
        own = o.cand[:, 0]
        sums[p, :, 0] = np.bincount(own, minlength=ENTRIES)
        for i in range(width):
            sums[p, :, 1 + i] = np.bincount(own, x[:, p * width + i], ENTRIES)
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a)
    many = lambda name: pa.array([np.stack([getattr(o, name) for o in bounds]).tobytes()])
    row = [one(ids), one(groups), pa.array([x.astype(np.int32).tobytes()]), many("cand"), many("low"), many("out"), pa.array([sums.tobytes()]), pa.array([need.tolist()], pa.list_(pa.int64()))]
    return pa.record_batch(row, ["id", "grp", "x", "cand", "low", "far", "sums", "need"])


def _block(row: dict, width: int) -> tuple[np.ndarray, list[Bounds]]:
    x = np.frombuffer(row["x"], np.int32).reshape(len(row["id"]), PARTS * width).astype(np.int64)
    n = len(x)
    cand, low, far = (np.frombuffer(row[c], t).reshape(PARTS, n, -1) for c, t in (("cand", np.uint8), ("low", np.float32), ("far", np.float32)))
    return x, [Bounds(cand[p], low[p], far[p, :, 0]) for p in range(PARTS)]


def _rows(batch: pa.RecordBatch):
    """Each row's binary columns with its lists of ids and groups as Arrow arrays."""
    for i in range(batch.num_rows):
        yield {c: (batch.column(c)[i].values if c in ("id", "grp") else batch.column(c)[i].as_py()) for c in batch.schema.names}


def _totals(table: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all blocks by part and entry, and the needs; added up in tasks and by slot, so that the driver gets one small row a slot."""

    def run(batches):
        total, need = np.zeros((PARTS * ENTRIES, width + 1), np.int64), np.zeros(MOST_B + 2, np.int64)
        for b in batches:
            for s, n in zip(b.column("sums").to_pylist(), b.column("need").to_pylist(), strict=True):
                total += np.frombuffer(s, np.int64).reshape(total.shape)
                need += np.asarray(n)
        used = np.flatnonzero(total[:, 0])
        rest = np.flatnonzero(need)
        values = np.r_[total[used], np.c_[need[rest], np.zeros((len(rest), width), np.int64)]]
        yield pa.record_batch([pa.array(np.r_[used, len(total) + rest], pa.int32()), pa.array(list(values), pa.list_(pa.int64()))], ["slot", "v"])

    parts = table.select("sums", "need").mapInArrow(run, "slot int, v array<bigint>")
    total, need = np.zeros((PARTS * ENTRIES, width + 1), np.int64), np.zeros(MOST_B + 2, np.int64)
    for r in parts.groupBy("slot").agg(*[F.sum(F.col("v")[i]) for i in range(width + 1)]).collect():
        if r[0] < len(total):
            total[r[0]] = r[1:]
        else:
            need[r[0] - len(total)] = r[1]
    return total.reshape(PARTS, ENTRIES, width + 1), need


def _integers(lists: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of vectors, filled up with zeros to PARTS * width components."""
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    scaled = np.floor(flat * SCALE)
    most = np.abs(scaled).max(initial=0)
    if most >= 1 << 31 or 4 * int(most) ** 2 * max(flat.shape[1], 1) >= 1 << 62:
        raise OverflowError("components are too large for 64-bit squared distances")
    out = np.zeros((len(lists), PARTS * width), np.int64)
    out[:, : flat.shape[1]] = scaled
    return out


def usable(vector: str):
    """Whether a vector isn't null and has only finite components."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((id_col, grp, code, error), codebooks): for every usable vector its PARTS entries as hexadecimal digits, the squared distance from
    them, and its group_col (null without); codebooks: for each part (entries, components) after `rounds` rounds.

    Null vectors and those with null or non-finite components are dropped. So are vectors that have another length than the usable one of the smallest id, since
    their parts can't be compared; a length that four doesn't divide is filled up with zeros. The codebooks start from the
    ENTRIES smallest ids, each once (of repeated ids the least vector, null ids not at all), so equal entries may occur: the lowest is
    used. Repeated rows all stay; vectors of length 0 get code 0 and error 0; without a usable vector the result is empty. Components have to be so small that
    squared distances fit 62 bits (below 10^5 at 256 components), else an OverflowError says so. Other columns are not read.
    """
    spark = vectors.sparkSession
    group = F.col(group_col) if group_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("id"), group.alias("grp"), F.col(vector_col).alias("v")).where(usable("v"))
    ids = [r.id for r in rows.where("id is not null").select("id").distinct().orderBy("id").limit(ENTRIES).collect()]
    least = rows.where(F.col("id") == ids[0]).agg(F.min("v").alias("v")).first().v if ids else None
    if least is None:
        first = rows.select("v").first()  # no row has an id
        least = first.v if first else []
    rows = rows.where(F.size("v") == len(least))
    width = -(-len(least) // PARTS)
    start = rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    x = _integers(pa.array([r.v for r in start], pa.list_(pa.float64())), width) if start else np.zeros((1, PARTS * width), np.int64)
    books = [np.ascontiguousarray(x[:, p * width : (p + 1) * width]) for p in range(PARTS)]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "grp")}
    schema = f"id array<{kinds['id']}>, grp array<{kinds['grp']}>, x binary, cand binary, low binary, far binary, sums binary, need array<bigint>"

    def begin(batches, books=books):
        for whole in batches:
            for r in range(0, whole.num_rows, BLOCK):
                b = whole.slice(r, BLOCK)
                x = _integers(b.column("v"), width)
                found = [listed(x[:, p * width : (p + 1) * width], books[p], FIRST_B) for p in range(PARTS)]
                yield _tables(b.column("id"), b.column("grp"), x, found, np.zeros(MOST_B + 2, np.int64))

    table, path = written(rows.mapInArrow(begin, schema), "codes")
    b = FIRST_B
    for turn in range(rounds):
        total, need = _totals(table, width)
        b = next_b(need, b)
        new = [np.where(total[p, : len(o), :1] > 0, total[p, : len(o), 1:] // np.maximum(total[p, : len(o), :1], 1), o) for p, o in enumerate(books)]
        moves = [np.sqrt(squared(n, o).astype(np.float64)) * (1 + 1e-12) for n, o in zip(new, books, strict=True)]
        books = new
        if turn < rounds - 1:

            def again(batches, books=new, moves=moves, b=b):
                for batch in batches:
                    for row in _rows(batch):
                        x, old = _block(row, width)
                        found = [reassign(x[:, p * width : (p + 1) * width], books[p], old[p], moves[p], b) for p in range(PARTS)]
                        yield _tables(row["id"], row["grp"], x, [f for f, _ in found], sum(n for _, n in found))

            before = path
            table, path = written(table.mapInArrow(again, schema), "codes")
            discard(spark, before)

    def end(batches):
        for batch in batches:
            for row in _rows(batch):
                x, old = _block(row, width)
                own, error = [], np.zeros(len(x), np.int64)
                for p in range(PARTS):
                    part = x[:, p * width : (p + 1) * width]
                    own.append((reassign(part, books[p], old[p], moves[p], b)[0] if rounds else old[p]).cand[:, 0])
                    error += squared(part, books[p][own[p]])
                digits = np.char.add(np.char.add(*(HEX[o] for o in own[:2])), np.char.add(*(HEX[o] for o in own[2:])))
                yield pa.record_batch([row["id"], row["grp"], pa.array(digits.tolist(), pa.string()), pa.array(error)], ["id", "grp", "code", "error"])

    coded = materialize(table.mapInArrow(end, f"id {kinds['id']}, grp {kinds['grp']}, code string, error bigint"), "coded")
    discard(spark, path)
    return coded.withColumnRenamed("id", id_col), books


HEX = np.array([f"{i:02x}" for i in range(ENTRIES)])


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Of all components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(v) for o in books for v in o.ravel().tolist()).encode()).hexdigest()


def with_group_error(coded: DataFrame) -> DataFrame:
    """Adds group_error, the errors of all rows of the same grp, nulls together. A group with many rows doesn't meet in one task: its sum is made in
    parts and then looked up by weight."""
    keyed = coded.select("*", F.col("grp").isNull().alias("_none"), F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("_grp"))
    sums = keyed.groupBy("_none", "_grp").agg(F.sum("error").alias("group_error"), F.count("*").alias("_n"))
    return look_up(keyed, sums, ["_none", "_grp"], "_n", coded.count()).drop("_none", "_grp")
