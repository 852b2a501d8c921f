"""Embedding near-duplicates by int8 tile products with error bounds.

Each unit vector u is kept as a * q + e with q of int8, and the length of e is measured. For two vectors
|u.v - a_u a_v q_u.q_v| <= |a_u q_u| |e_v| + |e_u| |a_v q_v| + |e_u| |e_v|, so a tile product of the q alone shows which pairs
can't reach the threshold, which do in any case, and which are in doubt. Rows are dealt to tiles by hash, and each pair of tiles
is one row of work, to which only q, a and the lengths travel. Tile pairs with a pair in doubt fetch the vectors themselves and
compute these pairs in double precision. Of a tile pair's links only their number at each vector leaves the task, and for
each vector its group's first one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components, local_roots

TILE = 8192
ROWS = 512  # of a tile, multiplied at once
EXACT = 1 << 15  # pairs computed in full precision at once
SLACK = 1e-9  # more than double precision loses in a product of unit vectors


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q, a, |a q| and |u - a q| of unit vectors."""
    a = np.abs(u).max(1) / 127
    q = np.rint(u / a[:, None]).astype(np.int8)
    near = a[:, None] * q
    return q, a, np.linalg.norm(near, axis=1), np.linalg.norm(u - near, axis=1)


def _near(x, y, threshold: float, same: bool):
    """Arrays (i, j, sure) of the rows of two tiles that can be linked, a part at a time; sure: the bounds alone show that they are. x, y:
    (q, a, |a q|, |e|)."""
    (qx, ax, nx, ex), (qy, ay, ny, ey) = x, y
    right = qy.T.astype(np.float32 if qy.shape[1] <= (1 << 24) // 127**2 else np.float64)  # sums of products stay exact
    for r in range(0, len(qx), ROWS):
        s = qx[r : r + ROWS].astype(right.dtype) @ right
        rows = slice(r, r + len(s))
        most = nx[rows] * ey.max() + ex[rows] * (ny.max() + ey.max())  # the bound over the whole tile
        least = threshold - SLACK - most
        floor = np.where(least > 0, least / (ax[rows] * ay.max()), least / (ax[rows] * ay.min()))
        i, j = np.nonzero(s >= (floor - 1)[:, None])
        bound = nx[r + i] * ey[j] + ex[r + i] * (ny[j] + ey[j])
        product = s[i, j] * ax[r + i] * ay[j]
        may = product + bound >= threshold - SLACK
        if same:
            may &= r + i < j
        yield r + i[may], j[may], product[may] - bound[may] >= threshold + SLACK


def _exact(ux: np.ndarray, uy: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) of two tiles' vectors are linked, in double precision."""
    return np.concatenate([np.einsum("ij,ij->i", ux[i[k : k + EXACT]], uy[j[k : k + EXACT]]) >= threshold for k in range(0, len(i), EXACT)] or [np.zeros(0, bool)])


class _Links:
    """How many links each of n rows has, and the first row that it reaches by them, folded a part at a time."""

    def __init__(self, n: int):
        self.n, self.root = np.zeros(n, np.int64), np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.n += np.bincount(i, minlength=len(self.n)) + np.bincount(j, minlength=len(self.n))
            self.root = local_roots(len(self.n), np.r_[i, np.arange(len(self.n))], np.r_[j, self.root])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _dump(keys: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as out:
        out.write_batch(pa.record_batch([keys], ["key"]))
    return sink.getvalue().to_pybytes()


def _load(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_next_batch().column(0)


def embedding_near_dups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row: how many other rows are linked to it directly, the smallest id that
    it reaches by links, its own included, and whether that is its own.

    Two rows are linked if their cosine is at least the threshold. A null vector, one of length zero or with a null, NaN or
    infinite component, or without components is linked with nothing. Vectors of different dimensions aren't linked. Repeated
    rows are rows of their own and link with each other. An empty table gives an empty result; other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # single precision travels as it is
    number = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{number}>").alias("v"))
    # a key of each row in the order of the ids, so that a group's least key names its component
    key = F.struct(F.col("id").isNull().alias("missing"), "id", F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.select(key.alias("key"), "id", "v", F.coalesce(usable, F.lit(False)).alias("ok")), "vectors")
    kind = rows.schema["key"].dataType.simpleString()
    count = rows.where("ok").count()
    tiles = max(1, math.ceil(count / tile))

    def pack(group: pa.Table) -> pa.Table:
        u = _unit(np.asarray(group.column("v").combine_chunks().flatten(), np.float64).reshape(group.num_rows, -1))
        q, *numbers = quantise(u)
        blob = lambda x: pa.array([x.tobytes()])
        return pa.table({"dim": pa.array([u.shape[1]], pa.int32()), "tile": group.column("tile").slice(0, 1), "rows": pa.array([_dump(group.column("key").combine_chunks())]), "q": blob(q), "numbers": blob(np.stack(numbers)), "u": blob(u)})

    dealt = rows.where("ok").select("key", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("key.row"), F.lit(tiles)).cast("int").alias("tile"))
    packed = materialize(dealt.groupBy("dim", "tile").applyInArrow(pack, "dim int, tile int, rows binary, q binary, numbers binary, u binary"), "tiles")
    # tile i meets the tiles i to i + tiles // 2, counted round: each pair once, each tile in as many pairs
    half = tiles // 2
    steps = packed.select("dim", "tile", F.explode(F.sequence(F.lit(0), F.lit(half))).alias("step"))
    if tiles % 2 == 0:
        steps = steps.where((F.col("step") < half) | (F.col("tile") < half) | F.lit(tiles == 1))
    steps = steps.select("dim", "tile", F.pmod(F.col("tile") + F.col("step"), F.lit(tiles)).alias("other"))

    def with_tiles(pairs: DataFrame, *columns: str) -> DataFrame:
        """The pairs (dim, tile, other) with the columns of both tiles; those of the other end in 2."""
        right = packed.select("dim", F.col("tile").alias("other"), *[F.col(c).alias(f"{c}2") for c in columns])
        return packed.select("dim", "tile", *columns).join(pairs, ["dim", "tile"]).join(right, ["dim", "other"]).repartition("dim", "tile", "other")

    def out_of(links: _Links, rx: pa.Array, ry: pa.Array):
        hit = np.flatnonzero(links.n)
        keys = pa.concat_arrays([rx, ry])
        none = pa.nulls(len(hit), pa.int32())
        return pa.record_batch([keys.take(pa.array(hit)), keys.take(pa.array(links.root[hit])), pa.array(links.n[hit]), none, none, none], ["key", "root", "n", "dim", "tile", "other"])

    def each_pair(batches):
        for b in batches:
            for k in range(b.num_rows):
                get = lambda c: b.column(c)[k].as_py()  # noqa: E731, B023
                dim = get("dim")
                q = [(np.frombuffer(get(c), np.int8).reshape(-1, dim), *np.frombuffer(get(d)).reshape(3, -1)) for c, d in (("q", "numbers"), ("q2", "numbers2"))]
                rx, ry = _load(get("rows")), _load(get("rows2"))
                yield get, dim, get("tile") == get("other"), q, rx, ry

    def sure(batches):
        for get, dim, same, q, rx, ry in each_pair(batches):
            links, doubt, shift = _Links(len(rx) + len(ry)), False, 0 if same else len(rx)
            for i, j, certain in _near(*q, threshold, same):
                links.add(i[certain], j[certain] + shift)
                doubt |= not certain.all()
            found = out_of(links, rx, ry)
            if found.num_rows:
                yield found
            if doubt:
                none = pa.nulls(1, rx.type)
                place = [pa.array([x], pa.int32()) for x in (dim, get("tile"), get("other"))]
                yield pa.record_batch([none, none, pa.nulls(1, pa.int64()), *place], ["key", "root", "n", "dim", "tile", "other"])

    def doubtful(batches):
        for get, dim, same, q, rx, ry in each_pair(batches):
            u, v = (np.frombuffer(get(c)).reshape(-1, dim) for c in ("u", "u2"))
            links, shift = _Links(len(rx) + len(ry)), 0 if same else len(rx)
            for i, j, certain in _near(*q, threshold, same):
                i, j = i[~certain], j[~certain]
                ok = _exact(u, v, i, j, threshold)
                links.add(i[ok], j[ok] + shift)
            yield out_of(links, rx, ry)

    schema = f"key {kind}, root {kind}, n bigint, dim int, tile int, other int"
    first = materialize(with_tiles(steps, "rows", "q", "numbers").mapInArrow(sure, schema), "links")
    rest = with_tiles(first.where("tile is not null").select("dim", "tile", "other"), "rows", "q", "numbers", "u")
    found = materialize(first.where("tile is null").union(rest.mapInArrow(doubtful, schema)).select("key", "root", "n"), "links")
    links = found.groupBy("key").agg(F.sum("n").alias("n_links"))
    groups = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    out = rows.select("key", "id").join(links, "key", "left").join(groups.withColumnRenamed("node", "key"), "key", "left")
    component = F.coalesce("root.id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
