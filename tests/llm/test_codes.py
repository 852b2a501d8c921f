"""Vector codes against plain assignment, and the cases that the docstring states."""

import random

import numpy as np
import pytest

from timeloom.llm import codes
from timeloom.llm.codes import PARTS, Bounds, listed, next_b, reassign, squared, vector_codes, with_group_error


def plain(vectors: list, rounds: int = 4):
    """{id: [(code, error)]}, codebooks: every distance of every round."""
    x = [(i, [int(np.floor(1024 * float(v))) for v in e]) for i, e in vectors]
    width = len(x[0][1]) // PARTS
    cut = lambda e, p: e[p * width : (p + 1) * width]
    start = [min(e for j, e in x if j == i) for i in sorted({i for i, _ in x})[:256]]
    books = [[cut(e, p) for e in start] for p in range(PARTS)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    nearest = lambda e, p: min(range(len(books[p])), key=lambda k: (far(cut(e, p), books[p][k]), k))
    for _ in range(rounds):
        own = [[nearest(e, p) for p in range(PARTS)] for _, e in x]
        for p in range(PARTS):
            for k in range(len(books[p])):
                mine = [cut(e, p) for (_, e), o in zip(x, own, strict=True) if o[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out: dict = {}
    for i, e in x:
        own = [nearest(e, p) for p in range(PARTS)]
        out.setdefault(i, []).append(("".join(f"{o:02x}" for o in own), sum(far(cut(e, p), books[p][own[p]]) for p in range(PARTS))))
    return out, books


def vectors(seed: int, n: int, d: int = 8, grid: float = 0.0):
    r = random.Random(seed)
    centre = [[r.uniform(-1, 1) for _ in range(d)] for _ in range(12)]
    draw = lambda c: [round(v + r.gauss(0, 0.2), 1) if grid else v + r.gauss(0, 0.2) for v in c]
    return [(i, [float(np.float32(v)) for v in draw(r.choice(centre))]) for i in range(n)]


@pytest.mark.parametrize(("seed", "grid", "b"), [(1, 0.0, 16), (2, 0.1, 16), (3, 0.1, 2), (4, 0.0, 3)])
def test_codes_equal_plain_assignment(spark, monkeypatch, seed, grid, b):
    """With ties (vectors on a coarse grid), and with lists so short that they don't do."""
    monkeypatch.setattr(codes, "FIRST_B", b)
    rows = vectors(seed, 500, grid=grid)
    want, books = plain(rows)
    got, found = vector_codes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3))
    assert [o.tolist() for o in found] == books
    assert {r.vec_id: (r.code, r.error) for r in got.collect()} == {i: v[0] for i, v in want.items()}


def test_unusable_repeated_and_clashing(spark):
    rows = vectors(5, 40) + [(3, [0.5] * 8), (3, [0.5] * 8), (50, None), (51, [0.1, None] * 4), (52, [float("nan")] + [0.0] * 7), (53, [float("inf")] + [0.0] * 7), (54, [1.0] * 4), (None, [0.25] * 8)]
    df = spark.createDataFrame([(i, v, None if (i or 0) % 3 else (i or 0) % 2, "a", 1) for i, v in rows], "vec_id bigint, embedding array<double>, label int, code string, error int")
    coded, books = vector_codes(df, group_col="label")
    got = with_group_error(coded).collect()
    usable = [(i, v) for i, v in rows if v and len(v) == 8 and i not in (51, 52, 53)]
    assert len(got) == len(usable) == 43 and all(len(o) == 40 for o in books)
    assert len({r.code for r in got if r.vec_id == 3}) == 2
    for label in (None, 0, 1):
        of = [r for r in got if r.grp == label]
        assert of and {r.group_error for r in of} == {sum(r.error for r in of)}
    want, _ = plain([(i, v) for i, v in usable if i is not None])
    if all(r.vec_id is not None for r in got):
        assert {r.vec_id for r in got} == set(want)


def test_empty_and_odd_lengths(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    for rows, n in (([], 0), ([(1, None, 2)], 0), ([(1, [], 1), (2, [], None)], 2), ([(1, [0.5, 0.25, 1.0], 1), (2, [0.5, 0.25, 2.0], 1)], 2), ([(None, [1.0] * 4, 1)], 1)):
        coded, _ = vector_codes(spark.createDataFrame(rows, kind), group_col="label")
        got = with_group_error(coded).collect()
        assert len(got) == n
        if n == 2:
            assert [r.error for r in got] == [0, 0]
    with pytest.raises(Exception, match="too large"):
        vector_codes(spark.createDataFrame([(1, [1e30] * 4)], "vec_id bigint, embedding array<float>"))[0].collect()


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_spare_work(seed):
    """Through many small moves, with changing b: own entries as by all distances, bounds never wrong, most parts not computed."""
    r = np.random.default_rng(seed)
    x, book = r.integers(-900, 900, (3000, 16)), r.integers(-900, 900, (256, 16))
    o, b, spared = listed(x, book, 16), 16, 0
    for turn in range(8):
        new = book + r.integers(-6, 7, book.shape) * (r.random((256, 1)) < 0.3)
        move = np.sqrt(squared(new, book).astype(float)) * (1 + 1e-12)
        book = new
        o, need = reassign(x, book, o, move, b)
        d = squared(x[:, None, :], book[None])
        assert (o.cand[:, 0] == d.argmin(1)).all() and need.sum() == len(x)
        real = np.sqrt(d)
        at = np.arange(len(x))
        filled = o.low[:, 1:] == o.out[:, None]  # places without an entry of their own
        assert (o.low[:, 0] >= real[at, o.cand[:, 0]]).all() and (filled | (o.low[:, 1:] <= np.take_along_axis(real, o.cand[:, 1:].astype(int), 1) + 1e-9)).all()
        assert (np.diff(o.low[:, 1:], axis=1) >= 0).all() and (o.low[:, 1:] <= o.out[:, None]).all()
        np.put_along_axis(real, o.cand.astype(int), np.inf, 1)
        assert (o.out <= real.min(1) + 1e-9).all()
        spared += need[0] + need[1 : b + 1].sum()
        b = [16, 4, 24, 2, 16, 3, 30, 16][turn]
    assert spared > 0.7 * 8 * len(x)


def test_next_b():
    need = np.zeros(codes.MOST_B + 2, int)
    assert next_b(need, 16) == 16
    need[0] = 1000
    assert next_b(need, 16) == 2
    need[5] = 100
    assert next_b(need, 16) == 7
    need[-1] = 100
    assert next_b(need, 16) == 32 and next_b(need, codes.MOST_B) == codes.MOST_B


def test_few_entries():
    x = np.arange(12).reshape(3, 4)
    for k in (1, 2, 3):
        o = listed(x, x[:k], 16)
        assert o.cand.shape == (3, k) and np.isinf(o.out).all()
        o, need = reassign(x, x[:k] + 1, o, np.full(k, 2.0), 16)
        assert isinstance(o, Bounds) and (o.cand[:, 0] == squared(x[:, None], x[:k] + 1).argmin(1)).all() and need.sum() == 3
