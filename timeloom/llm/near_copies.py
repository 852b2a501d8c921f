"""Near copies by the similarity of their sets of word shingles, at least 0.8 of five words each unless told otherwise.

At this similarity about ten of 64 bits of two SimHash fingerprints differ, and no shared byte is left to index by. Candidates
are found by marks instead: each is a hash of ROWS independently seeded minima over a text's shingles, and two texts of similarity
s share one of the MARKS with probability 1 - (1 - s ** ROWS) ** MARKS: 0.99993 at 0.8. Every candidate is then verified by
its exact similarity. Copies of a text are grouped beforehand and have one row in all of this.

A mark's texts aren't all compared with each other: first each with the mark's least one, then, while the pairs of texts that share a
mark and no group yet are many, those of other groups with one of the mark's texts that a hash chooses. What pairs are left are
compared in the end, those of a crowded mark by products of tiles of its texts, so that no pair becomes a row. A large group of
near copies so costs a few comparisons for most of its texts, while no candidate is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import look_up, materialize, text_slices, utf8_list
from .components import components, local_roots
from .simhash import shingle_hashes
from .text import Words, words_of, xxh64_slices

SHINGLE, LEAST = 5, 0.8
#: Pairs apart for each text on a mark beyond which another round with chosen texts comes first, and the most of such rounds.
APART, ROUNDS = 2, 2
#: Marks of more texts are crowded; texts of a tile, and shingles of a product at once.
CROWD, TILE, SLICE = 48, 256, 8_192
REMEMBERED = 1_000_000
#: Pairs of one text that are verified together.
SHARE = 256
MARKS, ROWS = 24, 5
#: Odd factors and offsets of the minima, and odd factors that put those of a mark together.
_R = np.random.default_rng(8)
FACTORS, OFFSETS, MIX = (_R.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (MARKS * ROWS, MARKS * ROWS, ROWS))


def _keys(w: Words, seed: int = 7) -> np.ndarray:
    """A hash of each text's words, as int64: copies have the same one, whatever their case and spaces."""
    last = w.first[1:] - 1
    some = np.diff(w.first) > 0
    out = np.zeros(len(last), np.uint64)
    out[some] = xxh64_slices(w.buf, w.start[w.first[:-1][some]], w.end[last[some]], seed)
    return out.view(np.int64)


def marks_of(w: Words, shingle: int = SHINGLE) -> np.ndarray:
    """MARKS int64 for each text that has words, in order."""
    h, count = shingle_hashes(w, shingle)
    begin = (np.cumsum(count) - count)[count > 0]
    out = np.zeros((len(begin), MARKS), np.uint64)
    if not len(begin):
        return out.view(np.int64)
    for m in range(MARKS):
        for r in range(ROWS):
            i = m * ROWS + r
            x = (h ^ OFFSETS[i]) * FACTORS[i]
            low = np.minimum.reduceat(x ^ (x >> np.uint64(31)), begin)
            out[:, m] = (out[:, m] ^ low ^ (low >> np.uint64(29))) * MIX[r]
        out[:, m] = (out[:, m] ^ (out[:, m] >> np.uint64(32))) * MIX[0] + np.uint64(m)
    return out.view(np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, keep: tuple[str, ...]) -> DataFrame:
    """(id_col, keep, k, marks): the key of each text and its marks, none for a text without words."""
    own = list(dict.fromkeys([id_col, *keep]))

    def run(batches):
        for b in text_slices(batches, text_col):
            w = words_of(utf8_list(b.column(text_col)), lower=True)
            size = np.where(np.diff(w.first) > 0, MARKS, 0)
            marks = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), marks_of(w, shingle).ravel())
            yield pa.record_batch([*(b.column(c) for c in own), pa.array(_keys(w)), marks], [*own, "k", "marks"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own)
    return docs.select(*dict.fromkeys([*own, text_col])).mapInArrow(run, f"{kinds}k bigint, marks array<bigint>")


def _keyed(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(k, text), a row for each text whose k is among those wanted. Copies go on once from each task, up to a bound of remembered keys."""

    def run(batches):
        seen: set[int] = set()
        for b in text_slices(batches, text_col):
            k = _keys(words_of(utf8_list(b.column(text_col)), lower=True))
            if len(seen) > REMEMBERED:
                seen.clear()
            new = pa.array([i for i, x in enumerate(k.tolist()) if not (x in seen or seen.add(x))], pa.int64())
            yield pa.record_batch([pa.array(k).take(new), b.column(text_col).take(new)], ["k", "text"])

    return docs.select(text_col).mapInArrow(run, "k bigint, text string").join(wanted, "k", "left_semi").dropDuplicates(["k"])


def _sets(keyed: DataFrame, shingle: int) -> DataFrame:
    """(k, n, shingles): each text's distinct shingles and their number."""

    def run(batches):
        for b in text_slices(batches):
            h, count = shingle_hashes(words_of(utf8_list(b.column("text")), lower=True), shingle)
            each = [np.unique(x).view(np.int64) for x in np.split(h, np.cumsum(count)[:-1])]
            n = np.array([len(x) for x in each], np.int32)
            found = pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), np.concatenate(each))
            yield pa.record_batch([b.column("k"), pa.array(n), found], ["k", "n", "shingles"])

    return keyed.mapInArrow(run, "k bigint, n int, shingles array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough. A text in many pairs as their a, as a crowded mark's least one is, has its set
    dealt to parts of about SHARE pairs each, so that its pairs don't meet in one task."""
    pairs = materialize(pairs, "pairs")
    each = pairs.groupBy("a").agg(F.count("*").alias("w")).withColumn("parts", F.ceil(F.col("w") / SHARE))
    dealt = look_up(pairs, each, ["a"], "w", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    side = lambda c: sets.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("shingles").alias(f"s{c}"))
    left = side("a").join(each.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return dealt.join(side("b"), "b").join(left, ["a", "part"]).where(both / (F.col("na") + F.col("nb") - both) >= least).select("a", "b")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of x has in common with each of y."""
    sets = [*x, *y]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        i, j = np.searchsorted(column, [a, a + SLICE])
        has = np.zeros((len(sets), SLICE), np.float32)
        has[row[i:j], column[i:j] - a] = 1
        out += has[: len(x)] @ has[len(x) :].T
    return out


def _by_tiles(crowded: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links that connect what the similar texts of different roots on each mark connect; crowded: (mark, k, root, n), n: how many
    texts the mark has."""
    tiles = F.ceil(F.col("n") / TILE)
    dealt = crowded.select("mark", "k", "root", F.pmod(F.xxhash64("k"), tiles).alias("t"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("u"))
    pairs = dealt.select("mark", "k", "root", "t", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j")).join(sets.select("k", "shingles"), "k")

    def compare(group: pa.Table) -> pa.Table:
        k, root, t = (group.column(c).to_numpy() for c in ("k", "root", "t"))
        found = [np.asarray(s.values) for s in group.column("shingles").combine_chunks()]
        left = np.flatnonzero(t == t.min())
        right = left if t.min() == t.max() else np.flatnonzero(t == t.max())
        both = _overlaps([found[i] for i in left], [found[i] for i in right])
        n = np.array([len(s) for s in found])
        i, j = np.nonzero((both >= least * (n[left][:, None] + n[right] - both) - 1e-3) & (root[left][:, None] != root[right]))
        i, j, both = left[i], right[j], both[i, j].astype(np.float64)
        ok = both / (n[i] + n[j] - both) >= least
        top = local_roots(len(k), i[ok], j[ok])
        hit = np.flatnonzero(top != np.arange(len(k)))
        return pa.table({"a": pa.array(k[top[hit]]), "b": pa.array(k[hit])})

    return pairs.groupBy("mark", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep, component_id) for each row of docs; component_id: the smallest id that is reachable by links, the row's own included.

    Two texts are linked when their sets of lower-case shingles have at least this Jaccard similarity; a text shorter than a
    shingle is one. Null and empty texts and texts without words are copies of each other. A null id is never a component's
    smallest unless it stands alone. keep: other columns of docs to be returned, none named k, marks or component_id.
    """
    rows = materialize(_sketches(docs, id_col, text_col, shingle, keep), "sketches")
    each = materialize(rows.groupBy("k").agg(F.min(id_col).alias("least"), F.count("*").alias("n"), F.first("marks").alias("marks")), "distinct")
    marked = each.select("k", F.explode("marks").alias("mark"))
    shared = materialize(marked.groupBy("mark").agg(F.min("k").alias("rep"), F.count("*").alias("n")).where("n > 1"), "marks")
    members = materialize(look_up(marked, shared, ["mark"], "n", _sum(shared, "n")), "members")
    sets = materialize(_sets(_keyed(docs, text_col, members.select("k").distinct()), shingle), "sets")

    stars = members.where("k <> rep").select(F.col("rep").alias("a"), F.col("k").alias("b")).distinct()
    groups = materialize(components(_verified(stars, sets, least)), "groups")
    for seed in range(ROUNDS):
        # what shares a mark but not yet a group
        rest = materialize(members.join(groups.withColumnRenamed("node", "k"), "k", "left").select("mark", "k", F.coalesce("root", "k").alias("root")), "rest")
        by_root = rest.groupBy("mark", "root").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("k", F.lit(seed)).alias("h"), "k")).alias("first"))
        split = by_root.groupBy("mark").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"), F.min(F.struct("first.h", "first.k", "root")).alias("one")).where("own < n * n")
        split = materialize(split.select("mark", "n", F.col("n").alias("size"), ((F.col("n") * F.col("n") - F.col("own")) / 2).alias("apart"), F.col("one.k").alias("a"), F.col("one.root").alias("u")), "marks")
        rest = look_up(rest, split, ["mark"], "n", _sum(split, "n"))
        if _sum(split, "apart") <= APART * _sum(split, "n"):
            break
        found = materialize(_verified(rest.where("root <> u").select("a", F.col("k").alias("b")).distinct(), sets, least), "links")
        if found.isEmpty():
            break
        groups = materialize(components(groups.select(F.col("root").alias("a"), F.col("node").alias("b")).union(found)), "groups")
    rest = materialize(rest.select("mark", "k", "root", "size"), "rest")
    few = rest.where(F.col("size") <= CROWD).join(sets.select("k", "n"), "k")
    x, y = few.alias("x"), few.alias("y")
    near = F.least("x.n", "y.n") / F.greatest("x.n", "y.n") >= least
    apart = x.join(y, F.expr("x.mark = y.mark AND x.k < y.k AND x.root <> y.root")).where(near)
    more = _verified(apart.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct(), sets, least)
    more = more.union(_by_tiles(rest.where(F.col("size") > CROWD).select("mark", "k", "root", F.col("size").alias("n")), sets, least))

    roots = components(groups.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more))
    linked = materialize(roots.join(each.select("k", "least"), roots.node == each.k).select("k", "root", "least"), "linked")
    firsts = linked.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("m"))
    of = look_up(linked, firsts, ["root"], "m", linked.count()).select("k", "first")
    named = materialize(each.select("k", "least", "n").join(of, "k", "left").select("k", "n", F.coalesce("first", "least").alias("component_id")), "named")
    return look_up(rows, named, ["k"], "n", _sum(each, "n")).select(*dict.fromkeys([id_col, *keep]), "component_id")


def _sum(df: DataFrame, column: str) -> int:
    return int(df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0])
