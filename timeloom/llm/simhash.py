"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most k bits differ in at most k of their eight bytes, so they share at least 8 - k
positional bytes. The positions are dealt to k + 2 groups, of which two at least are shared whole, and the index has a posting list
for each two groups and content of their bytes: 6 lists of four positions for two bits. On a list the shared positional bytes of
each pair are tallied; pairs that reach 8 - k are verified by their number of differing bits. A crowded list, which would
give too many pairs, is dealt to longer keys first: one list for each choice of 8 - k positions that holds the list's own. Such a
list can't hold more distinct fingerprints than the remaining k bytes have values (65,536 for two), whatever the corpus. Copies
of a text have one fingerprint, which is indexed once.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import look_up, materialize, text_slices, utf8_list
from .components import components
from .text import Words, words_of, xxh64_slices

#: For each byte the eight bytes 0 or 1 of its bits, lowest bit first.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8")[:, 0]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(w: Words, shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles in order, with repeats, and how many each text has: a shorter text is one, an empty one has none."""
    count = np.diff(w.first)
    shingles = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    ends = np.cumsum(shingles)
    doc = np.repeat(np.arange(len(count)), shingles)
    at = np.arange(ends[-1] if len(ends) else 0) - (ends - shingles)[doc] + w.first[:-1][doc]
    last = at + np.minimum(count[doc], shingle) - 1
    return xxh64_slices(w.buf, w.start[at], w.end[last], seed), shingles


def _ones(w: Words, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text how many of its shingles' hashes have each bit, and how many shingles it has."""
    h, shingles = shingle_hashes(w, shingle, seed)
    begins = np.cumsum(shingles) - shingles
    out = np.zeros((len(shingles), 64), np.int64)
    full = np.flatnonzero(shingles)
    if not len(full):
        return out, shingles
    # sums of 0/1 bytes stay below 256 in runs of 255 shingles
    runs = (shingles[full] + 254) // 255
    start = np.repeat(begins[full], runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    sums = np.add.reduceat(SPREAD[h.view(np.uint8).reshape(-1, 8)], start, axis=0).view(np.uint8)
    out[full] = np.add.reduceat(sums.reshape(-1, 64).astype(np.int64), np.cumsum(runs) - runs, axis=0)
    return out, shingles


#: A text of more bytes is worked off in parts of so many.
PART = 8 << 20


def _parts(text: bytes, shingle: int, size: int):
    """The text in parts of about `size` bytes, cut at spaces. Each has at least `shingle` words, and begins with the last shingle - 1
    of the part before it, so that the parts' shingles are the text's; a text with fewer words is one part."""
    held, at, some = b"", 0, False
    while at < len(text):
        m = _SPACE.search(text, at + size)
        end = m.start() if m else len(text)
        held = held + b" " + text[at:end] if held else text[at:end]
        at = end + 1
        words = held.rsplit(None, shingle)
        if len(words) >= shingle:
            yield held
            held, some = b" ".join(words[len(words) - shingle + 1 :]), True
    if not some:
        yield held


def simhash(texts: list[bytes], shingle: int = 3, seed: int = 42, part: int = PART) -> np.ndarray:
    """Each text's fingerprint as uint64: ASCII lower case, shingles with repeats; zero for a text without words."""
    ones, shingles = _ones(words_of([b"" if len(t) > part else t for t in texts], lower=True), shingle, seed)
    for i in [i for i, t in enumerate(texts) if len(t) > part]:
        for p in _parts(texts[i], shingle, part):
            more, n = _ones(words_of([p], lower=True), shingle, seed)
            ones[i] += more[0]
            shingles[i] += n[0]
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep, fp): the fingerprint as a signed 64-bit number; keep: other columns to be returned."""
    own = [id_col, *keep]

    def run(batches):
        for b in text_slices(batches, text_col):
            fp = simhash(utf8_list(b.column(text_col)), shingle)
            yield pa.record_batch([*(b.column(c) for c in own), pa.array(fp.view(np.int64))], [*own, "fp"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own)
    return docs.select(*own, text_col).mapInArrow(run, f"{kinds}fp bigint")


#: Lists of more fingerprints are crowded.
CROWD = 512


def _links(fps: list[int], max_bits: int, shared: int) -> np.ndarray:
    """The pairs (i, j) of linked fingerprints of one posting list: from a tally of their shared positional bytes, or, in a crowded list
    of a longest key, by looking up what each fingerprint's links can be."""
    x = np.unique(np.asarray(fps, np.int64).view(np.uint64))
    if len(x) <= CROWD:
        i, j = np.triu_indices(len(x), 1)
        differ = x[i] ^ x[j]
        tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        kept = tally >= shared
        i, j, differ = i[kept], j[kept], differ[kept]
        ok = np.bitwise_count(differ) <= max_bits
        return np.stack([x[i[ok]], x[j[ok]]], 1)
    # neighbours bit by bit, among the few bytes that vary
    vary = [b for b in range(64) if np.bitwise_or.reduce(x ^ x[0]) >> np.uint64(b) & np.uint64(1)]
    found = []
    for k in range(1, max_bits + 1):
        for bits in combinations(vary, k):
            y = x ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            ok = (x[at] == y) & (x < y)
            found.append(np.stack([x[ok], y[ok]], 1))
    return np.concatenate(found)


def _key_positions(max_bits: int) -> list[tuple[int, ...]]:
    """The positions of the index's keys: each two of max_bits + 2 groups of positions, or each group where there are only eight."""
    n = min(8, max_bits + 2)
    groups = [tuple(range(8))[i::n] for i in range(n)]
    return [tuple(sorted(sum(c, ()))) for c in combinations(groups, min(2, 8 - max_bits))]


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(255 << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _postings(choices: list[tuple[int, ...]]):
    """The keys of a fingerprint: (choice, bytes) for each choice of positions."""
    return F.array(*[F.struct(F.lit(i).cast("smallint").alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("bytes")) for i, c in enumerate(choices)])


def link_fingerprints(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints `fp` that differ in at most max_bits bits."""
    if not 0 < max_bits < 8:
        raise ValueError("max_bits must be 1 to 7: further apart no shared byte is guaranteed")
    shared = 8 - max_bits
    keys = _key_positions(max_bits)
    postings = distinct.select("fp", F.explode(_postings(keys)).alias("key")).select("fp", "key.choice", "key.bytes")
    sizes = materialize(postings.groupBy("choice", "bytes").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    # postings that stand alone on their list end here
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    live = materialize(look_up(postings, sizes.withColumn("size", F.col("n")), ["choice", "bytes"], "n", total), "postings")
    # longer keys for crowded lists: all choices of `shared` positions that hold the list's own
    longer = [[c for c in combinations(range(8), shared) if set(k) <= set(c)] for k in keys]
    every = sorted({c for group in longer for c in group})
    of = F.element_at(F.array(*[F.array(*[F.lit(every.index(c)) for c in group]) for group in longer]), F.col("choice") + 1)
    mask = F.element_at(F.array(*[F.lit(_mask(c)) for c in every]), F.col("at") + 1)
    # choices of the first index are told from those of the second by their numbers
    split = live.where(F.col("size") > CROWD).select("fp", F.explode(of).alias("at"))
    crowded = split.select((F.col("at") + len(keys)).cast("smallint").alias("choice"), F.col("fp").bitwiseAND(mask).alias("bytes"), "fp")
    plain = live.where(F.col("size") <= CROWD).select("choice", "bytes", "fp")
    lists = plain.union(crowded).groupBy("choice", "bytes").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches):
        for b in batches:
            pairs = [_links(x, max_bits, shared) for x in b.column("fps").to_pylist()]
            found = np.concatenate(pairs) if pairs else np.empty((0, 2), np.uint64)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(found.view(np.int64), columns=["a", "b"]), preserve_index=False)

    return lists.mapInArrow(run, "a bigint, b bigint").distinct()


def simhash_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep, fingerprint, component_id) for each row of docs.

    fingerprint: 16 hex digits. component_id: the smallest id that is reachable by links, the row's own included.
    Null and empty texts and texts without words have fingerprint zero and link like any other; repeated rows and repeated
    ids stay, each with its own row; an empty table gives an empty result; other columns of docs, whatever their names, are
    not read. A null id is kept, never a component's smallest unless it stands alone.
    """
    fp = materialize(fingerprints(docs, id_col, text_col, shingle, keep), "fingerprints")
    each = materialize(fp.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(link_fingerprints(each.select("fp"), max_bits))
    linked = materialize(roots.join(each, roots.node == each.fp).select("fp", "root", "least"), "linked")
    groups = linked.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("m"))
    of = look_up(linked, groups, ["root"], "m", linked.count()).select("fp", "first")
    named = materialize(each.join(of, "fp", "left").select("fp", "n", F.coalesce("first", "least").alias("component_id")), "named")
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return look_up(fp, named, ["fp"], "n", total).select(id_col, *keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
