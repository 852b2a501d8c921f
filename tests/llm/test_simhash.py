import random
import re

import pytest
import xxhash

from timeloom.llm.simhash import _links, link_fingerprints, simhash, simhash_near_dups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(s))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints(texts):
    got = simhash([(t or "").encode() for _, t in texts])
    assert got.tolist() == [fingerprint(t) for _, t in texts]


def expected(rows):
    fps = {fingerprint(t) for _, t in rows}
    of = groups(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, t in rows:
        r = of[fingerprint(t)]
        least[r] = min(least.get(r, i), i)
    return sorted((i, f"{fingerprint(t):016x}", least[of[fingerprint(t)]]) for i, t in rows)


def test_groups(docs, odd_docs, texts):
    want = expected(texts)
    assert sorted(map(tuple, simhash_near_dups(docs).collect())) == want
    assert sorted(map(tuple, simhash_near_dups(odd_docs).collect())) == want


def test_empty_table(no_docs):
    assert simhash_near_dups(no_docs).collect() == []


def test_links_of_crowded_fingerprints(spark):
    """A thousand fingerprints that differ in few bits: short and long posting lists give the same components."""
    r = random.Random(2)
    fps = {sum(1 << b for b in r.sample(range(48, 64), r.randint(0, 5))) | (r.randint(0, 3) << 62) for _ in range(900)} | {r.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = {tuple(sorted((x.a % 2**64, x.b % 2**64))) for x in link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()}
    assert pairs == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert len(_links(signed, 2, 6)) == len(pairs)


def test_too_far(spark):
    with pytest.raises(ValueError):
        link_fingerprints(spark.createDataFrame([], "fp bigint"), 8)


def test_long_texts_in_parts(texts):
    many = [(t or "").encode() for _, t in texts] + [b"x" * 500, b"a " + b"y" * 300 + b" b", b" " * 200 + b"a b"]
    for shingle in (1, 3, 5):
        for part in (1, 10, 64):
            assert simhash(many, shingle, part=part).tolist() == simhash(many, shingle).tolist()


def test_tally_filters_and_crowded_lists_are_whole(spark, monkeypatch):
    """Fingerprints that share four bytes and more with many others, with lists that are crowded at three, for several distances."""
    from timeloom.llm import simhash as S

    r = random.Random(7)
    near = [0x1234567890ABCDEF ^ sum(1 << b for b in r.sample(range(32), r.randint(0, 4))) for _ in range(80)]
    fps = sorted({*near, *(f ^ (r.getrandbits(16) << 48) for f in near), *(r.getrandbits(64) for _ in range(30))})
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    for crowd in (512, 3):
        monkeypatch.setattr(S, "CROWD", crowd)
        for bits in (1, 2, 3):
            pairs = {tuple(sorted((x.a % 2**64, x.b % 2**64))) for x in link_fingerprints(rows, bits).collect()}
            assert pairs == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits}
    assert len(S._key_positions(2)) == 6 and all(len(c) == 4 for c in S._key_positions(2))
    x = [0x0101010101010101, 0x0202020201010101]  # four bytes shared: on one list, but not linked
    assert len(_links(x, 2, 6)) == 0


def test_heavy_keys(spark):
    """Keys with a large part of all rows come by broadcast, and no row is lost or doubled."""
    from pyspark.sql import functions as F

    from timeloom.llm.common import look_up

    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id").where("id <> 7")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    got = look_up(rows, table, ["k"], "n", 30_000)
    assert got.columns == ["k", "id", "most"] and got.count() == 29_999
    assert got.where("k = 7 and most = 29997").count() == 10_000 and got.where("k <> 7 and most <> id").count() == 0
