"""Importance resampling and licence scans against literal versions, and the cases that their docstrings state."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm.licenses import PHRASES, TEMPLATES, Automaton, automaton, scan_licenses
from timeloom.llm.resampling import bucket_counts, draw, importance_resample, segments
from timeloom.llm.text import CRC_BYTES, alnum_words, crc32_pairs, crc32_words

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


# ---- words and their CRC


def test_crc_of_words_and_pairs(texts):
    given = [(t or "").encode() for _, t in texts] + [b"a" * n + b" " + b"b" * n for n in (1, CRC_BYTES - 1, CRC_BYTES, CRC_BYTES + 1, 500)]
    x = alnum_words(given)
    w = [x.raw[a:b].tobytes() for a, b in zip(x.start, x.end, strict=True)]
    assert w == [v.encode() for t in given for v in words(t.decode())] and np.diff(x.first).tolist() == [len(words(t.decode())) for t in given]
    crc = crc32_words(x.raw, x.start, x.end)
    assert crc.tolist() == [zlib.crc32(v) for v in w]
    left = np.arange(len(w) - 1)
    assert crc32_pairs(x.raw, x.start, x.end, crc, left, left + 1).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(w, w[1:], strict=False)]
    assert not len(alnum_words([]).start) and not len(alnum_words([b""]).start)


# ---- importance resampling


def lined(docs):
    """Some texts cut into lines, so that pairs of words stand across lines."""
    return docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "([aeo]) ", "$1\n")).otherwise(F.col("text")))


@pytest.fixture(scope="module")
def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate([t for _, t in texts][7:20] + [None, "", "of the\nof the\n\nof"])], "item_id int, text string")


def test_counts_by_line(spark, docs, target):
    for df in (lined(docs), target, lined(docs).unionAll(lined(docs)), docs.limit(0)):
        want = Counter(bucket(f) for r in df.collect() for f in features(r.text))
        got = bucket_counts(df)
        assert {i: n for i, n in enumerate(got.tolist()) if n} == dict(want)


def test_lines_are_counted_once(spark):
    rows = [(i, "one two\nthree four\nOne two\n \n") for i in range(60)] + [(99, "one two")]
    found = {(r.segment, r.parted): r.n for r in segments(spark.createDataFrame(rows, "doc_id int, text string").repartition(5)).collect()}
    assert found == {("one two\n", False): 121, ("three four\n", False): 60, ("two three", True): 60, ("four one", True): 60}


def test_weights_and_ranks(spark, odd_docs, target):
    df = lined(odd_docs)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    s = Counter(bucket(f) for _, t in rows for f in features(t))
    t_ = Counter(bucket(f) for r in target.collect() for f in features(r.text))
    sa, ta = sum(s.values()), sum(t_.values())
    gain = lambda k: math.floor(1000 * math.log((t_[k] + 1) * (sa + 10000) / ((s[k] + 1) * (ta + 10000))))
    want = []
    for i, t in rows:
        g = [gain(bucket(f)) for f in features(t)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(words(t)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0]))
    got = importance_resample(df, target).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    ranks = sorted((r.rank, r.doc_id, r.score) for r in got if r.rank is not None)
    assert ranks == [(i + 1, w[0], w[4]) for i, w in enumerate(order[: 25 * len(order) // 100])] and len(ranks) > 5


def test_draw_ties_nulls_and_empty(spark):
    kind = "doc_id bigint, n_words bigint, score bigint"
    rows = [(i, 20, 5) for i in range(7, 0, -1)] + [(None, 20, 5), (0, 19, 99), (8, None, 99)]
    got = {r.doc_id: r.rank for r in draw(spark.createDataFrame(rows, kind), 50).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: None, 6: None, 7: None, None: None, 0: None, 8: None}
    same = draw(spark.createDataFrame([(1, 30, 4)] * 40, kind), 25)
    assert sorted(r.rank for r in same.collect() if r.rank) == list(range(1, 11)) and same.count() == 40
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert importance_resample(none, none).count() == 0
    assert importance_resample(spark.createDataFrame([(None, None), (1, "")], "doc_id bigint, text string"), none).where("weight = 0 and n_features = 0 and rank is null").count() == 2


# ---- licences


def statistics(a: Automaton, w: list[str]) -> list[int]:
    """By trying all runs."""
    runs = {tuple(t[i:j]) for t, _ in a.phrases + a.templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(w[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(w))]


def test_matching_statistics():
    r = random.Random(3)
    for _ in range(30):
        pool = [f"w{i}" for i in range(r.randint(2, 5))]
        draw_ = lambda n: " ".join(r.choice(pool) for _ in range(n))  # noqa: B023, E731
        a = Automaton([("p", draw_(2)), ("q", draw_(3))], [("t", draw_(r.randint(1, 12))) for _ in range(4)])
        given = [" ".join(r.choice([*pool, "other"]) for _ in range(r.randint(0, 40))) for _ in range(12)]
        x = alnum_words([t.encode() for t in given])
        state, stat = a.stream(a.codes(x), x.first[:-1])
        for d, t in enumerate(given):
            w, of = t.split(), slice(x.first[d], x.first[d + 1])
            want = statistics(a, w)
            # a licence word alone isn't streamed
            alone = [want[i] == 1 and (i == 0 or not want[i - 1]) and (i + 1 == len(w) or not want[i + 1]) for i in range(len(w))]
            assert [0 if x_ else n for n, x_ in zip(want, alone, strict=True)] == stat[of].tolist()
            for p, (phrase, _) in enumerate(a.phrases):
                stands = [i for i in range(len(w)) if i + 1 >= len(phrase) and w[i + 1 - len(phrase) : i + 1] == phrase]
                assert np.flatnonzero(stat[of] >= a.phrase_at[p, state[of]]).tolist() == stands
            for i, (n, v) in enumerate(zip(stat[of], state[of], strict=True)):
                ends = [(t_, e) for t_, (text, _) in enumerate(a.templates) for e in range(n, len(text) + 1) if n and text[e - n : e] == w[i + 1 - n : i + 1]]
                assert not n or sorted(a.ends[v]) == ends


def places(w):
    return sorted((i, label) for label, phrase in PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def test_scan(spark, odd_docs):
    r = random.Random(8)
    mit, gpl = TEMPLATES[0][1], TEMPLATES[5][1]
    changed = " ".join(w if r.random() > 0.1 else "XYZ" for w in mit.split())
    rows = [(200, f"Some code. {mit}. More"), (201, changed), (202, " ".join(mit.split()[:12])), (203, f"{gpl} mit LICENSE, Apache-License"), (204, "the MIT license\nMIT License general public license " * 3000), (205, " ".join(reversed(mit.split()))), (206, "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met")]
    df = odd_docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, score string"))
    got = scan_licenses(df).collect()
    assert len(got) == df.count()
    given = Counter((x.doc_id, tuple(words(x.text))) for x in df.collect())
    for (i, w), _ in given.items():
        base = places(list(w))
        of = [g for g in got if g.doc_id == i and g.n_words == len(w) and g.n_base == len(base)]
        assert of
        for g in of:
            assert (g.first_word, g.last_word) == ((base[0][0], base[-1][0]) if base else (None, None)) and g.base_labels == ",".join(sorted({x for _, x in base}))
            assert set(g.base_labels.split(",")) - {""} <= set(g.labels.split(",")) and 0 <= g.score <= 1
    of = {g.doc_id: g for g in got}
    assert (of[200].labels, of[200].score) == ("mit", 1.0) and of[201].labels == "mit" and 0.6 <= of[201].score < 1
    assert of[202].labels == "" and 0 < of[202].score < 0.6 and of[205].score < 0.2 and of[206].labels == "bsd"
    assert of[203].labels == "apache,gpl,mit" and of[204].n_base == 9000
    plain = [g for g in got if g.doc_id < 200]
    assert plain and all(g.labels == g.base_labels for g in plain)
    assert scan_licenses(df.limit(0)).count() == 0


def test_chains_go_forwards():
    a = automaton()
    t = TEMPLATES[0][1].translate(ASCII).split()
    assert len(a.table) == len(a.words) and a.covered([10, 30], [10, 10], [0, 0]) == {}
    x = alnum_words([" ".join(t[20:30] + ["and"] + t[:10]).encode(), " ".join(t[:10] + ["x"] * 40 + t[10:20]).encode(), " ".join(t[:10] + ["x"] + t[9:20]).encode()])
    state, stat = a.stream(a.codes(x), x.first[:-1])
    for d, most in ((0, 11), (1, 10), (2, 20)):
        of = np.arange(x.first[d], x.first[d + 1])
        long = of[stat[of] >= 4]
        assert a.covered((long + 1).tolist(), stat[long].tolist(), state[long].tolist())[0] in (most, most - 1)
