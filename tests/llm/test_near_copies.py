import random
import re

import corpus_pipeline
from timeloom.llm.near_copies import near_copies

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(r, n):
    return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)])


def expected(rows):
    """By comparison of all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def changed(r, text, n):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"new{r.randint(0, 10**9)}"
    return " ".join(w)


def family():
    """40 texts of 200 words, each with copies in which one to five words are others, and copies of these in turn."""
    r = random.Random(3)
    rows = []
    for i in range(40):
        base = sentence(r, 200)
        last = changed(r, base, 4)
        rows += [(100 * i + j, t) for j, t in enumerate([base, *(changed(r, base, n) for n in range(1, 6)), last, changed(r, last, 4), base.upper()])]
    return rows


def test_all_near_copies_are_found(spark):
    rows = family() + [(9000, None), (9001, " "), (9002, "two words"), (9003, "Two  words"), (9004, "two others")]
    want = expected(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert dict(map(tuple, near_copies(docs).collect())) == want
    assert len(set(want.values())) < 120 and want[9001] == 9000 and want[9003] == 9002 and want[9004] == 9004


def test_stage_drops_near_copies(spark):
    """Similarity 0.8 to 0.95, where two bits of a fingerprint don't suffice."""
    rows = family()
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert {x.doc_id for x in kept.collect()} == {i for i, root in expected(rows).items() if i == root}
    assert kept.columns == docs.columns


def test_crowded_marks_by_tiles_and_rounds(spark, monkeypatch):
    """Marks that are crowded at two texts, tiles of four and products of few shingles at once: the same groups; rounds are forced."""
    from timeloom.llm import near_copies as N

    rows = family()[:120]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2).withColumnRenamed("text", "body")
    for name, value in (("CROWD", 1), ("TILE", 4), ("SLICE", 64), ("APART", 0)):
        monkeypatch.setattr(N, name, value)
    found = near_copies(docs.selectExpr("doc_id", "body", "doc_id * 2 as twice"), text_col="body", keep=("twice",)).collect()
    assert {r.doc_id: r.component_id for r in found} == expected(rows) and all(r.twice == 2 * r.doc_id for r in found)


def test_stage_joins_the_links_of_fingerprints_and_of_shingles(spark, monkeypatch):
    """A row goes if either operator, or both in turn, lead to a smaller id; null ids go behind others."""
    from pyspark.sql import functions as F

    ids = [1, 2, 3, 4, 5, None, None]
    docs = spark.createDataFrame([(i, f"text {n}", "en", "src0", 6) for n, i in enumerate(ids)], SCHEMA)
    of = lambda d, i, t, pairs: d.select(i, "_key", F.coalesce(*[F.when(F.col(t) == f"text {n}", F.lit(c)) for n, c in pairs.items()], F.col(i)).alias("component_id"))
    monkeypatch.setattr(corpus_pipeline, "near_copies", lambda d, i, t, keep: of(d, i, t, {1: 1}))
    monkeypatch.setattr(corpus_pipeline, "simhash_near_dups", lambda d, i, t, keep: of(d, i, t, {2: 2, 5: 4}))
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert sorted((x.doc_id, x.text) for x in kept.collect() if x.doc_id) == [(1, "text 0"), (4, "text 3"), (5, "text 4")]
    assert [x.text for x in kept.collect() if x.doc_id is None] == ["text 6"]
