import hashlib
import re

import timeloom.llm.substrings as S
import pytest

from timeloom.llm.queries import op9_substring_dedup


def brute(rows, width=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect())


def test_against_brute_force(docs, odd_docs, texts, monkeypatch):
    assert rows_of(S.substring_dedup(docs)) == brute(texts)
    monkeypatch.setattr(S, "BLOCK", 3000)  # many blocks, so that repeats lie in different ones
    monkeypatch.setattr(S, "SHARD_WINDOWS", 200)
    assert rows_of(S.substring_dedup(docs)) == brute(texts)
    assert rows_of(S.substring_dedup(odd_docs)) == brute(texts)


def test_a_crowded_sketch_loses_nothing(docs, texts, monkeypatch):
    """With 256 cells a row most windows collide; the second pass sorts them out."""
    monkeypatch.setattr(S, "BLOCK", 3000)
    monkeypatch.setattr(S, "CELL_BITS", 8)
    assert rows_of(S.substring_dedup(docs)) == brute(texts)


def test_keeps_columns_and_rows(docs, no_docs, odd_docs):
    out = S.substring_dedup(odd_docs, keep=tuple(odd_docs.columns))
    assert out.count() == docs.count() and "n_words" in out.columns
    assert S.substring_dedup(no_docs).collect() == []


def test_null_ids_come_last(spark):
    text = " ".join(f"w{i}" for i in range(20))
    out = S.substring_dedup(spark.createDataFrame([(None, text), (3, text)], "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_removed for r in out} == {None: 20, 3: 0}


def test_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(rows))
    assert sorted(map(tuple, op9_substring_dedup(spark, data).collect())) == want


@pytest.mark.parametrize("bits", [4, 10, 25])
def test_the_merged_sketch_only_overestimates(bits, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(S, "CELL_BITS", bits)
    r = np.random.default_rng(bits)
    blocks = [np.unique(r.integers(0, 1 << 32, 300, dtype=np.uint64)) for _ in range(5)]
    blocks[3] = np.unique(np.r_[blocks[3], blocks[0][:40]])
    table = pa.table({"block": [0, 1, 2, 3, 4], "shard": [0] * 5, "cells": [S._planes(b, S.VALUE_BYTES) for b in blocks]})
    seen = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(b)).astype(bool) for x, b in zip(S._estimate(table).column("seen").to_pylist(), blocks)]
    for i, b in enumerate(blocks):
        repeated = np.isin(b, np.concatenate([x for j, x in enumerate(blocks) if j != i]))
        assert seen[i][repeated].all()
        if bits == 25:
            assert seen[i].sum() <= repeated.sum() + 2


def test_messages_take_several_hops(docs, odd_docs, no_docs, texts, monkeypatch):
    """With two bits a hop, many blocks and many shards, messages and answers go by way of others."""
    for name, value in {"BLOCK": 1500, "SHARD_WINDOWS": 100, "FAN_BITS": 2}.items():
        monkeypatch.setattr(S, name, value)
    assert rows_of(S.substring_dedup(docs)) == brute(texts)
    assert rows_of(S.substring_dedup(odd_docs)) == brute(texts)
    assert S.substring_dedup(no_docs).collect() == []


def test_rows_sent_grow_with_the_blocks_alone(spark):
    """Each sender writes to each receiver, over one table and another eight times as large: eight times as many rows, and all arrive."""
    import numpy as np
    import pyarrow as pa

    from timeloom.llm import messages as M

    def sent(n):
        last = M.hops(n, 2)

        def run(batches):
            for b in batches:
                for i in b.column("id").to_pylist():
                    yield M.rows(np.arange(n), np.full(n, i), pa.array([b"%d>%d" % (i, j) for j in range(n)], pa.binary()), 1, last, 2)

        first = spark.range(n, numPartitions=2).mapInArrow(run, M.ROW)
        got = M.delivered(first, last, 2).collect()
        assert all(set(r.receiver) == {r.part} for r in got)
        assert sorted(bytes(x) for r in got for x in r.payload) == sorted(b"%d>%d" % (i, j) for i in range(n) for j in range(n))
        return first.count()

    few, many = sent(16), sent(128)
    assert few <= 4 * 16 and many <= 4 * 128


def test_work_does_not_grow_with_the_shards(docs, texts, monkeypatch):
    """With 2^20 shards a block has to do with those only that its windows are in; and no table stays in the catalogue."""
    import numpy as np

    h = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)) << np.uint64(1)
    for bits in (3, 20, 40):
        shards, bounds = S._shards(h, bits)
        assert len(shards) <= len(h) and len(bounds) == len(shards) + 1 and (np.repeat(shards, np.diff(bounds)) == h >> np.uint64(64 - bits)).all()
    assert [len(x) for x in S._shards(h[:0], 20)] == [0, 1]
    n = sum(len((t or "").split()) for _, t in texts)
    monkeypatch.setattr(S, "SHARD_WINDOWS", n / (1 << 20))
    monkeypatch.setattr(S, "BLOCK", 20_000)
    few = [(i, t) for i, t in texts if len(t or "") < 2000]
    assert rows_of(S.substring_dedup(docs.where("coalesce(length(text), 0) < 2000"))) == brute(few)
    assert not [t for t in docs.sparkSession.catalog.listTables() if t.name.startswith("timeloom_blocks")]
