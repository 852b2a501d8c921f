import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from timeloom.llm.automaton import TokenAutomaton, automaton, bpe_round_trip, emit_labels
from timeloom.llm.packing import pack_documents, plan
from timeloom.llm.pretokens import token_ids
from timeloom.llm.queries import op4_best_fit_packing, op5_token_counts, op8_bpe_automaton
from timeloom.llm.token_counts import count_tokens, frequent_units


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_automaton_gives_the_librarys_tokens(library):
    _, cache, flat, begin = automaton(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    letters = "abstrevld' '''  \n\t \u00a0éñ12٣²,.!?@|_漢ⅷ\U0001f600"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * k for k in range(50)] + ["ab" * k for k in range(30)] + [" " * k for k in range(50)] + ["x<|endoftext|> y<|endoftext|>"]
    texts += ["".join(r.choice("theainrs") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    ids, first = token_ids(texts, cache, "<|endoftext|>")
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.decode() for x in emit_labels(ids, first, flat, begin)] == texts


def test_automaton_on_small_merge_lists():
    """Every word over two letters against plain merging, also with merges that take equal tokens or never apply."""
    letters = {c: i for i, c in enumerate("ab")}
    for merges in ([("a", "a"), ("aa", "a")], [("a", "b"), ("b", "a"), ("ab", "a")], [("a", "a"), ("aa", "aa"), ("b", "aa")]):
        vocab = dict(letters)
        for m in merges:
            vocab["".join(m)] = len(vocab)
        a = TokenAutomaton(vocab, merges, {})
        for n in range(1, 10):
            for k in range(2**n):
                word = format(k, f"0{n}b").replace("0", "a").replace("1", "b")
                pieces = list(word)
                for u, v in merges:
                    i = 0
                    while i < len(pieces) - 1:
                        if (pieces[i], pieces[i + 1]) == (u, v):
                            pieces[i : i + 2] = [u + v]
                        i += 1
                assert a.encode(word.encode()) == [vocab[p] for p in pieces], (word, merges)


def test_arc_table_is_bounded(library):
    """A table of few rows is made anew when it is full, and long words go through the same tables."""
    from timeloom.llm import automaton as A

    path = public_tokenizers.path("byte_bpe_50k.json")
    fresh = A.automaton.__wrapped__(path)[0]
    r = random.Random(6)
    words = ["".join(r.choice("theainrsUXW?49") for _ in range(r.randint(1, 40))) for _ in range(400)] + ["ab" * 2000, "?" * 500]
    rows, A.ROWS, A.WORDS = A.ROWS, 300, 50
    try:
        got = fresh.encode_words(words)
    finally:
        A.ROWS, A.WORDS = rows, 4_096
    assert fresh._held <= 300
    pieces, first = A.token_ids(words, A.WordCache(fresh.encode_words), None)
    assert [pieces[a:b].tolist() for a, b in zip(first, first[1:])] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert got == fresh.encode_words(words)


def test_packing_of_very_long_white_space(spark, library):
    odd = [" " * 1_000_000 + "x", "\n" * 800_000, "a" * 300_000]
    rows = pack_documents(spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")).collect()
    check_packing(rows, {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(odd)}, 2048)


def test_round_trip(docs, odd_docs, no_docs, texts, library):
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in texts)
    assert sorted((r.doc_id, r.ids, r.decoded) for r in bpe_round_trip(docs).collect()) == want
    assert sorted((r.doc_id, r.ids, r.decoded) for r in bpe_round_trip(odd_docs).collect()) == want
    assert bpe_round_trip(no_docs).collect() == []


def test_round_trip_query(spark, data, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, op8_bpe_automaton(spark, data).collect())) == sorted(want)


def test_counts(docs, odd_docs, no_docs, texts, model):
    want = sorted((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in texts)
    assert any(x[3] for x in want)
    for frame, top in ((docs, 16_384), (odd_docs, 5), (docs, 0)):
        assert sorted(map(tuple, count_tokens(frame, top=top).collect())) == want
    assert count_tokens(no_docs).collect() == []
    assert len(frequent_units(docs, top=7)) == 7 and frequent_units(no_docs) == []
    assert sorted(map(tuple, count_tokens(docs.unionAll(docs), top=3).collect())) == sorted(want * 2)


def test_no_pre_token_is_shuffled(docs, monkeypatch):
    """All texts are read by one pass without an exchange; the first tier comes from some of the rows."""
    from timeloom.llm import token_counts

    plan = count_tokens(docs.coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "unit" not in plan
    monkeypatch.setattr(token_counts, "SAMPLE", 5)
    few = frequent_units(docs, sample=5)
    assert 0 < len(few) < len(frequent_units(docs))


def test_counts_query(spark, data, model):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in op5_token_counts(spark, data).collect()}
    assert got == {r.doc_id: (len(r.text.encode()), len(model.encode(r.text))) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def check_packing(rows, ids_of, cap):
    """rows of one row of documents each, by piece; ids_of: its ids, for rows with unique ids."""
    placed = {}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for sequence in placed.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= cap
    assert by_doc.keys() == ids_of.keys()
    for i, pieces in by_doc.items():
        ids, at = [*ids_of[i], 0], 0
        for n, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and (n == 0 or r.length == cap) and r.length <= cap
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and len(pieces) == -(-len(ids) // cap)
    return len(placed)


def test_packing(docs, odd_docs, no_docs, texts, library):
    rows = pack_documents(odd_docs, cap=128).collect()
    seen = Counter(i for i, _ in texts)
    single = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts if seen[i] == 1}
    total = sum(r.length for r in rows)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert total == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    again = pack_documents(docs.where("doc_id <> 10"), cap=128).collect()
    n = check_packing(again, single, 128)
    assert n <= sum(r.length for r in again) / 128 * 1.1 + 1
    assert pack_documents(no_docs).collect() == []


def test_packing_query(spark, data, library):
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = op4_best_fit_packing(spark, data).collect()
    n = check_packing(rows, ids, 2048)
    assert n <= sum(len(x) + 1 for x in ids.values()) / 2048 * 1.03 + 1


def test_plan_uses_every_piece_once_and_fills_what_can_be_filled():
    r = random.Random(4)
    for _ in range(30):
        cap = r.randint(5, 60)
        count = np.bincount([r.randint(1, cap) for _ in range(r.randint(0, 300))], minlength=cap + 1)
        used = np.zeros_like(count)
        for lengths, times in plan(count, cap):
            assert sum(lengths) <= cap and times > 0
            for n in lengths:
                used[n] += times
        assert (used == count).all()
    assert plan(np.bincount([6, 4, 5, 3, 2, 7, 2, 1], minlength=11), 10) == [([7, 3], 1), ([6, 4], 1), ([5, 2, 2, 1], 1)]
