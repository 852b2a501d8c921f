import random

import numpy as np
import regex
import xxhash
from public_tokenizers import PATTERN

from timeloom.llm.pretokens import split_units, split_words
from timeloom.llm.text import words_of, xxh64_slices


def test_words_are_split_at_ascii_white_space_only():
    w = words_of([b"", b" a  bc\n", b"\x0b ", "d\u00a0e".encode()])
    assert [bytes(w.buf[a:b]).decode() for a, b in zip(w.start, w.end)] == ["a", "bc", "d\u00a0e"]
    assert list(w.first) == [0, 0, 2, 2, 3]
    assert len(words_of([]).start) == 0


def test_hashes_are_those_of_the_library():
    r = np.random.default_rng(0)
    buf = np.frombuffer(r.bytes(5000), np.uint8)
    start = r.integers(0, 4000, 2000)
    end = start + r.integers(0, 400, 2000)
    want = [xxhash.xxh64_intdigest(buf.tobytes()[a:b], 42) for a, b in zip(start, end)]
    assert xxh64_slices(buf, start, end, 42).tolist() == want


def test_pretokens_are_those_of_the_pattern():
    pattern, r = regex.compile(PATTERN), random.Random(1)
    letters = "abstrevld' '''  \n\t \u00a0\u3000éñ12٣²½,.!?@|<>_漢ⅷ\U0001f600"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(4000)]
    words, first = split_words(texts)
    words = words.to_pylist()
    assert all(words[a:b] == pattern.findall(t) for t, a, b in zip(texts, first, first[1:]))


def test_units_make_up_the_text():
    texts = ["", " ", "a  b\n\nc", "▁x y"]
    units, first = split_units(texts)
    units = units.to_pylist()
    assert ["".join(units[a:b]) for a, b in zip(first, first[1:])] == ["", "  ", " a  b\n\nc", " ▁x y"]
