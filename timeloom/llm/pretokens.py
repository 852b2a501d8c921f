"""Pre-tokens of whole batches of texts in numpy, as Arrow strings that share the texts' bytes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, WHITE = range(4)
#: The characters with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = WHITE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _strings(text: str, chars: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The pieces of text that begin where begin is set, without copying them."""
    width = np.uint8(1) + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
    at = np.cumsum(width, dtype=np.int64) - width
    data = text.encode()
    offsets = np.r_[at[begin], len(data)].astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


def _after(x: np.ndarray, n: int, fill) -> np.ndarray:
    """x moved n places forward (or back, if negative)."""
    out = np.full_like(x, fill)
    if n > 0:
        out[n:] = x[:-n]
    else:
        out[:n] = x[-n:]
    return out


def split_words(texts: list[str], special: str | None = None) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of byte-level BPE, and for each text the number of its first one (and the total at the end).

    The pieces are those of the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ :
    runs of one class that take one space before them, white space else by itself, and English contractions.
    The string `special` is a pre-token by itself, and what stands around it is split as texts of their own.
    """
    parts, of = texts, None
    if special and any(special in t for t in texts):
        parts, of = [], []
        for d, t in enumerate(texts):
            pieces = [p for i, x in enumerate(t.split(special)) for p in ([special, x] if i else [x])]
            parts += pieces
            of += [d] * len(pieces)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size)
    text = "".join(parts)
    n = len(text)
    if not n:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    chars = code_points(text)
    kind = char_classes()[chars]
    first = np.zeros(n, bool)
    first[(ends - size)[size > 0]] = True
    last = _after(first, -1, True)
    run = first | (kind != _after(kind, 1, 255))
    white = kind == WHITE
    # the last white-space character of a run inside a text stands apart from the others
    run |= white & ~last & ~_after(white, -1, True)
    space = (chars == 0x20) & white & ~last & ~_after(white, -1, True)
    run &= ~_after(space, 1, False)
    quote = np.flatnonzero((chars == 0x27) & run & ~last)
    if len(quote):
        near = np.r_[chars, 0, 0]
        b, c = near[quote + 1], near[quote + 2]
        inside = ~last[quote + 1]
        two = np.isin(b, [ord(x) for x in "stmd"])
        three = inside & (((b == ord("r")) & (c == ord("e"))) | ((b == ord("v")) & (c == ord("e"))) | ((b == ord("l")) & (c == ord("l"))))
        run[quote[two | three] + 1] = False
        for hit, k in ((two, 2), (three, 3)):
            after = quote[hit] + k
            run[after[after < n]] = True
    if of is not None:
        start = ends - size
        for i, p in enumerate(parts):
            if p == special:
                run[start[i] + 1 : ends[i]] = False
    words = _strings(text, chars, run)
    count = np.r_[0, np.cumsum(run)]
    per_part = count[ends] - count[ends - size]
    per_text = per_part if of is None else np.bincount(of, per_part, len(texts)).astype(np.int64)
    return words, np.r_[0, np.cumsum(per_text)]


def split_units(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of each text, a space put before it, that a piece model without inner spaces and without line feeds never
    merges across: a space begins one unless another stands before it, and a line feed stands alone. An empty text has none."""
    parts = [" " + t if t else "" for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size)
    text = "".join(parts)
    if not text:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    chars = code_points(text)
    blank = (chars == 0x20) | (chars == 0x2581)
    feed = chars == 0x0A
    run = (blank & ~_after(blank, 1, False)) | feed | _after(feed, 1, True)
    run[(ends - size)[size > 0]] = True
    count = np.r_[0, np.cumsum(run)]
    return _strings(text, chars, run), np.r_[0, count[ends]]


HELD_CHARS = 64


class WordCache:
    """What `encode` gives for each distinct word, kept for a worker's later batches; at most `most` words are held, none of more than
    HELD_CHARS characters."""

    def __init__(self, encode, most: int = 200_000):
        self.encode, self.most, self.held = encode, most, {}

    def __call__(self, words: list[str]) -> list:
        found = list(map(self.held.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            if len(self.held) + len(missing) > self.most:
                self.held = {}
            for i, x in zip(missing, self.encode([words[i] for i in missing]), strict=True):
                found[i] = x
                if len(words[i]) <= HELD_CHARS:
                    self.held[words[i]] = x
        return found


def token_ids(texts: list[str], cache: WordCache, special: str | None) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in order, and where each text's ids begin (and the total at the end); cache gives each word's ids."""
    words, first = split_words(texts, special)
    coded = words.dictionary_encode()
    each = cache(coded.dictionary.to_pylist())
    size = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.fromiter(chain.from_iterable(each), np.uint32, int(size.sum()))
    start = np.cumsum(size) - size
    at = np.asarray(coded.indices).astype(np.int64)
    count = size[at]
    ends = np.cumsum(count)
    place = np.repeat(start[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
    return flat[place], np.r_[0, ends][first]
