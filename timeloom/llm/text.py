"""Words and their XXH64 hashes for whole batches of texts in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import xxhash

#: The characters that separate words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass
class Words:
    """buf: all words, a space after each; word i is buf[start[i]:end[i]]; text d has words first[d] to first[d+1]."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined.translate(LOWER) if lower else joined, np.uint8)
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[0::2], edge[1::2]
    size = end - start
    keep = ~space
    keep[end] = True
    buf = raw[keep]
    after = np.cumsum(size + 1)
    buf[after - 1] = 0x20
    begin = np.r_[0, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))]
    return Words(buf, after - size - 1, after - 1, np.searchsorted(start, begin))


#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Slices longer than this are hashed one by one.
VECTOR_BYTES = 127


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _lane(x: np.ndarray) -> np.ndarray:
    return _rotl(x * P2, 31) * P1


def xxh64_slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each buf[start:end] as uint64; slices of one length are hashed together."""
    size = end - start
    out = np.empty(len(start), np.uint64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    wide = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    half = np.ndarray(len(buf) + 1, "<u4", padded, strides=(1,))
    order = np.argsort(np.minimum(size, VECTOR_BYTES + 1).astype(np.uint8), kind="stable")
    ordered = np.minimum(size, VECTOR_BYTES + 1)[order]
    bounds = np.searchsorted(ordered, np.arange(VECTOR_BYTES + 3))
    with np.errstate(over="ignore"):
        for n in range(VECTOR_BYTES + 1):
            rows = order[bounds[n] : bounds[n + 1]]
            if not len(rows):
                continue
            at, left = start[rows], n
            if n >= 32:
                s = np.uint64(seed)
                acc = [np.full(len(rows), v, np.uint64) for v in (s + P1 + P2, s + P2, s, s - P1)]
                while left >= 32:
                    for i in range(4):
                        acc[i] = _rotl(acc[i] + wide[at + 8 * i] * P2, 31) * P1
                    at, left = at + 32, left - 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for a in acc:
                    h = (h ^ _lane(a)) * P1 + P4
            else:
                h = np.full(len(rows), np.uint64(seed) + P5, np.uint64)
            h += np.uint64(n)
            while left >= 8:
                h = _rotl(h ^ _lane(wide[at]), 27) * P1 + P4
                at, left = at + 8, left - 8
            if left >= 4:
                h = _rotl(h ^ (half[at].astype(np.uint64) * P1), 23) * P2 + P3
                at, left = at + 4, left - 4
            for i in range(left):
                h = _rotl(h ^ (padded[at + i].astype(np.uint64) * P5), 11) * P1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[rows] = h ^ (h >> np.uint64(32))
    data = buf.tobytes() if len(order) > bounds[VECTOR_BYTES + 1] else b""
    for i in order[bounds[VECTOR_BYTES + 1] :]:
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]], seed)
    return out


#: The characters of words that have only letters, digits and what isn't ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Lines:
    """raw: the texts with A-Z lower-cased, each closed by a line feed; word i is raw[start[i]:end[i]], in line line[i]; line l ends before its line feed
    at feed[l]; text d has the words first[d] to first[d+1] and the lines lines[d] to lines[d+1]."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    feed: np.ndarray
    first: np.ndarray
    lines: np.ndarray


def alnum_words(texts: list[bytes]) -> Lines:
    """The runs of characters other than U+0000-002F, 003A-0060 and 007B-007F after A-Z were lower-cased."""
    raw = np.frombuffer((b"\n".join(texts) + b"\n" if texts else b"").translate(LOWER), np.uint8)
    edge = np.flatnonzero(np.diff(ALNUM[raw], prepend=False))
    start, end = edge[0::2], edge[1::2]
    feed = np.flatnonzero(raw == 0x0A)
    begin = np.r_[0, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))]
    return Lines(raw, start, end, np.searchsorted(feed, start), feed, np.searchsorted(start, begin), np.searchsorted(feed, begin))


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, by the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()
#: Words of up to so many bytes are hashed together, longer ones one by one.
CRC_BYTES = 64


def _crc_shifts() -> np.ndarray:
    """[n, k, v]: what byte k = v of a CRC becomes by n more zero bytes."""
    now = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    out = [now]
    for _ in range(CRC_BYTES + 1):
        now = CRC[now & 255] ^ (now >> 8)
        out.append(now)
    return np.stack(out)


SHIFT = _crc_shifts()


def crc32_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each buf[start:end]."""
    size = end - start
    order = np.argsort(-np.minimum(size, CRC_BYTES + 1).astype(np.int8), kind="stable")
    at, n = start[order], np.minimum(size, CRC_BYTES + 1)[order]
    c = np.full(len(at), 0xFFFFFFFF, np.uint32)
    longer = np.searchsorted(-n, -np.arange(1, CRC_BYTES + 2), side="right")  # how many have so many bytes or more
    for j in range(min(int(n[0]) if len(n) else 0, CRC_BYTES)):
        some = c[: longer[j]]
        c[: longer[j]] = CRC[(some ^ buf[at[: longer[j]] + j]) & 255] ^ (some >> 8)
    out = np.empty(len(at), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in order[: longer[CRC_BYTES]]:
        out[i] = zlib.crc32(buf[start[i] : end[i]])
    return out


def crc32_pairs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """CRC-32 of the words left and right with a space between them, from the words' own."""
    size = end[right] - start[right]
    n = np.minimum(size, CRC_BYTES)

    def behind(c, n):
        return SHIFT[n, 0, c & 255] ^ SHIFT[n, 1, (c >> 8) & 255] ^ SHIFT[n, 2, (c >> 16) & 255] ^ SHIFT[n, 3, c >> 24]

    out = behind(crc[left], n + 1) ^ behind(np.full(1, zlib.crc32(b" "), np.uint32), n) ^ crc[right]
    for i in np.flatnonzero(size > CRC_BYTES):
        out[i] = zlib.crc32(buf[start[right[i]] : end[right[i]]], zlib.crc32(b" ", int(crc[left[i]])))
    return out
