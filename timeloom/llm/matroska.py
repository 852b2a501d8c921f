"""Media columns in Matroska: a payload is stored as 8-bit PCM samples, and any file is parsed into a table of packets.

The parser walks the EBML elements by their variable-length ids and sizes (unknown sizes of segments and clusters included),
takes apart simple blocks and block groups with all four kinds of lacing, and reads the cues. The writer uses fixed-size lacing
for full blocks and EBML lacing for the rest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices, utf8_list

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, KIND, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

UNIT = 64  # bytes of payload that padding fills up: 8 ms at 8 kHz
SAMPLE_RATE = 8000
FRAME, FRAMES, BLOCKS = 512, 8, 8  # bytes of a frame, frames of a block, blocks of a cluster


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def _element(name: int, data: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(data)) + data


def _number(name: int, n: int) -> bytes:
    return _element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed_size(n: int) -> bytes:
    width = 1
    while not -(1 << (7 * width - 1)) < n < 1 << (7 * width - 1):
        width += 1
    return (n + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big")


_HEAD = _element(
    EBML, b"".join(_number(k, v) for k, v in ((EBML_VERSION, 1), (EBML_READ, 1), (EBML_MAX_ID, 4), (EBML_MAX_SIZE, 8))) + _element(DOC_TYPE, b"matroska") + _number(DOC_VERSION, 4) + _number(DOC_READ, 2)
)
_TRACKS = _element(
    TRACKS,
    _element(TRACK, _number(NUMBER, 1) + _number(UID, 1) + _number(KIND, 2) + _number(LACING, 1) + _element(CODEC, b"A_PCM/INT/LIT") + _number(DEFAULT_DURATION, FRAME * 1_000_000_000 // SAMPLE_RATE) + _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)) + _number(CHANNELS, 1) + _number(DEPTH, 8))),
)


def _block(at: int, frames: list[bytes]) -> bytes:
    """A simple block of track 1, `at` ms after its cluster."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        flags, lace = 0x80, b""
    elif len(set(sizes)) == 1:
        flags, lace = 0x84, bytes([len(frames) - 1])
    else:
        flags = 0x86
        lace = bytes([len(frames) - 1]) + _size(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return _element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", at, flags) + lace + b"".join(frames))


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def write(payload: bytes) -> bytes:
    """The payload, a positive multiple of UNIT bytes long, as a Matroska file."""
    ms = lambda n: n * 1000 // SAMPLE_RATE
    info = _element(INFO, _number(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", ms(len(payload)))) + _element(MUXER, b"timeloom") + _element(WRITER, b"timeloom"))
    body, cues, place = [info, _TRACKS], [], len(info) + len(_TRACKS)
    step = FRAME * FRAMES
    for a in range(0, len(payload), step * BLOCKS):
        part = payload[a : a + step * BLOCKS]
        blocks = [_block(ms(i), [part[j : min(j + FRAME, i + step)] for j in range(i, min(i + step, len(part)), FRAME)]) for i in range(0, len(part), step)]
        cluster = _element(CLUSTER, _number(TIMESTAMP, ms(a)) + b"".join(blocks))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, ms(a)) + _element(CUE_PLACES, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, place))))
        body.append(cluster)
        place += len(cluster)
    return _HEAD + _element(SEGMENT, b"".join([*body, _element(CUES, b"".join(cues))]))


@dataclass
class Media:
    """packets: (track, timestamp in ns, offset, size, keyframe, lacing, cluster); cues: (time in ns, track, cluster's offset)."""

    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def _read_size(data: bytes, at: int) -> tuple[int, int]:
    """The number that a variable-length size holds, -1 for unknown, and where it ends."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise ValueError(f"no size at byte {at}")
    n = int.from_bytes(data[at : at + width], "big") & ((1 << (7 * width)) - 1)
    return (-1 if n == (1 << (7 * width)) - 1 else n), at + width


def _elements(data: bytes, at: int, end: int):
    """(id, begin, end, place) of each element; one of unknown size goes on to the end."""
    while at < end:
        place, width = at, 9 - data[at].bit_length()
        if width > 4:
            raise ValueError(f"no element id at byte {at}")
        name = int.from_bytes(data[at : at + width], "big")
        n, at = _read_size(data, at + width)
        stop = end if n < 0 else at + n
        if stop > end:
            raise ValueError(f"an element at byte {place} is longer than what holds it")
        yield name, at, stop, place
        at = stop


def _lace(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """The frames' sizes, and where the first begins."""
    if not kind:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if kind == 2:
        return [(end - at) // n] * n, at
    sizes = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for i in range(n - 1):
            begin = at
            size, at = _read_size(data, at)
            sizes.append(size if not i else sizes[-1] + size - ((1 << (7 * (at - begin) - 1)) - 1))
    return [*sizes, end - at - sum(sizes)], at


def _unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _add_block(media: Media, data: bytes, a: int, b: int, time: int, key: bool | None, group_key: bool) -> None:
    track, at = _read_size(data, a)
    relative, flags = struct.unpack_from(">hB", data, at)
    kind = flags >> 1 & 3
    sizes, at = _lace(data, at + 3, b, kind)
    stamp = (time + relative) * media.scale
    each = media.tracks.get(track, {}).get("frame_ns", 0)
    for i, size in enumerate(sizes):
        if size < 0:
            raise ValueError(f"lacing is longer than its block at byte {a}")
        media.packets.append((track, stamp + i * each, at, size, bool(flags & 0x80) if key is None else group_key, kind, len(media.clusters) - 1))
        at += size


def _cluster(media: Media, data: bytes, a: int, b: int) -> int:
    """Reads a cluster's blocks; returns where it ends, for one of unknown size at the next top-level element."""
    time = 0
    for name, i, j, place in _elements(data, a, b):
        if name in (CLUSTER, CUES, INFO, TRACKS):
            return place
        if name == TIMESTAMP:
            time = _unsigned(data, i, j)
        elif name == SIMPLE_BLOCK:
            _add_block(media, data, i, j, time, None, True)
        elif name == BLOCK_GROUP:
            inner = list(_elements(data, i, j))
            key = all(x[0] != REFERENCE for x in inner)
            for x, p, q, _ in inner:
                if x == BLOCK:
                    _add_block(media, data, p, q, time, True, key)
    return b


def parse(data: bytes) -> Media:
    """The tracks, packets and cues of a Matroska file; ValueError if it isn't one."""
    media, begin = Media(), 0
    try:
        for top, a, b, _ in _elements(data, 0, len(data)):
            if top == EBML and not any(x == DOC_TYPE and data[i:j] in (b"matroska", b"webm") for x, i, j, _ in _elements(data, a, b)):
                raise ValueError("another document type")
            if top != SEGMENT:
                continue
            at, begin = a, a
            while at < b:
                name, i, j, place = next(_elements(data, at, b))
                at = j
                if name == INFO:
                    media.scale = next((_unsigned(data, p, q) for x, p, q, _ in _elements(data, i, j) if x == SCALE), media.scale)
                elif name == TRACKS:
                    for x, p, q, _ in _elements(data, i, j):
                        if x == TRACK:
                            has = {y: (c, d) for y, c, d, _ in _elements(data, p, q)}
                            media.tracks[_unsigned(data, *has[NUMBER])] = {"codec": data[slice(*has[CODEC])].decode(), "frame_ns": _unsigned(data, *has[DEFAULT_DURATION]) if DEFAULT_DURATION in has else 0}
                elif name == CLUSTER:
                    media.clusters.append(place - begin)
                    at = _cluster(media, data, i, j)
                elif name == CUES:
                    for x, p, q, _ in _elements(data, i, j):
                        if x == CUE_POINT:
                            inner = list(_elements(data, p, q))
                            time = next(_unsigned(data, c, d) for y, c, d, _ in inner if y == CUE_TIME)
                            for y, c, d, _ in inner:
                                if y == CUE_PLACES:
                                    place_of = {z: _unsigned(data, e, f) for z, e, f, _ in _elements(data, c, d)}
                                    media.cues.append((time * media.scale, place_of.get(CUE_TRACK, 0), place_of.get(CUE_CLUSTER, -1)))
    except (IndexError, KeyError, StopIteration, struct.error) as e:
        raise ValueError(f"broken file: {e!r}") from e
    return media


def store_matroska(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media binary) for every row: its text's UTF-8 bytes, padded with zeros, as a Matroska file.

    A null text is stored like an empty one. Rows and ids may repeat; an empty table gives an empty result; other columns are
    not read.
    """

    def run(batches):
        for b in text_slices(batches, text_col):
            data = utf8_list(b.column(text_col))
            yield pa.record_batch([b.column(id_col), pa.array(list(map(len, data)), pa.int64()), pa.array([write(padded(x)) for x in data], pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


PACKET = "track int, timestamp_ns bigint, offset bigint, size bigint, keyframe boolean, lacing int, cluster int"


def matroska_packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each file: its packets and cues as arrays of structs, and `error`, which is null if it was read whole.

    A null file has null arrays and the error `no data`; one that isn't well-formed Matroska has null arrays and what is wrong.
    """

    def run(batches):
        for b in text_slices(batches, media_col):
            packets, cues, errors = [], [], []
            for data in b.column(media_col).to_pylist():
                try:
                    found = parse(data) if data is not None else None
                    packets.append(found and found.packets)
                    cues.append(found and found.cues)
                    errors.append(None if found else "no data")
                except ValueError as e:
                    packets.append(None)
                    cues.append(None)
                    errors.append(str(e))
            names = [(x.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[x.split()[1]]) for x in PACKET.split(", ")]
            to_dicts = lambda rows, keys: [r and [dict(zip(keys, x, strict=True)) for x in r] for r in rows]
            cue = [("time_ns", pa.int64()), ("track", pa.int32()), ("cluster_offset", pa.int64())]
            yield pa.record_batch(
                [b.column(id_col), pa.array(to_dicts(packets, [n for n, _ in names]), pa.list_(pa.struct(names))), pa.array(to_dicts(cues, [n for n, _ in cue]), pa.list_(pa.struct(cue))), pa.array(errors, pa.string())],
                [id_col, "packets", "cues", "error"],
            )

    kind = media.schema[id_col].dataType.simpleString()
    packet = ", ".join(x.replace(" ", ": ") for x in PACKET.split(", "))
    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, packets array<struct<{packet}>>, cues array<struct<time_ns: bigint, track: int, cluster_offset: bigint>>, error string")


def describe(data: bytes) -> tuple[bytes, str]:
    """The samples of a file, read through its packet table, and figures of them."""
    media = parse(data)
    payload = b"".join(data[p[2] : p[2] + p[3]] for p in media.packets)
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    end = media.packets[-1][1] + media.packets[-1][3] * 1_000_000_000 // SAMPLE_RATE
    cued = sum(c[2] in media.clusters for c in media.cues)
    return payload, f"packets={len(media.packets)};clusters={len(media.clusters)};cued={cued};ms={end // 1_000_000};sum={int(x.sum())};squares={int((x * x).sum())};crossings={crossings}"


def matroska_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of store_matroska's rows."""

    def run(batches):
        for b in text_slices(batches, media_col):
            data = b.column(media_col).to_pylist()
            read = [describe(x) for x in data]
            yield pa.record_batch(
                [
                    b.column(id_col),
                    b.column("n_bytes"),
                    pa.array([len(p) for p, _ in read], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p, _ in read], pa.string()),
                    pa.array([zlib.crc32(p[-UNIT:]) for p, _ in read], pa.int64()),
                    pa.array(list(map(len, data)), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()),
                    pa.array([f for _, f in read], pa.string()),
                ],
                [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "n_bytes", media_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
